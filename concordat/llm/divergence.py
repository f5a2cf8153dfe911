"""Operator 11: how far the sources of a language differ in the words that they use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.stage import table
from concordat.llm.text import ASCII_LOWER, blocks, rows_of, word_spans

#: A term is a run of ASCII letters and of characters beyond ASCII, whose UTF-8 bytes are all above 127.
_TERM = np.zeros(256, bool)
_TERM[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
#: Documents of a language that a kept term is in at least, and ranks of terms that are returned.
LEAST_DOCS, TOP = 10, 10


def _share(count: Column | str, size: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (size + 2 * terms)); decimals hold what a long can't."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    top = F.lit(10**9).cast("decimal(10,0)") * (wide(count) + F.lit(2).cast("decimal(1,0)"))
    return F.call_function("div", top, wide(size) + F.lit(2).cast("decimal(1,0)") * wide(terms)) + 1


def _far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)). A share is 10^9 + 1 at most, so the square stays below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in a group, and its documents there."""
    read = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text"))
    found = rows.mapInArrow(_block_counts, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each block of texts: a row for each of its groups and terms, which are compared letter by letter."""
    for batch in batches:
        ids: dict[tuple[str, str], int] = {}
        group = np.array([ids.setdefault(pair, len(ids)) for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        langs, sources = (pa.array([pair[k] for pair in ids], pa.string()) for k in (0, 1))
        for lo, _, data, offsets in blocks(batch.column(2), 1 << 21):
            data = ASCII_LOWER[data]
            solid = _TERM[data]
            starts, ends, bounds = word_spans(data, offsets, solid)
            places = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[solid])).dictionary_encode()
            size = max(1, len(terms.dictionary))
            # First by text and term, then by group and term.
            own, n = np.unique(rows_of(bounds) * size + terms.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(own, size)
            both, at = np.unique(group[lo + row] * size + term, return_inverse=True)
            count = np.zeros(len(both), np.int64)
            np.add.at(count, at, n)
            of, term = np.divmod(both, size)
            names = terms.dictionary.take(pa.array(term)).cast(pa.string())
            cols = [langs.take(pa.array(of)), sources.take(pa.array(of)), names, pa.array(count), pa.array(np.bincount(at, minlength=len(both)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "count", "docs"])


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, lang_count, groups): a row for each kept term of a language.

    ``groups`` has (source, count) of each source that holds the term, in order: as many entries as a
    language has sources at most.
    """
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"), F.sort_array(F.collect_list(F.struct("source", "count"))).alias("groups"))
    return terms.where(F.col("docs") >= least).drop("docs")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each group of ``docs``, a source within a language, stands out.

    Part ``pair`` compares the group with each other source of its language over all kept terms; part
    ``term`` has the ``top`` terms that are commoner in the group than in its language. Terms are counted
    in cells of equal (count in the group, count in the language), or of equal counts in two sources: the
    value is computed once for each cell and weighed with the number of its terms. Cells of equal value are
    merged, ranked by the number of terms up to them, and only those that reach a rank to ``top`` are opened
    into terms, in UTF-8 order. All arithmetic is on whole numbers.

    Each row is a document. Null texts, languages and sources count as empty; texts may be of any length.
    A group without terms, or of a language without kept terms, has pairs (value 0 in the latter case) and no
    terms; a source alone in its language has no pairs. Ties go by UTF-8 order of the item. Other columns
    are not read. An empty table gives no rows. The result holds all pairs of a language's sources, so
    sources must be few enough for that; nothing is gathered for one of them.
    """
    read = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    terms = table(kept_terms(term_counts(docs, lang_col, source_col, text_col), least), "kept-terms")
    each = terms.select("lang", "term", "lang_count", F.explode("groups").alias("g")).select("lang", "term", "lang_count", "g.source", "g.count")
    # Cells: how many terms have these counts.
    cells = table(each.groupBy("lang", "source", "count", "lang_count").agg(F.count(F.lit(1)).alias("terms")), "count-cells")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_count").alias("lang_size"))
    sizes = cells.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("size"))
    groups = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source")).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "n_terms", "lang_size"])
    groups = table(groups, "groups")
    return _top_terms(each, cells, groups, top).unionByName(_pairs(terms, cells, groups))


def _top_terms(each: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rated = cells.join(groups, ["lang", "source"]).withColumns({"p": _share("count", "size", "n_terms"), "q": _share("lang_count", "lang_size", "n_terms")})
    rated = rated.where("p > q").select("lang", "source", "count", "lang_count", "terms", _far(F.col("p"), F.col("q")).alias("value"))
    own = Window.partitionBy("lang", "source")
    merged = rated.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    # No more than ``top`` values can hold the first ``top`` terms; those of a lower value come after all of a higher one.
    merged = merged.withColumn("k", F.row_number().over(own.orderBy(F.desc("value")))).where(F.col("k") <= top)
    before = F.coalesce(F.sum("terms").over(own.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = merged.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    opened = rated.join(wanted, ["lang", "source", "value"]).select("lang", "source", "count", "lang_count", "value")
    found = each.join(opened, ["lang", "source", "count", "lang_count"])
    ranked = found.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(terms: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of sources of a language; each is computed once, as value(a, b) = value(b, a).

    With p(c) the share of a count c: the sum over all kept terms is that of the terms in both sources, of
    p(a) against p(0) over those in one only, and of p(0) against p(0) over all others. Adding the second
    over all terms of a source and the third over all kept terms leaves a correction for the terms in both.
    """
    one = lambda s: groups.select("lang", F.col("source").alias(s), F.col("size").alias(f"size_{s}"), "n_terms")
    share = lambda c, s: _share(c, f"size_{s}", "n_terms")
    none = F.lit(0)
    both = terms.select("lang", F.posexplode("groups").alias("i", "x"), "groups")
    both = both.select("lang", "x", F.explode(F.slice("groups", F.col("i") + 2, F.size("groups"))).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("x.count").alias("count_a"), F.col("y.source").alias("b"), F.col("y.count").alias("count_b")).agg(F.count(F.lit(1)).alias("terms"))
    both = both.join(one("a").drop("n_terms"), ["lang", "a"]).join(one("b"), ["lang", "b"])
    both = both.withColumns({"pa": share("count_a", "a"), "pb": share("count_b", "b"), "za": share(none, "a"), "zb": share(none, "b")})
    pa, pb, za, zb = map(F.col, ("pa", "pb", "za", "zb"))
    shared = both.select("lang", "a", "b", (F.col("terms") * (_far(pa, pb) - _far(pa, zb) - _far(za, pb) + _far(za, zb))).alias("value"))

    # Terms of one source against a count of 0 in each other one.
    alone = cells.groupBy("lang", F.col("source").alias("a"), F.col("count").alias("count_a")).agg(F.sum("terms").alias("terms"))
    alone = alone.join(one("a").drop("n_terms"), ["lang", "a"]).join(one("b"), "lang").where("a <> b")
    alone = alone.withColumns({"pa": share("count_a", "a"), "za": share(none, "a"), "zb": share(none, "b")})
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("terms") * (_far(pa, zb) - _far(za, zb))).alias("value"))

    rest = one("a").drop("n_terms").join(one("b"), "lang").where("a < b")
    empty = F.call_function("nullif", "n_terms", F.lit(0))
    rest = rest.withColumns({"za": _share(none, "size_a", empty), "zb": _share(none, "size_b", empty)})
    rest = rest.select("lang", "a", "b", F.coalesce(F.col("n_terms") * _far(za, zb), F.lit(0)).alias("value"))

    sums = shared.unionByName(alone).unionByName(rest).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    sums = sums.select("lang", ways, "value").select("lang", "w.source", "w.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


#: The same for DuckDB, with every kept term in every group and no cells.
SQL = r"""
with d as (
    select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), w as (
    select i, lang, source, unnest(terms) as term from d
), kept as (
    select lang, term, count(*) as c from w group by all having count(distinct i) >= 10
), g as (
    select distinct lang, source from d
), n as (
    select lang, count(*)::hugeint as v, sum(c)::hugeint as size from kept group by lang
), c as (
    select lang, source, term, count(*) as c from w join kept using (lang, term) group by all
), full_counts as (
    select g.lang, g.source, kept.term, coalesce(c.c, 0)::hugeint as c, kept.c::hugeint as lang_c
    from g join kept on g.lang = kept.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term
), p as (
    select f.lang, f.source, f.term, f.c,
           1 + (1000000000::hugeint * (f.c + 2)) // (sum(f.c) over (partition by f.lang, f.source) + 2 * n.v) as p,
           1 + (1000000000::hugeint * (f.lang_c + 2)) // (n.size + 2 * n.v) as q
    from full_counts f join n using (lang)
), pair_sums as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
    select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pair_sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), ranked as (
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
    union all
    select * from (
        select lang, source, 'term', term, value, row_number() over (partition by lang, source order by value desc, term) as rank
        from (select lang, source, term, ((p - q) * (p - q)) // (p + q) as value from p where c > 0 and p > q)
    ) where rank <= 10
)
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked
"""
