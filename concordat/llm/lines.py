"""Operator 2: removal of repeated passages, as overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.stage import table

WINDOW = 3
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(line: Column) -> Column:
    """The line without white space at its ends."""
    return F.trim(line, F.lit(_BLANK))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) and the columns ``keep`` of each row of ``docs``, without the lines of repeated passages.

    A window is three consecutive lines of a text that are not blank, blank ones between them
    skipped, compared without white space at their ends. Of equal windows in the whole corpus, the
    first by (doc_id, row, position) stays; the lines that any later one covers go, merged over
    overlapping windows. Each line that goes has an equal line at an earlier place, so one always
    stays. Texts with fewer than three such lines stay as they are, null texts too (0 lines).
    Each row is a document of its own: those with a null id come before all others, and rows of one id
    in the order of their row numbers, which are written once with the rows. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep])
    rows = table(rows.withColumn("__row", F.monotonically_increasing_id()), "lines")
    rows = rows.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    solid = F.filter(F.transform(_lines(F.col("text")), _solid), lambda x: x != "")
    lined = rows.select("__key", "__row", solid.alias("lines")).where(F.size("lines") >= WINDOW)

    def window(i: Column) -> Column:
        own = [F.element_at("lines", (i + k).cast("int")) for k in range(WINDOW)]
        # Two seeds make 128 bits, so that equal hashes mean equal lines at any size of corpus.
        return F.struct(F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(WINDOW), *own).alias("g"), i.alias("pos"))

    found = F.explode(F.transform(F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)), window)).alias("w")
    windows = lined.select("__key", "__row", found).select("__key", "__row", "w.h", "w.g", "w.pos")
    first = windows.groupBy("h", "g").agg(F.min(F.struct("__key", "__row", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = windows.join(first.where("n > 1").drop("n"), ["h", "g"]).where(F.struct("__key", "__row", "pos") > F.col("first"))
    covered = later.select("__row", F.explode(F.sequence("pos", F.col("pos") + WINDOW - 1)).alias("pos"))
    covered = covered.groupBy("__row").agg(F.collect_set("pos").alias("gone"))

    # Each line's number among the solid ones leads to its place among all; what isn't gone is put together
    # again by place. Every step is in proportion to the lines.
    cut = rows.join(covered, "__row", "left").withColumn("__lines", _lines(F.col("text")))
    places = F.filter(F.transform("__lines", lambda x, i: F.when(_solid(x) != "", i)), lambda i: i.isNotNull())
    cut = cut.withColumn("__places", F.when(F.col("gone").isNotNull(), places))
    gone = F.transform("gone", lambda k: F.get("__places", k - 1))
    cut = cut.withColumn("__kept", F.when(F.size("__places") > 0, F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)))
    left = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    return cut.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        *keep,
    )


#: The same rules for DuckDB. Ids and texts are not null there.
SQL = r"""
with l as (
    select doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid
    from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents)
), s as (
    select doc_id, i, solid, row_number() over (partition by doc_id order by i) as pos from l where solid <> ''
), w as (
    select doc_id, pos, solid as a, lead(solid) over d as b, lead(solid, 2) over d as c
    from s window d as (partition by doc_id order by pos)
), later as (
    select doc_id, pos from (
        select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as k from w where c is not null
    ) where k > 1
), gone as (
    select distinct s.doc_id, s.i from later join s on s.doc_id = later.doc_id and s.pos between later.pos and later.pos + 2
)
select l.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
       coalesce(string_agg(line, chr(10) order by l.i) filter (where gone.i is null), '') as text
from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i
group by l.doc_id
"""
