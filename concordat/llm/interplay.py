"""Operator 12: what each of five filters removes, in every order of applying them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters by letter; filter k is bit k of a coalition.
FILTERS = "ABCDE"
#: A document fails with fewer words, with a smaller percentage of different words, or a larger one of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
_WORD, _SYMBOL = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
_COPY = FILTERS.index("E")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n = F.size(words).cast("long")
    tests = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.length(text),
        text.rlike(_SYMBOL),
    )
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests[1:], 1)), F.when(tests[0], 1).otherwise(0)).cast("int")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of ``mask``.

    Copies are told by the SHA-256 of the whole text. Rows are first counted by text and id, then by text
    and part, so a text with many copies, or an id of many rows, is a few rows wherever it is read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    part = F.coalesce(docs[part_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), part.alias("part"), failures(docs[text_col]).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("is_good"), F.max((F.col("toxic") == 1).cast("long")).alias("is_toxic"))
    # Rows without an id have no labels; a second key deals them over all tasks.
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).otherwise(0)
    rows = rows.withColumn("spread", spread).join(marked.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left").drop("spread")
    weighed = [F.col("n"), F.col("n") * F.coalesce("is_good", F.lit(0)), F.col("n") * F.coalesce("is_toxic", F.lit(0))]
    names = ("n", "good", "toxic")
    rows = rows.select("digest", "id", "part", "mask", F.struct(*[c.alias(x) for c, x in zip(weighed, names, strict=True)]).alias("w"))

    # Of a text's rows with an id, all but those of the smallest one are copies.
    with_id = F.col("id").isNotNull()
    texts = rows.groupBy("digest", "part", "mask").agg(
        *[F.sum(f"w.{x}").alias(x) for x in names],
        *[F.sum(F.when(with_id, F.col(f"w.{x}")).otherwise(0)).alias(f"own_{x}") for x in names],
        F.min(F.when(with_id, F.struct("id", "w"))).alias("low"),
    )
    first = F.min("low.id").over(Window.partitionBy("digest"))
    lead = F.col("low.id") == first
    texts = texts.withColumn("lead", F.coalesce(lead, F.lit(False)))
    copies = {x: F.col(f"own_{x}") - F.when(F.col("lead"), F.col(f"low.w.{x}")).otherwise(0) for x in names}
    texts = texts.select("part", "mask", *names, *[c.alias(f"copy_{x}") for x, c in copies.items()])
    sides = F.explode(F.array(
        F.struct(F.col("mask"), *[(F.col(x) - F.col(f"copy_{x}")).alias(x) for x in names]),
        F.struct((F.col("mask") + (1 << _COPY)).alias("mask"), *[F.col(f"copy_{x}").alias(x) for x in names]),
    )).alias("s")
    return texts.select("part", sides).groupBy("part", "s.mask").agg(*[F.sum(f"s.{x}").alias(x) for x in names])


@cache
def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders, and for each order and step the filter's bit and the coalition applied before it."""
    names = ["".join(p) for p in permutations(FILTERS)]
    bits = np.array([[1 << FILTERS.index(c) for c in name] for name in names])
    return names, bits, np.cumsum(bits, axis=1) - bits


def coalitions(counts: np.ndarray) -> np.ndarray:
    """How many documents each coalition removes: those that fail one of its filters. ``counts``: by mask, last axis."""
    all_of = np.arange(counts.shape[-1])
    meets = (all_of[:, None] & all_of[None, :]) > 0
    return counts @ meets.astype(np.int64)


def potentials(game: np.ndarray) -> np.ndarray:
    """|S|! times the potential of each coalition S, last axis.

    The potential P is 0 without players and else the mean, over the coalition's players, of P without the
    player, plus the game's value by size. Times |S|! it is a whole number, so no rounding enters.
    """
    out = np.zeros_like(game)
    for s in sorted(range(1, game.shape[-1]), key=int.bit_count):
        members = [b for b in (1 << k for k in range(s.bit_length())) if s & b]
        out[..., s] = factorial(len(members) - 1) * game[..., s] + sum(out[..., s - b] for b in members)
    return out


def steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of SCHEMA by order and step, each an array (parts, orders, steps), from counts (parts, 3, masks)."""
    game = coalitions(counts)
    _, bits, before = _orders()
    docs, good, toxic = game[:, 0], game[:, 1], game[:, 2]
    grand = (1 << len(FILTERS)) - 1
    removed = docs[:, before + bits] - docs[:, before]
    # Shapley's value is the grand potential less the one without the player; all orders together are n! times that.
    scaled = potentials(docs)
    value = scaled[:, [grand]] - len(FILTERS) * scaled[:, grand - (1 << np.arange(len(FILTERS)))]
    return {
        "kept": counts[:, 0].sum(axis=1)[:, None, None] - docs[:, before + bits],
        "removed": removed,
        "redundant": docs[:, bits] - removed,
        "unique_fails": docs[:, [[grand]]] - docs[:, grand - bits],
        "good_lost": good[:, before + bits] - good[:, before],
        "toxic_lost": toxic[:, before + bits] - toxic[:, before],
        "shapley": value[:, np.log2(bits).astype(int)],
    }


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, bits, _ = _orders()
    shape = bits.shape
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros((1, 3, 1 << len(FILTERS)), np.int64)
            for cell in row["cells"]:
                counts[0, :, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            columns = {"part": pa.array([row["part"]] * bits.size), "filter_order": pa.array(np.repeat(names, shape[1]).tolist())}
            columns["step"] = pa.array(np.tile(np.arange(1, shape[1] + 1, dtype=np.int32), shape[0]))
            columns |= {k: pa.array(v.ravel()) for k, v in steps(counts).items()}
            yield pa.RecordBatch.from_pydict(columns)


def filter_interplay(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter removes in each part at each step of each order of the five filters: SCHEMA, 600 rows a part.

    All documents of a part that fail the same filters are one of 32 counts, from which the removal game's
    value of every coalition follows; a step's counts are differences of coalitions, and a filter's total
    over all orders comes from the potentials of all coalitions.

    Null texts are empty (they fail A only, and E as copies), a null part is ''. A row without an id is no
    copy and makes none; rows of one id and text are not copies of each other. An id with several labels
    is good, or toxic, if one of them says so. Texts may be of any length; other columns are not read. An
    empty table gives no rows.
    """
    counts = failure_counts(docs, labels, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_report, SCHEMA)


#: The same for DuckDB, where each order's steps are counted and added up.
SQL = r"""
with t as (
    select doc_id, coalesce(text, '') as text, coalesce(source, '') as part,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
), m as (
    select text as copied, min(doc_id) as low from t group by text
), l as (
    select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id
), f as (
    select t.part,
           (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
           + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
           + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(t.doc_id > m.low, false)::int as mask,
           coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic
    from t join m on t.text = m.copied left join l on t.doc_id = l.doc_id
), h as (
    select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all
), x as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as c
), o as (
    select a.c || b.c || c.c || d.c || e.c as filter_order from x a, x b, x c, x d, x e
    where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s as (
    select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as bit,
           list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) as had
    from (select filter_order, unnest(range(1, 6)) as step from o)
), r as (
    select part, filter_order, step, bit,
           sum(n) filter (where mask & (coalesce(had, 0) | bit) = 0) as kept,
           sum(n) filter (where mask & coalesce(had, 0) = 0 and mask & bit <> 0) as removed,
           sum(n) filter (where mask & coalesce(had, 0) <> 0 and mask & bit <> 0) as redundant,
           sum(n) filter (where mask = bit) as unique_fails,
           sum(good) filter (where mask & coalesce(had, 0) = 0 and mask & bit <> 0) as good_lost,
           sum(toxic) filter (where mask & coalesce(had, 0) = 0 and mask & bit <> 0) as toxic_lost
    from h cross join s group by all
)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from r
"""
