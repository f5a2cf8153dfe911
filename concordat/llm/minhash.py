"""Operator 4: near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature is ``CHUNKS * WIDTH`` MinHash values, of each the lowest 10 bits. The distance of two
signatures is the number of values in which they differ. The index splits signatures into CHUNKS
chunks of WIDTH values. Two signatures that differ in fewer than CHUNKS * 2 values have, by
pigeonhole, a chunk with one error at most, and so agree on that chunk with some one value left
out. Those reduced chunks are the keys of the join: CHUNKS * WIDTH for each document, and no pair
within the distance is missed. A pair of similarity 0.8 differs in a fifth of the values on average;
that each of the 15 chunks of 6 has two errors or more has a chance of 1e-7. At a similarity of 0.05,
as of texts that share a passage, one pair in 50,000 meets in a bucket. Every link is then confirmed
on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.stage import discard, table
from concordat.llm.text import ASCII_LOWER, U, blocks, mix, pair_hashes, span_hashes, word_spans
from concordat.llm.union import components

CHUNKS, WIDTH, BITS = 15, 6, 10
#: Members of a bucket that one task compares with each other at once; larger ones are compared by blocks.
BLOCK_NODES = 256
_SEEDS = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | U(1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's shingles of so many words, A-Z in lower case.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    for _, _, data, offsets in blocks(column):
        data = ASCII_LOWER[data]
        starts, ends, bounds = word_spans(data, offsets)
        own = span_hashes(data, starts, ends)
        rolled = own
        for k in range(1, words):
            rolled = pair_hashes(rolled[: len(own) - k], own[k:])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            else:
                short = own[a : a + 1]
                for k in range(a + 1, b):
                    short = pair_hashes(short, own[k : k + 1])
                yield short


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, as sets take several times the room of their texts."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS integers of WIDTH values of BITS bits each."""
    low = np.full(CHUNKS * WIDTH, ~U(0), U)
    for lo in range(0, len(shingles), 4096):
        part = shingles[lo : lo + 4096]
        low = np.minimum(low, ((part[:, None] ^ _SEEDS) * _ODD).min(0))
    values = (mix(low) & U((1 << BITS) - 1)).reshape(CHUNKS, WIDTH)
    return (values << (U(BITS) * np.arange(WIDTH, dtype=U))).sum(1, dtype=U)


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, c0, c1, ...) of each row; equal sets have equal set_a and set_b."""
    chunk_names = [f"c{k}" for k in range(CHUNKS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sets = list(shingle_sets(batch.column(1), words))
            n = len(sets)
            marks = np.zeros((n, 2 + CHUNKS), U)
            for k, s in enumerate(sets):
                marks[k, 0] = s.sum(dtype=U)
                marks[k, 1] = np.bitwise_xor.reduce(mix(s ^ U(0xA0761D6478BD642F))) if len(s) else 0
                marks[k, 2:] = signature(s)
            cols = [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            cols += [pa.array(np.ascontiguousarray(marks[:, k]).view(np.int64)) for k in range(2 + CHUNKS)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_a", "set_b", *chunk_names])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"{c} long" for c in chunk_names)
    return rows.mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]
            lo, size = 0, 0
            for hi, s in enumerate(sets, 1):  # small batches, as sets take more room than texts
                size += len(s)
                if size > 1 << 19 or hi == len(sets):
                    cols = [batch.column(0).slice(lo, hi - lo), pa.array(sets[lo:hi], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "shingles"])
                    lo, size = hi, 0

    return docs.select("doc_id", "text").mapInArrow(run, "node long, shingles array<long>")


def keys_of(nodes: DataFrame) -> DataFrame:
    """(key, node, n): one key for each value that may differ in each chunk."""
    keys = []
    for c in range(CHUNKS):
        for v in range(WIDTH):
            mask = ((1 << BITS * WIDTH) - 1) ^ (((1 << BITS) - 1) << (BITS * v))
            keys.append(F.xxhash64(F.lit(c * WIDTH + v), F.col(f"c{c}").bitwiseAND(F.lit(mask))))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "n")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' intersection is at least ``percent`` of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _links_within(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs of places of ``nodes``, under different roots, whose sets are alike enough.

    Intersections of all pairs are one matrix product over the shingles that two of the sets share. Of the
    links found, those of a spanning forest are returned: fewer than there are nodes, and as connected.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        shared = np.array([[0, both], [both, 0]])
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(np.concatenate(sets), kind="stable")
        ranked, owner = np.concatenate(sets)[order], owner[order]
        first = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] - 1) != 0)
        runs = np.diff(np.append(first, len(ranked)))
        column = np.repeat(np.cumsum(runs > 1) - 1, runs)
        keep = np.repeat(runs > 1, runs)
        column, owner = column[keep], owner[keep]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, (1 << 22) // len(sets))
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (lo, lo + width))
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            shared += part @ part.T
        shared = shared.astype(np.int64)
    alike = 100 * shared >= percent * (sizes[:, None] + sizes - shared)
    alike &= (roots[:, None] != roots) & (nodes[:, None] != nodes)
    forest, fresh = [], np.ones(len(nodes), bool)
    for seed in np.flatnonzero(alike.any(1)).tolist():
        if not fresh[seed]:
            continue
        fresh[seed], reached = False, [seed]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(alike[at] & fresh)
            fresh[new] = False
            reached += new.tolist()
            forest += [(at, n) for n in new.tolist()]
    return np.array(forest, np.int64).reshape(-1, 2)


def confirm_groups(rows: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among the nodes of each group of ``rows(grp, node, root, shingles)``.

    Groups are bounded by 2 * BLOCK_NODES; a task walks through its groups in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [], [], [])

        def close(group: tuple) -> list[tuple[int, int]]:
            nodes, roots = np.array(group[1]), np.array(group[2])
            if len(nodes) < 2:
                return []
            found = nodes[_links_within(nodes, roots, group[3], percent)]
            return [(min(a, b), max(a, b)) for a, b in found.tolist()]

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            pairs: list[tuple[int, int]] = []
            lists = batch.column(3)
            flat, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for k, (grp, node, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if grp != held[0]:
                    pairs += close(held)
                    held = (grp, [], [], [])
                held[1].append(node)
                held[2].append(root)
                held[3].append(flat[offsets[k] : offsets[k + 1]].copy())
            yield out(pairs)
        yield out(close(held))

    ordered = rows.select("grp", "node", "root", "shingles").repartition("grp").sortWithinPartitions("grp")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def groups_of(members: DataFrame, spare: list[DataFrame]) -> DataFrame:
    """(grp, node, root): bounded groups in which any two nodes that share a key of ``members`` meet.

    Keys with the same members count once. A key of up to BLOCK_NODES members is a group. Larger ones are
    put together with those that they share nodes with, so that a pair of a large group of near copies,
    which share very many keys, is compared once; such a cluster is cut into blocks by hash, and each
    pair of blocks is a group. Tables that the result reads are added to ``spare``.
    """
    profile = members.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"), F.min("node").alias("low"))
    profile = table(profile.groupBy("k", "h", "low").agg(F.min("key").alias("key")), "open-profiles")
    spare.append(profile)
    once = members.join(profile.select("key", "k", "low"), "key")
    small = once.where(F.col("k") <= BLOCK_NODES).select(F.xxhash64(F.lit(0), "key").alias("grp"), "node", "root")
    large = once.where(F.col("k") > BLOCK_NODES)
    if large.isEmpty():
        return small
    clusters = components(large.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()).withColumnRenamed("root", "cluster")
    clusters = table(clusters, "clusters")
    spare.append(clusters)
    counts = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("parts"))
    roots = large.select("node", "root").distinct()
    placed = clusters.join(counts, "cluster").join(roots, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grp = F.xxhash64(F.lit(1), "cluster", F.least("own", "other"), F.greatest("own", "other"))
    return small.unionByName(dealt.select(grp.alias("grp"), "node", "root"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Rows with equal sets form a class, of which only the smallest id takes part in the join. In each
    bucket of the index, first every member is compared with the smallest one, then with one drawn by
    hash: a large group of near copies costs a few comparisons for each member. Then the members of
    buckets with several components left are all compared across components, in bounded groups, so
    no link between different components is left out.

    Rows with null or empty texts, or without words, have no shingles and link with nothing. Rows of
    the same id are one node. A row with a null id links only with rows of an equal set; it is kept
    if there is none with an id. Texts may be of any length; other columns are not read. An empty table
    gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = table(signatures(rows, words), "signatures")
    same = ["set_a", "set_b", "n_shingles"]
    chunk_names = [f"c{k}" for k in range(CHUNKS)]
    classes = signed.where("n_shingles > 0").groupBy(*same)
    classes = classes.agg(F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in chunk_names])
    classes = table(classes.where("node is not null"), "classes")

    keys = keys_of(classes.select("node", F.col("n_shingles").alias("n"), *chunk_names))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    shared = table(keys.join(met, "key"), "shared-keys")
    needed = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = table(full_sets(rows.join(needed, "doc_id", "left_semi"), words), "sets")
    fits = F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")

    def with_first(members: DataFrame, order: list) -> DataFrame:
        """Each member of a key with the key's first one, as (a, b), if their components and sizes allow a new link."""
        lead = members.groupBy("key").agg(F.min(F.struct(*order, "node", "n", "root")).alias("lead"))
        both = members.join(lead, "key").where(F.col("root") != F.col("lead.root"))
        both = both.select(F.col("lead.node").alias("a"), F.col("lead.n").alias("a_n"), F.col("node").alias("b"), F.col("n").alias("b_n"))
        return both.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def still_open(roots: DataFrame) -> DataFrame:
        """The members of keys with more than one component."""
        members = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_keys = members.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
        return table(members.join(open_keys.select("key"), "key").select("key", "node", "n", "root"), "open-keys")

    def kept_until_the_end(df: DataFrame, name: str) -> DataFrame:
        spare.append(table(df, name))
        return spare[-1]

    spare = [shared, sets]
    links = kept_until_the_end(confirm(with_first(shared.withColumn("root", F.col("node")), []), sets, percent), "links")
    members = still_open(kept_until_the_end(components(links), "roots"))
    links = links.unionByName(kept_until_the_end(confirm(with_first(members, [F.xxhash64("node", "key")]), sets, percent), "links"))
    discard(members)
    members = still_open(kept_until_the_end(components(links), "roots"))
    links = links.unionByName(kept_until_the_end(confirm_groups(groups_of(members, spare).join(sets, "node"), percent), "links"))
    roots = table(components(links), "roots")
    discard(members, *spare)

    out = signed.join(classes.select(*same, "node"), same, "left")
    out = out.join(roots.select(F.col("node"), "root"), "node", "left")
    component = F.coalesce("root", "node", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )
