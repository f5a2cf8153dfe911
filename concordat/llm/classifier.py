"""Operator 6: a quality classifier on random-indexing word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.samples import least_hashed, remainder
from concordat.llm.stage import fewer_tasks, free_names, types_of
from concordat.llm.text import U, blocks, mix, rows_of, span_hashes, sums_by_row, token_spans

#: Hashed words, dimensions and non-zero entries of an index vector, neighbours on each side.
WORDS, DIMS, ENTRIES, REACH = 1 << 13, 32, 2, 2
#: The most labelled rows that the network learns from.
LEARNED = 20_000
HIDDEN = 48
#: Features of a text: mean and deviation in each dimension; likeness of neighbouring words, size of the mean, log of the length.
FEATURES = 2 * DIMS + 3
_BLOCK = 1 << 19


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each hashed word's index vector."""
    h = mix(np.arange(WORDS * ENTRIES, dtype=U) + U(0x51ED270B)).reshape(WORDS, ENTRIES)
    return (h % U(DIMS)).astype(np.int64), np.where(h >> U(63), 1, -1)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = token_spans(data, offsets)
    return (span_hashes(data, starts, ends) & U(WORDS - 1)).astype(np.int64), bounds


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Each hashed word's sum of its neighbours' index vectors over the whole corpus ``docs(text)``.

    A task adds up its own part as one matrix of fixed size; these are summed by word. The result
    has WORDS rows of DIMS integers, whatever the corpus.
    """
    places, signs = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORDS * DIMS)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), _BLOCK):
                words, bounds = hashed_words(data, offsets)
                row = rows_of(bounds)
                for reach in range(1, REACH + 1):
                    near = np.flatnonzero(row[reach:] == row[:-reach])
                    a, b = words[near], words[near + reach]
                    for k in range(ENTRIES):
                        total += np.bincount(a * DIMS + places[b, k], signs[b, k], WORDS * DIMS)
                        total += np.bincount(b * DIMS + places[a, k], signs[a, k], WORDS * DIMS)
        sums = total.reshape(WORDS, DIMS).astype(np.int64)
        seen = np.flatnonzero(sums.any(1))
        cols = [pa.array(seen, pa.int32())] + [pa.array(np.ascontiguousarray(sums[seen, d])) for d in range(DIMS)]
        yield pa.RecordBatch.from_arrays(cols, ["word", *(f"v{d}" for d in range(DIMS))])

    schema = "word int, " + ", ".join(f"v{d} long" for d in range(DIMS))
    rows = fewer_tasks(docs.select("text"), docs.select("text")).mapInArrow(run, schema).groupBy("word").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)]).collect()
    out = np.zeros((WORDS, DIMS))
    for r in rows:
        out[r["word"]] = r[1:]
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Context vectors of length 1, without what all words have in common."""
    size = np.linalg.norm(contexts, axis=1, keepdims=True)
    unit = contexts / np.maximum(size, 1e-9)
    seen = size[:, 0] > 0
    if seen.any():
        unit[seen] -= unit[seen].mean(0)
    return (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The features of each row of a block, as 4-byte floats: its words' vectors pooled.

    These are mean and standard deviation in each dimension, the mean product of neighbouring words' vectors
    (near 1 where a text repeats itself), the length of the mean vector and the log of the number of words.
    """
    words, bounds = hashed_words(data, offsets)
    n = np.maximum(1, np.diff(bounds))
    found = np.zeros((len(n), FEATURES), np.float32)
    row = rows_of(bounds)
    near = np.zeros(len(words))
    beside = np.flatnonzero(row[1:] == row[:-1])
    for d in range(DIMS):
        x = vectors[words, d].astype(np.float64)
        near[beside] += x[beside] * x[beside + 1]
        mean = sums_by_row(x, bounds) / n
        found[:, d] = mean
        found[:, DIMS + d] = np.sqrt(np.maximum(0, sums_by_row(x * x, bounds) / n - mean * mean))
    found[:, 2 * DIMS] = sums_by_row(near, bounds) / np.maximum(1, n - 1)
    found[:, 2 * DIMS + 1] = np.sqrt((found[:, :DIMS].astype(np.float64) ** 2).sum(1))
    found[:, 2 * DIMS + 2] = np.log1p(np.diff(bounds))
    return found


def pooled(docs: DataFrame, vectors: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, features) and the columns ``keep`` of each row of ``docs``, the features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                cols = [batch.column(0).slice(lo, hi - lo), pa.array([f.tobytes() for f in features(data, offsets, vectors)], pa.binary())]
                cols += [batch.column(2 + k).slice(lo, hi - lo) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "features", *keep])

    rows = docs.select("doc_id", "text", *keep)
    return rows.mapInArrow(run, ", ".join(["doc_id long, features binary", *types_of(docs, keep)]))


class Network:
    """Two layers: tanh, then one logit; its probabilities are calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 6, rounds: int = 1500, rate: float = 0.005, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-3
        z = (x - self.centre) / self.spread
        order = rng.permutation(len(y))
        held = order[: len(y) // 5]
        fit = order[len(y) // 5 :]
        self.w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w]
        for t in range(1, rounds + 1):
            own = fit if len(fit) <= 2048 else fit[rng.integers(0, len(fit), 2048)]
            a, target = z[own], y[own]
            h = np.tanh(a @ self.w[0] + self.w[1])
            error = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - target) / len(target)
            back = error[:, None] * self.w[2] * (1 - h * h)
            slopes = [a.T @ back + decay * self.w[0], back.sum(0), h.T @ error + decay * self.w[2], error.sum(keepdims=True)]
            for w, g, m in zip(self.w, slopes, moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                w -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            logit, target = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            losses = [np.mean(np.logaddexp(0, np.where(target > 0, -logit, logit) / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), FEATURES).astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, learned: int = LEARNED, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns ``keep`` of each row of ``docs``, the text among them if asked for.

    Word vectors come from all rows' texts. The network learns from at most ``learned`` rows that have a
    ``labels.quality`` and whose crc32(doc_id as text) mod 4 is not 2: those of least hash of the id. Only
    the text enters a score. Null and empty texts have features of zero and a score like the others;
    rows with a null id are never learned from. If the labels have one class or none, every score is
    the share of label 1 there, or 1 without any. Equal texts have equal scores, whatever their rows and
    neighbours. Columns of ``keep`` must not have a name of the result's; a clash is an error. An empty table
    gives no rows.
    """
    free_names(keep, "doc_id", "held_out", "score", "predicted")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep if c != text_col])
    vectors = word_vectors(context_vectors(rows))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = rows.where(~held & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("f")).join(one, "doc_id").distinct()
    # At most ``learned`` rows of three numbers: a fixed bound, so this side can be broadcast.
    chosen = F.broadcast(least_hashed(known, learned).select("doc_id", "f", "quality"))
    labelled = rows.select("doc_id", "text").withColumn("f", F.xxhash64("text")).join(chosen, ["doc_id", "f"])
    sample = pooled(labelled, vectors, ("f", "quality")).dropDuplicates(["doc_id", "f"]).orderBy(F.xxhash64("doc_id"), "doc_id", "features")
    sample = sample.select("quality", "features").toArrow()
    y = np.array(sample.column(0).to_pylist(), float)
    fixed = float(y.mean()) if len(y) else 1.0
    net = Network(_matrix(sample.column(1).combine_chunks()), y) if len(set(y.tolist())) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                own = batch.slice(lo, hi - lo)
                score = net.probabilities(features(data, offsets, vectors).astype(np.float64)) if net else np.full(hi - lo, fixed)
                cols = [own.column(0), own.column(1), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))]
                cols += [own.column(sent.index("text" if c == text_col else c)) for c in keep]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", *keep])

    schema = ", ".join(["doc_id long, held_out boolean, score double, predicted int", *types_of(docs, keep)])
    sent = ["doc_id", "held_out", "text", *(c for c in keep if c != text_col)]
    return rows.select("doc_id", held.alias("held_out"), "text", *sent[3:]).mapInArrow(run, schema)
