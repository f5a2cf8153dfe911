"""Operator 5: quality rules, with a hashed n-gram log-likelihood ratio of trusted text to the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.stage import discard, fewer_tasks, table
from concordat.llm.text import U, blocks, mix, pair_hashes, rows_of, span_hashes, sums_by_row, token_spans, word_spans

#: Buckets of hashed uni- and bigrams, and bins of values in a round of ``quantile``.
BUCKETS, BINS = 1 << 16, 4096
#: Share of the trusted rows that the threshold may reject.
LOSS = 0.002
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
WINDOW = 5


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, first n-gram of each row and the end): tokens and pairs of neighbours."""
    starts, ends, bounds = token_spans(data, offsets)
    own = span_hashes(data, starts, ends)
    pairs = pair_hashes(own[:-1], own[1:])
    row = rows_of(bounds)
    inside = row[:-1] == row[1:]
    all_rows = np.concatenate([row, row[:-1][inside]])
    order = np.argsort(all_rows, kind="stable")
    found = (np.concatenate([own, pairs[inside]]) & U(BUCKETS - 1)).astype(np.int64)[order]
    return found, np.searchsorted(all_rows[order], np.arange(len(offsets)))


def measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row of a block."""
    starts, ends, bounds = word_spans(data, offsets)
    n_rows = len(offsets) - 1
    heads = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    word_chars = sums_by_row(heads[ends] - heads[starts], bounds)
    n_symbols = sums_by_row(_SYMBOL[data], offsets)

    breaks = np.flatnonzero(data == 0x0A)
    line_from = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    row = np.searchsorted(offsets, line_from, "right") - 1
    # A break at the very end of a row opens an empty line, which has no word; it does no harm here.
    line_to = np.append(line_from[1:], len(data))
    line_to = np.where(np.isin(line_to - 1, breaks), line_to - 1, line_to)
    worded = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to, row = line_from[worded], line_to[worded], row[worded]
    keys = mix(span_hashes(data, line_from, line_to) ^ mix(row.astype(U) + U(1)))
    distinct = np.unique(keys, return_index=True)[1]
    n_dup = np.bincount(row, minlength=n_rows) - np.bincount(row[distinct], minlength=n_rows)

    own = span_hashes(data, starts, ends)
    n = len(own)
    repeated = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        rolled = own
        for k in range(1, WINDOW):
            rolled = pair_hashes(rolled[: n - k], own[k:])
        rows = rows_of(bounds)
        whole = np.flatnonzero(rows[: n - WINDOW + 1] == rows[WINDOW - 1 :])
        keys = mix(rolled[whole] ^ mix(rows[whole].astype(U) + U(1)))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = np.zeros(len(keys), bool)
        twin = ranked[1:] == ranked[:-1]
        same[1:] |= twin
        same[:-1] |= twin
        at = whole[order[same]]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + WINDOW, -1)
    n_repeat = sums_by_row((np.cumsum(repeated)[:n] > 0), bounds)
    return [np.diff(bounds), word_chars, n_symbols, n_dup, n_repeat]


def ngram_counts(docs: DataFrame, read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all rows of ``docs(text, trusted)``, made of those of ``read``, and over the trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for lo, hi, data, offsets in blocks(batch.column(0)):
                found, bounds = ngrams(data, offsets)
                total[0] += np.bincount(found, minlength=BUCKETS)
                chosen = found[trusted[lo:hi][rows_of(bounds)]]
                if len(chosen):
                    total[1] += np.bincount(chosen, minlength=BUCKETS)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[0][seen]), pa.array(total[1][seen])], ["bucket", "raw", "trusted"])

    parts = fewer_tasks(docs, read).mapInArrow(run, "bucket int, raw long, trusted long")
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], trusted[r["bucket"]] = r["raw"], r["trusted"]
    return raw, trusted


def log_ratio(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Log of trusted to raw probability of each bucket; the raw one, worth as many counts as there are buckets, smooths the trusted."""
    p = (raw + 1) / (raw.sum() + BUCKETS)
    q = (trusted + BUCKETS * p) / (trusted.sum() + BUCKETS)
    return np.log(q / p)


def quantile(values: DataFrame, share: float) -> float | None:
    """The exact ``share`` quantile of the one column of ``values``, interpolated between neighbours; None without values.

    Each round counts the values in equal bins and goes on within the bin that holds the rank, until all in
    it are equal: a task holds the counts of BINS bins, however many values there are.
    """
    x = F.col(values.columns[0])
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None
    place = (n - 1) * share
    rank, below = int(place), 0
    while low < high:
        # The least value is in the first bin and the greatest in the last, so every round leaves fewer.
        bin_of = F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("bin")
        found = values.where(x.between(low, high)).groupBy(bin_of).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for r in sorted(found.collect(), key=lambda r: r["bin"]):
            if below + r["n"] > rank:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    upto, after = values.agg(F.count_if(x <= low), F.min(F.when(x > low, x))).first()
    if upto > rank + 1 or after is None:
        return low
    return (rank + 1 - place) * low + (place - rank) * after


def counted(doc_id: Column) -> Column:
    """Whether a trusted row of this id makes up the trusted text, else it sets the threshold; false for a null id, which is never trusted."""
    return doc_id.isNotNull() & (F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(2)) == 0)


def quality_rules(docs: DataFrame, labels: DataFrame, loss: float = LOSS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, threshold, kept) of each row.

    llr is the mean log-likelihood ratio of a text's hashed n-grams under trusted text, to all rows' text.
    Trusted are all rows that ``labels.quality`` marks 1, an id with several labels by the least of them; each
    has a part: half of them, by hash of the id, make up the trusted text; the others, which it has not seen,
    set the threshold, as the exact ``loss`` quantile of those that pass the base rules. A row is kept if it
    passes these and its llr is at least the threshold. Without labels the ratio is 0 everywhere and nothing
    goes by it. Null and empty texts have zeros and fail the base rules. Ids, null ones too, are returned as
    they are; repeated rows count as often as they are there, and get the same verdict. An empty table gives
    no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    ids = table(one.where("label = 1").select("doc_id", F.lit(True).alias("trusted")), "trusted-ids")
    own = counted(F.col("doc_id"))
    # Trusted ids grow with the table, so they are shuffled at every size; of the texts only the half that can be counted goes with them.
    # As a table of their own they leave Spark free to deal the rows of an id that very many share over several tasks.
    good = ids.hint("merge")
    asked = rows.where(own).join(good, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    marked = asked.union(rows.where(~own).select("text", F.lit(False)))
    ratio = log_ratio(*ngram_counts(marked, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                found, bounds = ngrams(data, offsets)
                llr = sums_by_row(ratio[found], bounds) / np.maximum(1, np.diff(bounds))
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in measures(data, offsets)), pa.array(llr)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "llr"])

    scored = rows.mapInArrow(score, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", llr double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = table(scored.withColumn("base_failed", failed), "quality-scores")
    known = table(scored.where(~F.col("base_failed") & ~own).join(good, "doc_id").select("llr"), "trusted-scores")
    cut = quantile(known, loss)
    discard(known, ids)
    cut = 0.0 if cut is None else float(cut)
    verdict = ~F.col("base_failed") & (F.col("llr") >= cut)
    return scored.withColumn("threshold", F.lit(cut)).withColumn("kept", verdict)
