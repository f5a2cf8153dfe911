"""Operator 7: language identification by cross-parsing entropy with suffix automata."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.samples import remainder
from concordat.llm.text import LETTER, classes, code_points, sums_by_row
from concordat.llm.bpe import text_groups

#: The most learned rows and code points of a language, and the longest stretch of a row.
ROWS, CHARS, LONGEST = 200, 24_000, 4_000
#: Symbols with a dense table: one for all that is no letter, one for letters not learned, the rest for the
#: most frequent letters. Other learned letters have symbols from here on, and sorted keys.
SYMBOLS = 64
#: Code points of a stretch. The stretches of a long text are parsed side by side and then joined, so that
#: phrases go over their borders as in one parse.
STRETCH = 1024


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a symbol sequence; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


def dealt(texts: list[str], most: int = CHARS) -> str:
    """The texts joined by spaces, at most ``most`` code points with them: of long texts equal shares, of shorter ones all."""
    left, share = most - len(texts), 0
    for k, n in enumerate(sorted(map(len, texts))):
        share = max(0, left) // (len(texts) - k)
        if n > share:
            break
        left -= n
        share = n
    return " ".join(t[:share] for t in texts)


class Parser:
    """Cross-parses texts by the learned text of every language at once."""

    def __init__(self, learned: dict[str, list[str]]):
        self.langs = sorted(learned)
        fixed = {lang: dealt(learned[lang]) for lang in self.langs}
        counts = Counter(c for text in fixed.values() for t in text for c in t.lower() if c.isalpha())
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[classes() == LETTER] = 1
        for k, c in enumerate(letters, 2):
            self.symbol[ord(c)] = k
            for other in {c.upper(), c.title()}:
                if len(other) == 1 and other.lower() == c:
                    self.symbol[ord(other)] = k
        self.size = max(SYMBOLS, len(letters) + 2)
        tables, roots, keys, values, at = [], [], [], [], 0
        self.restarts = np.zeros((len(self.langs), self.size - SYMBOLS), np.int32)
        for k, lang in enumerate(self.langs):
            to = automaton(self.symbol[code_points(fixed[lang])])
            edges = np.array([(i, c, j) for i, own in enumerate(to) for c, j in own.items()], np.int64).reshape(-1, 3)
            dense = edges[edges[:, 1] < SYMBOLS]
            full = np.full((len(to), SYMBOLS), -1, np.int64)
            full[dense[:, 0], dense[:, 1]] = dense[:, 2]
            # Where a match ends, a new phrase starts at the root with the same symbol, or after it.
            restart = np.where(full[0] >= 0, full[0], 0)
            ends = full < 0
            tables.append((np.where(ends, restart, full) + at) * 2 + ends)
            rare = edges[edges[:, 1] >= SYMBOLS]
            keys.append((rare[:, 0] + at) * self.size + rare[:, 1])
            values.append(rare[:, 2] + at)
            self.restarts[k] = at
            from_root = rare[rare[:, 0] == 0]
            self.restarts[k, from_root[:, 1] - SYMBOLS] = from_root[:, 2] + at
            roots.append(at)
            at += len(to)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int64)
        # A last key that no state has, so that every search ends at a key.
        self.keys = np.concatenate([*keys, np.full(1, np.iinfo(np.int64).max)])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.values = self.keys[order], np.concatenate([*values, np.zeros(1, np.int64)])[order]

    def _step(self, state: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Twice the next state of each language (first axis) by its symbol, plus 1 where a phrase ends before it."""
        got = self.table[state * SYMBOLS + np.minimum(own, SYMBOLS - 1)]
        rare = np.flatnonzero(own >= SYMBOLS)
        if len(rare):
            key = state[:, rare] * self.size + own[rare]
            place = np.searchsorted(self.keys, key)
            known = self.keys[place] == key
            got[:, rare] = np.where(known, self.values[place] * 2, self.restarts[:, own[rare] - SYMBOLS] * 2 + 1)
        return got

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of phrases of each row's symbols in each language's parse; 0 for an empty row."""
        n = len(self.langs)
        lens = np.diff(offsets)
        pieces = -(-lens // STRETCH)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(pieces)])
        row = np.repeat(np.arange(len(lens)), pieces)
        starts = offsets[:-1][row] + (np.arange(len(row)) - bounds[:-1][row]) * STRETCH
        width = np.minimum(STRETCH, offsets[1:][row] - starts)
        order = np.argsort(-width, kind="stable")
        symbols = self.symbol[codes]
        # Each stretch on its own, from the root.
        ends, count = np.repeat(self.roots[:, None], len(row), 1), np.zeros((n, len(row)), np.int64)
        left = width[order]
        live_at = np.searchsorted(-left, -np.arange(STRETCH), "left")
        state, splits = ends.copy(), count.copy()
        for k in range(int(left[0]) if len(left) else 0):
            live = int(live_at[k])
            got = self._step(state[:, :live], symbols[starts[order[:live]] + k])
            splits[:, :live] += got & 1
            state[:, :live] = got >> 1
        ends[:, order], count[:, order] = state, splits
        count += self._joined(symbols, starts, width, row, ends)
        return np.stack([sums_by_row(count[k], bounds) + (lens > 0) for k in range(n)], 1) if n else np.zeros((len(lens), 0), np.int64)

    def _joined(self, symbols: np.ndarray, starts: np.ndarray, width: np.ndarray, row: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What goes to each stretch's ends of phrases when it goes on from the stretch before it, not from the root.

        The two parses are stepped side by side until they are in the same state, from where on they are one.
        A stretch in which they never meet ends in another state than ``ends`` (updated here), so the next
        one is stepped again from that.
        """
        more = np.zeros(ends.shape, np.int64)
        due = np.flatnonzero(row[1:] == row[:-1]) + 1
        alone = ends.copy()
        while len(due):
            at, went, own, diff = due, ends[:, due - 1], np.repeat(self.roots[:, None], len(due), 1), np.zeros((len(ends), len(due)), np.int64)
            moved: list[np.ndarray] = []
            for k in range(int(width[due].max())):
                over = k >= width[at]
                apart = (went != own).any(axis=0)
                done = over | ~apart
                if done.any():
                    more[:, at[done]] = diff[:, done]
                    new = np.where(went != own, went, alone[:, at])[:, done] if over.any() else alone[:, at[done]]
                    moved.append(at[done][(new != ends[:, at[done]]).any(axis=0)])
                    ends[:, at[done]] = new
                    at, went, own, diff = at[~done], went[:, ~done], own[:, ~done], diff[:, ~done]
                    if not len(at):
                        break
                symbol = symbols[starts[at] + k]
                a, b = self._step(went, symbol), self._step(own, symbol)
                diff += (a & 1).astype(np.int64) - (b & 1)
                went, own = a >> 1, b >> 1
            if len(at):
                more[:, at] = diff
                new = np.where(went != own, went, alone[:, at])
                moved.append(at[(new != ends[:, at]).any(axis=0)])
                ends[:, at] = new
            after = np.concatenate(moved) + 1 if moved else np.zeros(0, np.int64)
            after = after[after < len(row)]
            due = np.unique(after[row[after] == row[after - 1]])
        return more

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score is the share of the likelihood over the parse lengths."""
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        codes = code_points("".join(texts))
        letters = sums_by_row(classes()[codes] == LETTER, offsets)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        found = self.phrases(codes, offsets) / np.maximum(1, np.diff(offsets))[:, None]
        best = found.argmin(1)
        # Phrases per code point, against the best: relative excess, turned into shares.
        ratio = np.exp(-20 * (found / np.maximum(found.min(1, keepdims=True), 1e-9) - 1))
        score = np.where(letters > 0, 1 / ratio.sum(1), 0.0)
        return [self.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist())], score


@lru_cache(2)
def _parser(key: str, learned: tuple[tuple[str, tuple[str, ...]], ...]) -> Parser:
    return Parser({lang: list(texts) for lang, texts in learned})


def learned_texts(docs: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> dict[str, list[str]]:
    """At most ``rows`` texts of each language of ``docs(doc_id, text, lang)``: those of least hash, of each a stretch of at most ``longest`` code points.

    A longer text's stretch starts at a place drawn by its hash.

    Rows are thinned by their hash to about four times the number before they are ranked, so no task ranks a
    whole language. One count for each language reaches the driver before the texts.
    """
    docs = docs.where("text is not null and lang is not null").where("text <> ''")
    docs = docs.withColumn("h", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)))
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    bounds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 40, (1 << 42) * rows // n))])
    thinned = docs.where(F.col("h") < F.element_at(bounds, F.col("lang")))
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - longest, F.lit(0)) + 1) + 1
    thinned = thinned.withColumn("text", F.substring("text", start.cast("int"), F.lit(longest)))
    top = F.expr(f"slice(array_sort(collect_list(struct(h, text))), 1, {rows})")
    out = thinned.groupBy("lang").agg(top.alias("top")).collect()
    return {r["lang"]: [x["text"] for x in r["top"]] for r in out}


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs``.

    A suffix automaton of each language's learned text gives, at every place of a text, the longest match;
    the whole text is parsed greedily into such phrases (every learned letter is a symbol of its own), and
    the language with the fewest for a code point wins (ties: the first by name). Learned from are at most
    ROWS rows of a language, LONGEST code points in a stretch of each and CHARS in all, dealt evenly over these
    rows, with a text and language and crc32(doc_id as text) mod 5 other than 0; rows with a null id are never learned from.
    Texts without a letter, empty and null ones are ``und`` with score 0; without learned rows, all are.
    Texts of any length are parsed as a whole, in time in proportion to it. Null and repeated ids are
    returned as they are; other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    learned = learned_texts(rows.where(~held & F.col("doc_id").isNotNull()))
    fixed = tuple(sorted((lang, tuple(texts)) for lang, texts in learned.items()))
    key = hashlib.md5(repr(fixed).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(key, shared.value)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(2).to_pylist(), 1 << 22):
                lang, score = parser.predict(group)
                cols = [batch.column(k).slice(at, len(group)) for k in range(2)]
                at += len(group)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
