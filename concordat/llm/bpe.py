"""Operator 3: byte-pair encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concordat.llm.pieces import PieceTable, word_bpe_spans
from concordat.llm.text import BLOCK, code_points

_NONE = 1 << 62


def merge_with_tree(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges adjacent symbols, always the leftmost pair of lowest rank, until none has a rank.

    Leaf i of the tree holds (rank of the pair that starts at symbol i, i) as one integer; each
    inner node holds the smaller of its two children, so the root is the next merge. A merge
    changes at most three leaves, each updated along one path to the root.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    get = ranks.get
    shift = n.bit_length()
    for i in range(n - 1):
        r = get((symbols[i], symbols[i + 1]))
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = list(symbols)
    mask = (1 << shift) - 1

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            value = value if value < other else other
            if tree[k] == value:
                return
            tree[k] = value

    def rank(i: int, j: int) -> int:
        r = get((symbols[i], symbols[j]))
        return _NONE if r is None else r << shift | i

    while tree[1] < _NONE:
        i = tree[1] & mask
        j = after[i]
        symbols[i] += symbols[j]
        symbols[j] = ""
        k = after[i] = after[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, rank(i, k))
        else:
            put(i, _NONE)
        if before[i] >= 0:
            put(before[i], rank(before[i], i))
    return [s for s in symbols if s]


class WordBpe:
    """A tokenizer file of the word-end kind: NFC, white space as one separator, lower case, byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Byte symbols: printable Latin-1 stands for itself, the rest for code points from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.symbol = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.table = PieceTable(self.encode_pieces)
        self.names = np.full(max([*self.vocab.values(), *self.special.values()]) + 1, None, object)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = token

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        out = []
        for piece in pieces:
            symbols = [self.symbol[b] for b in piece.encode()]
            symbols[-1] += self.suffix
            merged = merge_with_tree(symbols, self.ranks)
            out.append([self.vocab[s] for s in merged if s in self.vocab])
        return out

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case code point by code point (a final sigma is no special case)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        texts = [self.normal(t) for t in texts]
        whole = "".join(texts)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
        codes = code_points(whole)
        ids, bounds = self.table.tokens(whole, codes, word_bpe_spans(codes, offsets))
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; strings of special tokens in a text are those tokens."""
        if not self.split or not any(s in t for t in texts for s in self.special if "<" in t):
            return self._encode_plain(texts)
        parts = [self.split.split(t) if any(s in t for s in self.special) else [t] for t in texts]
        plain = iter(self._encode_plain([p for x in parts for p in x[::2]]))
        out = []
        for x in parts:
            mine = [next(plain) if k % 2 == 0 else np.array([self.special[p]], np.uint32) for k, p in enumerate(x)]
            out.append(mine[0] if len(mine) == 1 else np.concatenate(mine))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces: the file names no decoder, so word ends stay visible. Unknown ids are skipped."""
        names = self.names[ids[ids < len(self.names)]].tolist()
        return " ".join(names) if None not in names else " ".join(n for n in names if n is not None)


@lru_cache(4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def text_groups(texts: list[str | None], limit: int = BLOCK) -> Iterator[list[str]]:
    """Neighbouring texts of about ``limit`` code points together; null is empty."""
    group, size = [], 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``full`` also ids and decoded.

    A null text counts as empty and gives no tokens; ids of rows, null ones too, are returned as they are.
    Repeated rows give repeated results; an empty table gives none. Texts of any length are encoded whole,
    piece by piece; other columns are not read, so their names don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1).to_pylist()):
                encoded = bpe.encode(group)
                decoded = [bpe.decode(x) for x in encoded]
                raw = [x.astype("<u4").tobytes() for x in encoded]
                cols = [
                    batch.column(0).slice(at, len(group)),
                    pa.array([len(x) for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if full:
                    cols += [pa.array(encoded, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                at += len(group)
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if full else 4]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>, decoded string" if full else ""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
