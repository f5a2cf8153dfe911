"""Operator 13: exact duplicates by Grace hash partitioning and tables of whole contents."""

from __future__ import annotations

import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.stage import table

#: Bytes of contents that a task's table holds, and the spill files that records beyond are dealt to.
HELD, FANOUT = 64 << 20, 16
#: Bytes that leave a task in one batch.
_OUT = 4 << 20
#: Spaces and runs that are not one space already.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


class Record(NamedTuple):
    """Rows of one content: its hash, the content, a name of these rows, their number, and the first of them."""

    hash: int
    content: bytes
    name: int
    n: int
    first: tuple[bool, int, int]  # has no id, id, row


class Contents:
    """An open-addressing table of contents with linear probing; two are the same only if all their bytes are."""

    def __init__(self, held: int):
        self.held, self.bytes = held, 0
        self.slots = array("q", [-1]) * 64
        self.hashes, self.n, self.names = array("q"), array("q"), []
        self.contents: list[bytes] = []
        self.firsts: list[tuple[bool, int, int]] = []

    def _slot(self, hash: int, content: bytes | None) -> int:
        """The slot of the content, or the free one where the search for it ends."""
        mask = len(self.slots) - 1
        at = hash & mask
        while (k := self.slots[at]) >= 0 and (content is None or self.hashes[k] != hash or self.contents[k] != content):
            at = (at + 1) & mask
        return at

    def place(self, r: Record) -> int:
        """The number of the record's content, -1 if it is new and the table is full. Any table takes one content."""
        at = self._slot(r.hash, r.content)
        k = self.slots[at]
        if k < 0:
            if self.contents and self.bytes + len(r.content) > self.held:
                return -1
            k = self.slots[at] = len(self.contents)
            self.hashes.append(r.hash)
            self.contents.append(r.content)
            self.n.append(r.n)
            self.firsts.append(r.first)
            self.names.append(array("q", [r.name]))
            self.bytes += len(r.content) + 256
            if 2 * len(self.contents) > len(self.slots):
                self.slots = array("q", [-1]) * (2 * len(self.slots))
                for i, h in enumerate(self.hashes):
                    self.slots[self._slot(h, None)] = i
            return k
        self.n[k] += r.n
        self.firsts[k] = min(self.firsts[k], r.first)
        return k


def settled(records: Iterable[Record], held: int = HELD, fanout: int = FANOUT, level: int = 0) -> Iterator[tuple[int, int, tuple[bool, int, int]]]:
    """(name, rows of its content, first of them) for each record.

    Contents that the table has no room for go to spill files by other bits of the hash at each level; a file
    is then a bucket of its own. Each bucket settles as many contents as its table holds, so the recursion ends
    even where all hashes are the same. The files are deleted with the bucket.
    """
    contents, files = Contents(held), {}
    with tempfile.TemporaryDirectory(prefix="buckets-") as folder:
        for r in records:
            k = contents.place(r)
            if k >= 0:
                if contents.names[k][-1] != r.name:
                    contents.names[k].append(r.name)
                continue
            part = (r.hash >> (4 * (level % 16))) % fanout
            if part not in files:
                files[part] = Path(folder, str(part)).open("wb")
            pickle.dump(tuple(r), files[part], pickle.HIGHEST_PROTOCOL)
        for f in files.values():
            f.close()
        for names, n, first in zip(contents.names, contents.n, contents.firsts, strict=True):
            yield from ((name, n, first) for name in names)
        del contents
        for part in files:
            yield from settled(_spilled(Path(folder, str(part))), held, fanout, level + 1)


def _spilled(path: Path) -> Iterator[Record]:
    with path.open("rb") as f:
        while True:
            try:
                yield Record(*pickle.load(f))
            except EOFError:
                break
    path.unlink()


def _batches(rows: Iterable[tuple], schema: pa.Schema, size=lambda r: 64) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded bytes."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= _OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_LOCAL = pa.schema([("row", pa.int64()), ("name", pa.int64()), ("id", pa.int64()), ("sha", pa.string()), ("hash", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("no_id", pa.bool_()), ("low_id", pa.int64()), ("low_row", pa.int64())])


def _gather(held: int):
    """A row for each row of the task, with the name of its content here, and one for each content of a full table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = Contents(held)

        def flushed() -> Iterator[tuple]:
            for names, h, c, n, first in zip(contents.names, contents.hashes, contents.contents, contents.n, contents.firsts, strict=True):
                yield None, names[0], None, None, h, c, n, *first

        def rows() -> Iterator[tuple]:
            nonlocal contents
            for batch in batches:
                for row, id_, sha, h, content in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                    r = Record(h, content, row, 1, (id_ is None, id_ or 0, row))
                    k = contents.place(r)
                    if k < 0:
                        yield from flushed()
                        contents = Contents(held)
                        k = contents.place(r)
                    yield row, contents.names[k][0], id_, sha, None, None, None, None, None, None
            yield from flushed()

        yield from _batches(rows(), _LOCAL, lambda r: 128 + len(r[5] or b""))

    return run


_SETTLED = pa.schema([("name", pa.int64()), ("group_size", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64())])


def _settle(held: int, fanout: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            for h, content, name, n, *first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield Record(h, content, name, n, tuple(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = settled(records(batches), held, fanout)
        yield from _batches(((name, n, None if no_id else id_, row) for name, n, (no_id, id_, row) in found), _SETTLED)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), held: int = HELD, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs``, and the columns ``keep``.

    Texts are equal if they are after each run of ASCII white space has become one space. Every task first puts
    its own rows into a table of contents, so a text with any number of copies leaves it once for each
    ``held`` bytes of different texts. These contents are dealt by hash to buckets, the first partition, and each
    bucket is partitioned again, into spill files of its task, until what is left fits the table. Hashes
    only deal; the tables compare whole contents.

    Null texts are empty; an empty text is a text like others. Of equal texts the row with the smallest id
    stays: rows without an id come after all others, and of several rows with this id one stays, so each
    group has one row with ``kept``. A group without any id has a null ``keep_id``. Texts may be of any
    length that a row can hold. Columns of ``keep`` must not have a name of the operator's own; a clash is an error. An empty
    table gives no rows.
    """
    if clash := set(keep) & {"doc_id", "text", "row", "name", "id", "sha", "keep_id", "keep_row", "group_size", "kept", "text_sha256"}:
        raise ValueError(f"columns with names of the operator's own: {sorted(clash)}")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep])
    if keep:
        rows = table(rows, "rows")  # they are read twice, with the same numbers
    kept = rows.select("row", *keep)
    rows = rows.select("row", "doc_id", normalised(F.col("text")).alias("text"))
    rows = rows.select("row", "doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("content"))
    found = table(rows.mapInArrow(_gather(held), "row long, name long, id long, sha string, hash long, content binary, n long, no_id boolean, low_id long, low_row long"), "contents")
    buckets = found.where("row is null").select("hash", "content", "name", "n", "no_id", "low_id", "low_row").repartition("hash")
    groups = table(buckets.mapInArrow(_settle(held, fanout), "name long, group_size long, keep_id long, keep_row long"), "settled")
    out = found.where("row is not null").select("row", "name", "id", "sha").join(groups, "name")
    if keep:
        out = out.join(kept, "row")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), *keep)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; null and odd rows as in ``exact_duplicates``."""
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = exact_duplicates(rows, names[id_col], names[text_col], keep=tuple(names.values()))
    return found.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


#: The same for DuckDB. Ids are unique and not null there.
SQL = r"""
with t as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(text) as text_sha256
from t window w as (partition by text)
"""
