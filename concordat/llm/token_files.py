"""Operator 10: token ids of a corpus as Huffman-coded files in the order of the ids."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.bpe import text_groups
from concordat.llm.huffman import Codec, code_lengths
from concordat.llm.order import LOWEST, ranges
from concordat.llm.pieces import PieceTable, byte_bpe_spans
from concordat.llm.stage import discard, shared_dir, table
from concordat.llm.text import code_points

#: Tokens between bit-offset checkpoints, and of a block (a longer document has a block of its own).
EVERY, BLOCK_TOKENS = 64, 1 << 16


class ByteBpe:
    """A byte-level tokenizer file, run by the tokenizers library once for each piece that a worker meets.

    The pieces are cut by array operations by the file's own pattern; a text that holds a special
    token's string goes through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table = PieceTable(lambda pieces: [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = ["" if k in odd else t for k, t in enumerate(texts)]
        whole = "".join(plain)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])
        codes = code_points(whole)
        ids, bounds = self.table.tokens(whole, codes, byte_bpe_spans(codes, offsets))
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for k in odd:
            out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _planes(ids: np.ndarray) -> bytes:
    """Ids as their low bytes, then the next ones and so on: these planes compress better than mixed bytes."""
    if len(ids) and int(ids.max()) >= 1 << 24:
        raise ValueError("ids of 24 bits and more are not supported")
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _ids(planes: bytes) -> np.ndarray:
    raw = np.frombuffer(planes, np.uint8).reshape(3, -1).astype(np.uint32)
    return raw[0] | raw[1] << np.uint32(8) | raw[2] << np.uint32(16)


def tokenize(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(part, doc_id, h, n_tokens, planes) of each row, and the number of parts.

    part is the row's range in the order by id and h, a hash of its tokens. Null texts count as empty.
    """
    parts = ranges(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(at, len(group)).cast(pa.int64())
                found = [np.concatenate([x, tail]) for x in bpe.encode(group)]
                planes = [_planes(x) for x in found]
                h = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in planes), "<i8")
                part = parts.of(ids.fill_null(LOWEST).to_numpy(), h)
                at += len(group)
                cols = [pa.array(part, pa.int32()), ids, pa.array(h, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(planes, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "h", "n_tokens", "planes"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "part int, doc_id long, h long, n_tokens long, planes binary"), parts.count


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole corpus; one row for each distinct id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for planes in batch.column(0).to_pylist():
                own = np.bincount(_ids(planes))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    rows = tokens.select("planes").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


_BLOCK_SCHEMA = "part int, seq int, start long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, payload binary"


def write_files(docs: DataFrame, path: str, to: str, end_id: int | None = None, max_bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the corpus to the folder ``to``.

    ``to``/header holds the code length of each id, from the counts of the whole corpus;
    ``to``/blocks holds independent blocks in the order (start): the documents' ids and lengths, the
    bit streams, and the bit offset of every 64th token of a document. Documents ascend by id, null
    ids first, through blocks and files alike; rows of the same id follow the hash of their tokens.
    Null and empty texts have the end id alone, if there is one. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    tokens, n_parts = tokenize(docs, path, end_id, id_col, text_col)
    tokens = table(tokens, "tokens")
    lengths = code_lengths(id_counts(tokens), max_bits)
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part] = at
        at += totals[part]
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id long, bits int").coalesce(1).write.parquet(f"{to}/header")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths, EVERY)
        for batch in batches:
            planes, lo = batch.column(4).to_pylist(), 0
            while lo < len(planes):
                hi, size = lo, 0
                while hi < len(planes) and (hi == lo or size < 8 * BLOCK_TOKENS):
                    size += len(planes[hi]) // 3
                    hi += 1
                found = [_ids(x) for x in planes[lo:hi]]
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in found])]).astype(np.int64)
                data, first, bits = codec.encode(np.concatenate(found), bounds)
                marks = [(bits[a:b:EVERY] - 8 * f).astype("<u4").tobytes() for a, b, f in zip(bounds[:-1], bounds[1:], first[:-1])]
                coded = [data[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(lo, hi - lo) for k in range(4)] + [pa.array(marks, pa.binary()), pa.array(coded, pa.binary())],
                    ["part", "doc_id", "h", "n_tokens", "marks", "coded"],
                )
                lo = hi

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, docs_in, lens, marks, payload, n = None, 0, 0, [], [], [], [], 0

        def block() -> pa.RecordBatch:
            shift = np.cumsum([0, *map(len, payload)])[:-1] * 8
            bits = [np.frombuffer(m, "<u4").astype("<u8") + s for m, s in zip(marks, shift)]
            values = [part, seq, start, docs_in, lens, np.concatenate(bits).astype("<u8").tobytes(), b"".join(payload)]
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, values)}, schema)

        names = ["part", "seq", "start", "doc_ids", "doc_tokens", "checkpoints", "payload"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                if docs_in and (row[0] != part or n >= BLOCK_TOKENS):
                    yield block()
                    seq, start = seq + 1, start + n
                    docs_in, lens, marks, payload, n = [], [], [], [], 0
                if row[0] != part:
                    part, seq, start = row[0], 0, starts[row[0]]
                docs_in.append(row[1])
                lens.append(row[2])
                marks.append(row[3])
                payload.append(row[4])
                n += row[2]
        if docs_in:
            yield block()

    coded = tokens.mapInArrow(code, "part int, doc_id long, h long, n_tokens long, marks binary, coded binary")
    # File k holds the k-th stretch of parts, so that the files' order is that of the ids.
    n_files = min(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    file = F.floor(F.col("part").cast("long") * n_files / n_parts).cast("int")
    ordered = coded.repartitionById(n_files, file).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "h", "coded")
    ordered.mapInArrow(pack, _BLOCK_SCHEMA).write.parquet(f"{to}/blocks")
    discard(tokens)


def read_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of each document of a folder that ``write_files`` made.

    The blocks decode independently; within one, all stretches between checkpoints decode together. Null and
    repeated ids come back as they were written; a folder of an empty table gives no rows.
    """
    rows = spark.read.schema("id long, bits int").parquet(f"{folder}/header").collect()
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths, EVERY)
        for batch in batches:
            for start, ids, lens, marks, payload in zip(*(batch.column(k).to_pylist() for k in range(5))):
                lens = np.array(lens, np.int64)
                lanes = -(-lens // EVERY)
                last = np.cumsum(lanes) - 1
                counts = np.full(int(lanes.sum()), EVERY, np.int64)
                some = lens > 0
                counts[last[some]] = lens[some] - (lanes[some] - 1) * EVERY
                found = codec.decode(payload, np.frombuffer(marks, "<u8").astype(np.int64), counts)
                ends = np.cumsum(lens)
                own = [found[a:b].astype("<u4") for a, b in zip((ends - lens).tolist(), ends.tolist())]
                cols = [
                    pa.array(ids, pa.int64()),
                    pa.array(start + ends - lens, pa.int64()),
                    pa.array(lens, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    return blocks.select("start", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(run, kinds)


def round_trip(docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    """Write the corpus to a new folder of the shared one and read it back: (doc_id, start, n_tokens, ids_crc32) of each row.

    A null text counts as empty and has only the end id; null ids come first and repeated ones are documents
    of their own; texts may be of any length; other columns are not read. An empty table gives no rows. The
    result reads the folder, which is the caller's to delete.
    """
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, to, end_id)
    return read_files(spark, to, with_ids=False)
