"""Token ids in fixed-width bit-packed files.

Every id takes the least number of bits that hold the vocabulary.  A file is

    magic ``TOKB`` | u8 bits | u8 0 | u16 ids in a block / 8 | u64 part
    u64 ids of the part before the file | u64 documents | u64 ids | u64 blocks
    i64 doc ids | u8 null marks | u64 first id of each document
    u64 byte offset of each block | blocks

all little-endian; a block holds ``block_ids`` ids (the last one fewer), lowest
bit first, and starts on a byte.  Any id can be read from its block alone, and a
block unpacks as one numpy operation.

Documents are laid out in ascending id over parts and files.  Each part (one write
task) ends with a file of 20 bytes, ``TOKT`` | u64 part | u64 ids, so that readers
learn where parts begin from these alone, and where files begin from their heads.

Files are written by Spark's text writer, one file a row, so they can lie in any
store that Spark writes to; that writer adds a line feed behind the last block,
which readers ignore.

Defined cases: a null or empty text is the end id alone; a null document id sorts
first; rows with equal id keep together in any order; an id that the vocabulary does
not have is an error; an empty table gives no file.  Extra columns are not carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder, slices

_MAGIC = b"TOKB"
_HEAD = "<4sBBHQQQQQ"
_HEAD_SIZE = struct.calcsize(_HEAD)
_PART_MAGIC = b"TOKT"
_PART = "<4sQQ"
#: More than a part's last file, less than a file with a document.
_SHORT = _HEAD_SIZE + 8


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, lowest first."""
    if bits < 32 and len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class FileBuilder:
    """Collects documents and packs their ids block by block."""

    def __init__(self, bits: int, block_ids: int):
        self.bits, self.block_ids = bits, block_ids
        self.doc_ids: list[int | None] = []
        self.firsts: list[int] = []
        self.blocks: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.n_ids = self.n_open = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.firsts.append(self.n_ids)
        self.open.append(ids)
        self.n_ids += len(ids)
        self.n_open += len(ids)
        if self.n_open >= 64 * self.block_ids:
            self._pack(self.n_open - self.n_open % self.block_ids)

    def _pack(self, n: int) -> None:
        flat = np.concatenate(self.open) if self.open else np.empty(0, np.uint32)
        self.blocks += [pack(flat[i : min(i + self.block_ids, n)], self.bits) for i in range(0, n, self.block_ids)]
        self.open = [flat[n:].copy()]
        self.n_open = len(flat) - n

    def build(self, part: int, before: int) -> bytes:
        """The file's bytes; ``before`` counts the ids of the part's earlier files."""
        self._pack(self.n_open)
        head = struct.pack(_HEAD, _MAGIC, self.bits, 0, self.block_ids // 8, part, before, len(self.doc_ids), self.n_ids, len(self.blocks))
        sizes = np.array([len(b) for b in self.blocks], np.int64)
        offsets = len(head) + 17 * len(self.doc_ids) + 8 * len(sizes) + np.cumsum(sizes) - sizes
        return b"".join(
            [
                head,
                np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
                np.array([d is None for d in self.doc_ids], "u1").tobytes(),
                np.array(self.firsts, "<u8").tobytes(),
                offsets.astype("<u8").tobytes(),
                *self.blocks,
            ]
        )


class TokenFile:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, _, eighth, self.part, self.before, n, self.n_ids, blocks = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        self.block_ids = eighth * 8
        at = _HEAD_SIZE
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.nulls = np.frombuffer(data, "u1", n, at + 8 * n).astype(bool)
        self.firsts = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 17 * n).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, from the blocks that hold them."""
        parts = []
        for b in range(start // self.block_ids, -(-stop // self.block_ids)):
            count = min(self.block_ids, self.n_ids - b * self.block_ids)
            size = -(-count * self.bits // 8)
            at = int(self.offsets[b])
            block = unpack(self.data[at : at + size], count, self.bits)
            parts.append(block[max(0, start - b * self.block_ids) : stop - b * self.block_ids])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        stop = self.firsts[i + 1] if i + 1 < len(self.firsts) else self.n_ids
        return self.ids(int(self.firsts[i]), int(stop))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 4096,
    file_ids: int = 4_000_000,
) -> None:
    """Encode every text and write the files under ``path``, documents in ascending id.

    The tokenizer's vocabulary sets the bits of an id.  A file ends with the document
    that brings it to ``file_ids`` ids.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        bits = bits_for(tokens.tokenizer.get_vocab_size())
        row = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])
        file, before = FileBuilder(bits, block_ids), 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                for doc_id, ids in zip(batch.column(0)[a:b].to_pylist(), tokens.encode(batch.column(1)[a:b]), strict=True):
                    file.add(doc_id, ids)
                    if file.n_ids >= file_ids:
                        yield row(file.build(part, before))
                        file, before = FileBuilder(bits, block_ids), before + file.n_ids
        if file.n_ids:
            yield row(file.build(part, before))
        if before + file.n_ids:
            yield row(struct.pack(_PART, _PART_MAGIC, part, before + file.n_ids))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, "id")
        .sortWithinPartitions("id")
        .mapInArrow(write, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("maxRecordsPerFile", 1).text(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document: ``ids`` little-endian unsigned
    32-bit, ``start`` the ids of all documents before it."""
    files = spark.read.format("binaryFile").load(path)
    ends = files.filter(F.col("length").between(2, _SHORT)).select("content")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [struct.unpack_from(_PART, x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)], names=["part", "n"])

    # One row for each write task, two numbers each: the ids before each part.
    counted = sorted(tuple(r) for r in ends.mapInArrow(totals, "part long, n long").collect())
    before = dict(zip([p for p, _ in counted], np.cumsum([0, *(n for _, n in counted)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast(before)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                start = file.firsts + shared.value[file.part] + file.before
                for a in range(0, len(start), 512):
                    n = min(512, len(start) - a)
                    ids = [file.document(i).astype("<u4") for i in range(a, a + n)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[a : a + n], mask=file.nulls[a : a + n]),
                            pa.array(start[a : a + n]),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([x.tobytes() for x in ids], pa.binary()),
                        ],
                        names=["id", "start", "n_tokens", "ids"],
                    )

    return files.filter(F.col("length") > _SHORT).select("content").mapInArrow(read, "id long, start long, n_tokens long, ids binary")
