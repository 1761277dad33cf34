"""Token ids on disk as one wavelet matrix per shard.

Documents are range-partitioned by id, encoded, and written in ascending id order as shard files:
bit planes from the highest bit down, each stably split into zeros and ones for the next, with a
rank directory. Planes are stored as separately compressed blocks, so reading one token, counting
a token or finding its j-th occurrence touches a few blocks per plane of the one file.

A shard file is a binary cell of a Parquet table in a shared folder, next to its document ids; any
file system that Spark can write holds it, and a lost task writes its shards again.

Defined results
  null or empty text    the end id alone
  null ids              come first
  repeated ids          every row is a document of its own, in table order
  empty table           no rows and no shard
  other columns         ignored
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm import tokens
from clausework.llm.util import scratch_path, small_batches

END_ID = 0
MAGIC = b"WVMX"
# Ids a shard holds before it is closed; a document is never split.
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 1 << 16
_HEAD = struct.Struct("<4sQQBI")


def _packed(numbers: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    data = press.compress(numbers.tobytes())
    return struct.pack("<Q", len(data)) + data


def build(ids: np.ndarray, lengths: list[int]) -> bytes:
    """The file of one shard: ``ids`` of its documents, joined, and their lengths."""
    # Symbols are ranks by frequency, so the upper planes hold few ones and compress well.
    counts = np.bincount(ids)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    symbol = np.zeros(len(counts), np.uint32)
    symbol[alphabet] = np.arange(len(alphabet))
    bits = max(1, (len(alphabet) - 1).bit_length())
    press = zstandard.ZstdCompressor(level=1)
    out = [_HEAD.pack(MAGIC, len(ids), len(lengths), bits, BLOCK_BITS), _packed(np.asarray(lengths, np.uint64), press),
           _packed(alphabet.astype(np.uint64), press)]
    row = symbol.astype(np.uint16 if bits <= 16 else np.uint32)[ids]
    step = BLOCK_BITS // 8
    for bit in reversed(range(bits)):
        ones = (row & row.dtype.type(1 << bit)) != 0
        plane = np.packbits(ones, bitorder="little")
        starts = np.arange(0, len(plane), step)
        per_block = np.add.reduceat(np.bitwise_count(plane), starts, dtype=np.uint64) if len(plane) else np.zeros(0, np.uint64)
        blocks = [press.compress(plane[s:s + step].tobytes()) for s in starts]
        out.append(_packed(np.concatenate([[np.uint64(0)], np.cumsum(per_block, dtype=np.uint64)]), press))
        out.append(_packed(np.cumsum([0, *map(len, blocks)]).astype(np.uint64), press))
        out += blocks
        row = np.concatenate([np.compress(~ones, row), np.compress(ones, row)])
    return b"".join(out)


class Shard:
    """Reads one shard file; only the blocks a call needs are unpacked."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.unpack = zstandard.ZstdDecompressor()
        magic, self.size, _, self.bits, self.block = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = _HEAD.size
        self.lengths, at = self._numbers(at)
        self.alphabet, at = self._numbers(at)
        self._symbols = {int(v): s for s, v in enumerate(self.alphabet)}
        self.planes = []
        for _ in range(self.bits):
            ranks, at = self._numbers(at)
            offsets, at = self._numbers(at)
            self.planes.append((ranks, offsets, at))
            at += int(offsets[-1])
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _numbers(self, at: int) -> tuple[np.ndarray, int]:
        (n,) = struct.unpack_from("<Q", self.data, at)
        return np.frombuffer(self.unpack.decompress(self.data[at + 8:at + 8 + n]), np.uint64), at + 8 + n

    def _block(self, plane: int, number: int) -> np.ndarray:
        key = plane, number
        if key not in self._kept:
            if len(self._kept) > 256:
                self._kept.clear()
            _, offsets, at = self.planes[plane]
            raw = self.unpack.decompress(self.data[at + int(offsets[number]):at + int(offsets[number + 1])])
            self._kept[key] = np.frombuffer(raw, np.uint8)
        return self._kept[key]

    def _zeros(self, plane: int) -> int:
        return self.size - int(self.planes[plane][0][-1])

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        number, rest = divmod(i, self.block)
        ones = int(self.planes[plane][0][number])
        if rest:
            block, whole = self._block(plane, number), rest // 8
            ones += int(np.bitwise_count(block[:whole]).sum())
            if rest % 8:
                ones += int(block[whole] & ((1 << rest % 8) - 1)).bit_count()
        return ones

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) given bit of a plane."""
        low, high = 0, self.size
        while low < high:  # smallest i with more than j such bits among the first i
            mid = (low + high) // 2
            ones = self._rank1(plane, mid)
            if (ones if bit else mid - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low - 1

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            ones = self._rank1(plane, i)
            bit = self._rank1(plane, i + 1) - ones
            value = value << 1 | bit
            i = self._zeros(plane) + ones if bit else i - ones
        return int(self.alphabet[value])

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` occurs among the first i ids."""
        if value not in self._symbols:
            return 0
        low, high = self._range(self._symbols[value], i)
        return high - low

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where a symbol of the first i stands after the last plane."""
        low, high = 0, i
        for plane in range(self.bits):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            if value >> (self.bits - 1 - plane) & 1:
                low, high = self._zeros(plane) + a, self._zeros(plane) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def find(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of ``value``."""
        if value not in self._symbols:
            raise IndexError(j)
        value = self._symbols[value]
        low, high = self._range(value, self.size)
        if not 0 <= j < high - low:
            raise IndexError(j)
        i = low + j
        for plane in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - plane) & 1
            i = self._select(plane, bit, i - self._zeros(plane) if bit else i)
        return i

    def all(self) -> np.ndarray:
        """Every id in order, by undoing the splits from the last plane up."""
        if not self.size:
            return np.zeros(0, np.uint32)
        kind = np.uint16 if self.bits <= 16 else np.uint32
        row = np.zeros(self.size, kind)
        for plane in reversed(range(self.bits)):
            blocks = range(len(self.planes[plane][1]) - 1)
            ones = np.unpackbits(np.concatenate([self._block(plane, k) for k in blocks]), count=self.size, bitorder="little").view(bool)
            zeros = self._zeros(plane)
            if zeros == self.size:
                continue
            up = np.empty_like(row)
            up[np.flatnonzero(~ones)] = row[:zeros]
            up[np.flatnonzero(ones)] = row[zeros:] | kind(1 << (self.bits - 1 - plane))
            row = up
        return self.alphabet.astype(np.uint32)[row]


def write_shards(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text and write the shard table: part, shard, first, tokens, doc_ids, file."""
    spark = docs.sparkSession
    path = path or tokens.public_path(tokens.BYTE_BPE)
    # The row number spreads rows with one id over several parts and keeps their order.
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    kind = dict(rows.dtypes)["doc_id"]
    end = array("I", [end_id]).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        part = TaskContext.get().partitionId()
        shard = first = 0
        held: list[bytes] = []
        ids: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(held), np.uint32)
            file = build(data, [len(h) // 4 for h in held])
            all_ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
                "first": pa.array([first], pa.int64()), "tokens": pa.array([len(data)], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                "file": pa.array([file], pa.binary()),
            })

        for batch in batches:
            column = batch.column("doc_id")
            since = 0
            for i, data in enumerate(encoder.encode_all(batch.column("text"))):
                data += end
                held.append(data)
                size += len(data) // 4
                if size >= shard_tokens:
                    ids.append(column.slice(since, i + 1 - since))
                    yield close()
                    since, shard, first, size = i + 1, shard + 1, first + size, 0
                    held.clear()
                    ids.clear()
            if since < len(column):
                ids.append(column.slice(since))
        if held:
            yield close()

    schema = f"part int, shard int, first long, tokens long, doc_ids array<{kind}>, file binary"
    (
        small_batches(ordered).mapInArrow(write, schema).write.option("compression", "uncompressed")
        .option("parquet.block.size", 1 << 25).parquet(out)
    )


def read_shards(spark, folder: str) -> DataFrame:
    """Per document of a shard table: doc_id, start, n_tokens, ids_crc32, from the shard files."""
    shards = spark.read.parquet(folder)
    kind = dict(shards.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    schema = f"part int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("file")[i].as_py())
                data = shard.all()
                ends = np.cumsum(shard.lengths.astype(np.int64))
                starts = ends - shard.lengths.astype(np.int64)
                sums = [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(sums), batch.column("part")[i].as_py(), np.int32)),
                    "doc_id": batch.column("doc_ids")[i].values,
                    "inner": pa.array(starts + batch.column("first")[i].as_py()),
                    "n_tokens": pa.array(ends - starts),
                    "ids_crc32": pa.array(sums, pa.int64()),
                })

    # One number per part, that is per writing task: the parts before it.
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.alias("before"))
    found = shards.select("part", "first", "doc_ids", "file").mapInArrow(read, schema)
    return found.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID) -> DataFrame:
    """Write all ids to a fresh shard table in the shared folder and read it back."""
    out = scratch_path(docs.sparkSession, "token-files")
    write_shards(docs, out, path, id_col, text_col, end_id)
    return read_shards(docs.sparkSession, out)
