"""Token-id files: one wavelet matrix per shard, and tables of them.

A shard holds the ids of consecutive documents. Its file is a stack of bit
planes, most significant bit first; plane k holds bit k of the ids in the order
that a stable partition by the bits before leaves. With a count of ones for
every 512 bits, access, rank and select need one step per plane, so a shard can
be read at any place, and a token's occurrences counted or found, without
decoding the rest. The bytes are compressed as a whole by the table that holds
them.

Cases: null text is empty and has the end id alone; rows that share a doc_id
stand one after another, ordered by text; rows without doc_id come first; an
empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh_path, in_workers, row_chunks, text_buffers
from sparkloom.llm.tokens import ENCODE_BYTES, END_ID, units

MAGIC = b"WMTX1\n"
BLOCK = 512
#: Tokens of a shard before it is closed; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 17


class WaveletMatrix:
    """Bit planes of a sequence of non-negative integers, with rank and select."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.zeros = size, planes, zeros
        self.ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        values = np.asarray(values)
        bits = max(1, int(values.max(initial=0)).bit_length())
        values = values.astype(np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64)
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            one = (values >> values.dtype.type(k)) & values.dtype.type(1) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = np.flatnonzero(~one)
            zeros.append(len(low))
            values = values[np.concatenate([low, np.flatnonzero(one)])]
        return cls(len(values), planes, zeros)

    def decode(self) -> np.ndarray:
        """All values: the partitions are undone from the last plane to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32 if len(self.planes) <= 32 else np.uint64
        values = np.zeros(self.size, kind)
        for k, (plane, zero) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            before = np.empty(self.size, kind)
            before[np.flatnonzero(~one)] = values[:zero]
            before[np.flatnonzero(one)] = values[zero:] | kind(1 << k)
            values = before
        return values

    def _index(self) -> list[np.ndarray]:
        if self.ranks is None:
            self.ranks = []
            for plane in self.planes:
                ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
                self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        return self.ranks

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        start = block * BLOCK // 8
        count = int(self._index()[level][block]) + int(np.bitwise_count(plane[start : i // 8]).sum(dtype=np.int64))
        return count + (int(plane[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` stands before place ``end``."""
        lo, hi = 0, min(max(end, 0), self.size)
        if value < 0 or value >> len(self.planes):
            return 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind in a plane."""
        at = self._index()[level]
        counts = at if bit else np.arange(len(at)) * BLOCK - at
        block = int(np.searchsorted(counts, k, "right")) - 1
        own = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - int(counts[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        lo, steps = 0, len(self.planes)
        for level in range(steps):
            a = self._ones(level, lo)
            lo = self.zeros[level] + a if value >> (steps - 1 - level) & 1 else lo - a
        place = lo + k
        for level in range(steps - 1, -1, -1):
            bit = value >> (steps - 1 - level) & 1
            place = self._select_bit(level, bit, place - self.zeros[level] if bit else place)
        return place

    def to_bytes(self) -> bytes:
        self._index()
        head = struct.pack("<QB", self.size, len(self.planes)) + np.asarray(self.zeros, "<u8").tobytes()
        return head + b"".join(p.tobytes() + r.astype("<u4").tobytes() for p, r in zip(self.planes, self.ranks, strict=True))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        size, levels = struct.unpack_from("<QB", data)
        at = struct.calcsize("<QB")
        zeros = np.frombuffer(data, "<u8", levels, at).tolist()
        at += 8 * levels
        planes, ranks = [], []
        plane_bytes = -(-size // 8)
        for _ in range(levels):
            planes.append(np.frombuffer(data, np.uint8, plane_bytes, at))
            blocks = -(-plane_bytes // (BLOCK // 8)) + 1
            ranks.append(np.frombuffer(data, "<u4", blocks, at + plane_bytes).astype(np.int64))
            at += plane_bytes + 4 * blocks
        made = cls(size, planes, zeros)
        made.ranks = ranks
        return made


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: its documents' ids and lengths, then the wavelet matrix."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<I", len(doc_ids)) + named.tobytes() + known.tobytes() + lengths.astype("<u8").tobytes() + WaveletMatrix.build(ids).to_bytes()


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the matrix of a shard's file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    at = len(MAGIC)
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    named = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, np.uint8, n, at + 8 * n)
    lengths = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    return [int(d) if k else None for d, k in zip(named, known, strict=True)], lengths, WaveletMatrix.from_bytes(data[at + 17 * n :])


SHARDS = "part int, shard int, n_docs long, n_tokens long, file binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of ``docs`` (doc_id, text) as shards in ascending doc_id order.

    Ranges of doc_id are dealt to partitions, sorted there and encoded as they
    stream by; (part, shard) orders the shards over the whole table.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = units(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        tokens = 0

        def closed() -> pa.RecordBatch:
            file = pack_shard(names, np.concatenate(lengths), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([file], pa.binary())], names=["part", "shard", "n_docs", "n_tokens", "file"])

        for batch in batches:
            ids_of, (data, offsets) = batch.column(0).to_pylist(), text_buffers(batch.column(1))
            for a, b in row_chunks(offsets, ENCODE_BYTES):
                own = offsets[a : b + 1]
                ids, at = encoder.encode(data[own[0] : own[-1]], own - own[0], end_id)
                r = 0
                while r < b - a:
                    room = max(1, shard_tokens - tokens)
                    s = max(r + 1, int(np.searchsorted(at, at[r] + room, "right")) - 1)
                    if s > r + 1 or not names or at[s] - at[r] <= room:
                        names += ids_of[a + r : a + s]
                        held.append(ids[at[r] : at[s]])
                        lengths.append(np.diff(at[r : s + 1]))
                        tokens += int(at[s] - at[r])
                        r = s
                    if tokens >= shard_tokens or (r < b - a and at[r + 1] - at[r] > shard_tokens - tokens):
                        yield closed()
                        shard, tokens, names, held, lengths = shard + 1, 0, [], [], []
        if names:
            yield closed()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    in_workers(ordered, encode, SHARDS, "tokens").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the shards at ``path``: doc_id, start, n_tokens,
    ids_crc32, and the ids themselves if asked for."""
    files = spark.read.schema(SHARDS).parquet(path)
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # a row for each task that wrote
    parts = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("shard")
    starts = sizes.join(parts, "part").select("part", "shard", (F.col("part_start") + F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("shard_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, file in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("file"), strict=True):
                names, lengths, matrix = open_shard(file.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = {"part": pa.array([part] * len(names), pa.int32()), "shard": pa.array([shard] * len(names), pa.int32()), "doc_id": pa.array(names, pa.int64()), "offset": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    read = in_workers(files.select("part", "shard", "file"), decode, schema, "tokens").join(starts, ["part", "shard"])
    return read.select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def tokens_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files below the shared folder, and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path)
