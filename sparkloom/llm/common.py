"""Shared helpers: the shared folder, row chunks of Arrow batches, word hashes.

All byte-level work runs in numpy over chunks of whole rows. A chunk holds a
bounded number of bytes unless a single row is larger, so memory follows the
chunk limit or the longest row, never the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import shared_dir
from sparkloom.workers import in_workers, kept_by_workers  # noqa: F401

#: Bytes of text that are looked at together; the arrays of a chunk stay in the processor's cache.
CHUNK_BYTES = 1 << 19

# White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, for what is not a table, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def cut(df: DataFrame, name: str, stored: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.options(**(stored or {"compression": "zstd"})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(column: str, parts: int) -> Column:
    """crc32 of an id's text modulo ``parts``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(parts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, offsets


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of whole rows with at most ``limit`` bytes each, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of each chunk."""
    data, offsets = text_buffers(column)
    for a, b in row_chunks(offsets, limit):
        own = offsets[a : b + 1]
        yield a, b, data[own[0] : own[-1]], own - own[0]


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            made = np.multiply.accumulate(steps)
            if size > 4 * CHUNK_BYTES:  # of one very long row: not kept
                if k == 0:
                    held = made
                else:
                    return held[:n], made[:n]
            else:
                _powers[k] = made
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; it doesn't depend on the place."""
    n = len(data)
    if not len(start):
        return np.zeros(0, _U)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal non-zero ``kind`` that stay in
    one row, and for each row the number of its first run (n + 1 of them)."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    change = np.empty(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[0] = change[n] = True
    change[offsets] = True
    edges = np.flatnonzero(change)
    full = kind[edges[:-1]] != 0
    start, end = edges[:-1][full], edges[1:][full]
    return start, end, np.searchsorted(start, offsets)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[r]:first[r + 1]] for each row; 0 for empty rows.

    Each row is summed on its own, so a row's sum does not depend on its neighbours.
    """
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: first[-1]], first[:-1][full], axis=0)
    return out
