"""Exact top-k inner products over an impact-ordered index.

Components become integers, ``floor(scale * x)``. Vectors are dealt to shards of
``SHARD_ROWS`` rows. In a shard, each dimension's values are quantised to
levels, and a segment is the list of rows of one dimension and level. For a
query, a segment's impact is the largest product that its rows can get there,
less the least product of that dimension, so impacts are never negative.
Segments are processed in descending quantised impact. Every row has a lower and
an upper bound: what it got for sure and at most, plus the largest impact that is
left for each dimension it hasn't met. The scan stops when the rows whose upper
bound reaches the k-th best lower bound are few, which proves all others out;
those are scored again exactly. Bounds are doubles and carry the error that their
sums may have, so no row is lost by rounding; exact scores are 64-bit integers
where they must fit and Python integers elsewhere, so vectors of any finite size
take the same path.

The index and the queries are written to the shared folder once, the queries in
blocks of about ``QUERY_BYTES``. A task unpacks a shard once and reads one block after
another for it; no vector passes through the driver, which knows the blocks' names
alone. The best k of every shard meet at the end.

Cases: vectors that are null, or hold null or non-finite components, take no
part; vectors of other lengths count as padded with zeros; rows that repeat a
vec_id are candidates each on its own, but a query never meets rows of its own
id; repeated query rows are one query (the least vector in order); a null vec_id
takes no part; a score beyond a long counts as the nearest long; an empty table
gives no row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, fresh_path, in_workers, opened

#: Integers are floor(SCALE * x); a scale is a power of two, so that products with it are exact.
SCALE, K, EVERY = 1024, 10, 100
SHARD_ROWS = 8192
LEVELS = 32
#: Steps of quantised impact, two for each halving.
STEPS = 24
QUERY_BYTES = 16 << 20
LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where("vec_id is not null and embedding is not null").where(fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def floored(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) / scale: exact in doubles, and finite for every finite x."""
    with np.errstate(over="ignore"):
        return np.where(np.abs(x) < 2.0**53, np.floor(x * scale) / scale, x)


def whole(y: float, scale: int) -> int:
    """scale * y of a floored component as an integer."""
    return int(y) * scale if abs(y) >= 2.0**53 else int(y * scale)


def _unit(x: np.ndarray) -> np.ndarray:
    """``x`` by a power of two, so that its largest value is below 1."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0))[1]))


class ImpactIndex:
    """One shard: floored vectors and, for each dimension and level, its rows."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, scale: int = SCALE):
        if scale < 1 or scale & (scale - 1):
            raise ValueError("scale is a power of two")
        self.ids, self.matrix, self.scale = ids, matrix, scale
        rows, dims = matrix.shape
        lo, hi = matrix.min(0, initial=0), matrix.max(0, initial=0)
        with np.errstate(over="ignore"):
            step = np.where(np.isfinite(hi - lo), (hi - lo) / LEVELS, hi / LEVELS - lo / LEVELS)
        bounds = lo + np.arange(1, LEVELS)[:, None] * step  # [LEVELS - 1, dims], ascending
        level = np.zeros((dims, rows), np.int64)
        for d in range(dims):
            level[d] = np.searchsorted(bounds[:, d], matrix[:, d], "right")
        self.posting_rows = np.argsort(level, axis=1, kind="stable").ravel()
        counts = np.array([np.bincount(own, minlength=LEVELS) for own in level], np.int64).reshape(dims, LEVELS)
        start = np.concatenate([[0], np.cumsum(counts.ravel())])
        full = counts.ravel() > 0
        self.dim = np.repeat(np.arange(dims), LEVELS)[full]
        self.start, self.end = start[:-1][full], start[1:][full]
        held = matrix.T.ravel()[np.repeat(self.dim, self.end - self.start) * rows + self.posting_rows] if rows else np.zeros(0)
        self.low = np.minimum.reduceat(held, self.start) if len(self.start) else held  # the segment's least and largest values
        self.high = np.maximum.reduceat(held, self.start) if len(self.start) else held
        self.processed = self.rescored = 0

    def search(self, query: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best rows whose id isn't ``own``, best first.

        ``query`` is floored as the shard is. ``processed`` and ``rescored`` then say how
        many segments were processed and how many rows scored exactly.
        """
        rows, dims = self.matrix.shape
        q = np.zeros(dims)
        q[: min(dims, len(query))] = query[:dims]
        other = self.ids != own
        self.processed, possible = 0, np.flatnonzero(other)
        if not dims or not len(possible):
            return self._exact(possible, q, k)
        # All bounds are in units of one power of two, in which nothing overflows.
        top = max(float(np.abs(self.low).max()), float(np.abs(self.high).max()))
        shift, weight = int(np.frexp(top)[1]), _unit(q)[self.dim]
        low, high = np.ldexp(self.low, -shift), np.ldexp(self.high, -shift)
        least, most = np.minimum(weight * low, weight * high), np.maximum(weight * low, weight * high)
        error = dims * dims * (float(np.abs(most).max()) + float(np.abs(least).max())) * 2.0**-50 + 2.0**-1000
        base = np.full(dims, np.inf)
        np.minimum.at(base, self.dim, least)
        # Scores as a long are all alike beyond its range, so none there is proved out.
        unit = shift + int(np.frexp(np.abs(q).max())[1]) + 2 * (self.scale.bit_length() - 1)
        most_sure = np.ldexp(1.0, min(63 - unit, 1000)) - base.sum() if 63 - unit > -1000 else 0.0
        least_sure = -np.ldexp(1.0, min(63 - unit, 1000)) - base.sum() if 63 - unit > -1000 else 0.0
        least, most = least - base[self.dim], most - base[self.dim]  # 0 or more
        peak = float(most.max(initial=0))
        share = np.maximum(most / (peak or 1.0), 2.0**-STEPS)
        step = np.minimum(STEPS - 1, (-2 * np.log2(share)).astype(np.int64))
        order = np.argsort(step, kind="stable")
        edges = np.searchsorted(step[order], np.arange(STEPS + 1))
        sure, spread, unmet = np.zeros(rows), np.zeros(rows), np.ones((rows, dims))
        few = max(4 * k, rows // 4)  # these are scored exactly for less than what the scan would still cost
        for s in range(STEPS):
            now = order[edges[s] : edges[s + 1]]
            if len(now):
                self.processed += len(now)
                lengths = self.end[now] - self.start[now]
                ends = np.cumsum(lengths)
                at = np.repeat(self.start[now] - (ends - lengths), lengths) + np.arange(ends[-1])
                hit = self.posting_rows[at]
                sure += np.bincount(hit, np.repeat(least[now], lengths), rows)
                spread += np.bincount(hit, np.repeat((most - least)[now], lengths), rows)
                unmet[hit, np.repeat(self.dim[now], lengths)] = 0
            if s < STEPS // 6 or s % 2 == 0:  # the proof is looked for at every other step, the last one too
                continue
            waiting = order[edges[s + 1] :]
            ahead = np.zeros(dims)
            np.maximum.at(ahead, self.dim[waiting], most[waiting])
            upper = sure + spread + unmet @ ahead
            lower = sure[other]
            bar = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
            bar = min(bar, most_sure) if bar > least_sure else -np.inf
            possible = np.flatnonzero((upper >= bar - error) & other)
            if len(possible) <= few:
                break
        return self._exact(possible, q, k)

    def _exact(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        self.rescored = len(rows)
        own = self.matrix[rows]
        top = [float(np.abs(x).max(initial=0)) for x in (own, q)]
        if max(top) < 2.0**42 and max(1, len(q)) * whole(top[0], self.scale) * whole(top[1], self.scale) <= LONG:
            scores = (own * self.scale).astype(np.int64) @ (q * self.scale).astype(np.int64)
        else:
            wide = [whole(x, self.scale) for x in q.tolist()]
            sums = (sum(whole(x, self.scale) * y for x, y in zip(v, wide, strict=True)) for v in own.tolist())
            scores = np.array([max(-LONG - 1, min(LONG, n)) for n in sums], np.int64)
        best = np.lexsort((self.ids[rows], ~scores))[:k]
        return self.ids[rows][best], scores[best]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        ints = self.matrix * self.scale if np.abs(self.matrix).max(initial=0) < 2.0**15 / self.scale else None
        matrix = self.matrix if ints is None else ints.astype(np.int16)
        np.savez(out, ids=self.ids, matrix=matrix, scale=self.scale, posting_rows=self.posting_rows.astype(np.uint16 if len(self.ids) <= 1 << 16 else np.uint32), dim=self.dim, low=self.low, high=self.high, start=self.start, end=self.end)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ImpactIndex:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as held:
            made.scale, matrix = int(held["scale"]), held["matrix"]
            made.matrix = matrix / made.scale if matrix.dtype == np.int16 else matrix
            made.low, made.high = held["low"], held["high"]
            for name in ("ids", "posting_rows", "dim", "start", "end"):
                setattr(made, name, held[name].astype(np.int64))
        made.processed = made.rescored = 0
        return made


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    lists = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max((len(x) for x in lists), default=0)))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return floored(out, scale)


def build_index(vectors: DataFrame, path: str, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> None:
    """Write the index shards of ``vectors`` (vec_id, embedding) to ``path``; each task's rows make its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        rows = 0

        def closed() -> pa.RecordBatch:
            dims = max(p.shape[1] for p in parts)
            matrix = np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])
            return pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64()), "file": pa.array([ImpactIndex(np.concatenate(ids), matrix, scale).to_bytes()], pa.binary())})

        for batch in batches:
            r = 0
            while r < batch.num_rows:
                own = batch.slice(r, shard_rows - rows)
                ids.append(own.column(0).to_numpy().astype(np.int64))
                parts.append(_matrix(own.column(1), scale))
                rows, r = rows + own.num_rows, r + own.num_rows
                if rows >= shard_rows:
                    yield closed()
                    ids, parts, rows = [], [], 0
        if rows:
            yield closed()

    in_workers(usable(vectors), run, "rows long, file binary", "topk").write.parquet(path)


def search(index: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best rows of every query: query_id, rank, vec_id, score.

    ``queries``: (vec_id, v). They are dealt to blocks by a hash of vec_id and written;
    every shard meets all blocks.
    """
    spark = index.sparkSession
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    about = one.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-about.n * (about.d or 0) * 8 // query_bytes))
    asked = fresh_path(spark, "queries")
    dealt = one.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    dealt.repartition("block").sortWithinPartitions("block", "vec_id").write.partitionBy("block").parquet(asked)
    store, at = opened(asked)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.base_name.endswith(".parquet"))  # one for each block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(asked)
        for batch in batches:
            for file in batch.column("file"):
                shard = ImpactIndex.from_bytes(file.as_py())
                for name in files:
                    with store.open_input_file(name) as source:
                        table = pq.ParquetFile(source).read(columns=["vec_id", "v"])
                    if not len(table):
                        continue
                    names = table.column("vec_id").to_numpy().astype(np.int64)
                    out = [shard.search(v, int(n), k) for n, v in zip(names, _matrix(table.column("v").combine_chunks(), scale), strict=True)]
                    counts = [len(ids) for ids, _ in out]
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(names, counts), "vec_id": np.concatenate([ids for ids, _ in out]), "score": np.concatenate([s for _, s in out])})

    hits = cut(in_workers(index.select("file"), run, "query_id long, vec_id long, score long", "topk"), "hits")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` against all rows."""
    path = fresh_path(vectors.sparkSession, "impact-index")
    build_index(vectors, path, scale)
    index = vectors.sparkSession.read.schema("rows long, file binary").parquet(path)
    return search(index, usable(vectors).where(F.col("vec_id") % every == 0), k, scale)
