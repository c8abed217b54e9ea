"""Near-duplicate groups by MinHash.

1. Each text becomes a set of word shingles. Universal hash functions
   ``a * x + b`` give its minima; runs of them are hashed to band keys, and one
   bit of each minimum makes a 256-bit signature.
2. Texts with equal sets form a class at once; its smallest doc_id stands for it.
   A class's rows are dealt over tasks by a salt, so copies never meet in one.
3. Classes that share a band key are candidates. In each bucket all are first
   tried against the smallest (a star); what that joins is one component, and
   only pairs of a bucket that still lie in different components are compared in
   a second round. So every candidate pair is confirmed, refused, or already
   connected, while a bucket of copies costs one pair for each copy, and no pair
   is written that is not a link. Large buckets are compared by blocks; where many
   rows of one stay apart though their signatures agree, the blocks' meetings, not
   pairs, grow with the square of these rows.
4. A candidate's signature must agree well enough for the threshold, then the
   full sets decide. Sets are made and sent only for texts that have a candidate
   whose signature agrees.
5. Links are joined to components by alternating large-star and small-star.

The number of bands makes the chance of missing a pair at the threshold about
1e-8 (``plan_bands``).

Cases: null or blank texts have an empty set and are linked with nothing; texts
with fewer words than a shingle have one shingle, the whole; rows that share a
doc_id are versions of one document, linked with each other; a null doc_id
takes no part (component_id null, kept true); an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import IS_SPACE, LOWER, cut, in_workers, mix, row_sums, runs, span_hashes, text_chunks

SHINGLE_WORDS, PERCENT = 5, 80
MISS = 1e-8
MOST_HASHES = 384
SIGNATURE_BITS = 256
_U, _W = np.uint64, np.uint32


def plan_bands(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(rows of a band, bands): the longest bands with at most MOST_HASHES minima."""
    t = min(max(percent, 1), 99) / 100
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(t**rows)))
        if rows * bands <= MOST_HASHES:
            return rows, bands
    return 1, MOST_HASHES


def least_agreement(percent: int) -> int:
    """Bits of two signatures that agree for a pair at the threshold, less 6.2 deviations."""
    p = 0.5 + percent / 200
    return max(0, math.floor(SIGNATURE_BITS * p - 6.2 * math.sqrt(SIGNATURE_BITS * p * (1 - p))))


def shingle_rows(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, sorted within each row, and the rows' n + 1 bounds."""
    start, end, first = runs((~IS_SPACE[data]).astype(np.uint8), offsets)
    word = span_hashes(LOWER[data], start, end)
    counts = np.diff(first)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bound = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first[:-1] - bound[:-1], sizes) + np.arange(bound[-1])  # first word of each shingle
    span = np.repeat(np.minimum(counts, words), sizes)
    h = span.astype(_U)
    padded = np.concatenate([word, np.zeros(words, _U)])
    for k in range(words):
        h = mix(h * _U(0x9E3779B97F4A7C15) + np.where(k < span, padded[at + k], _U(0)))
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    return h, bound


def distinct(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Marks the first of equal hashes within each row."""
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[bound[:-1][np.diff(bound) > 0]] = True
    return new


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 31, count, dtype=_W) * _W(2) + _W(1), rng.integers(0, 1 << 32, count, dtype=_W)


def minima(h: np.ndarray, bound: np.ndarray, count: int) -> np.ndarray:
    """[count, rows] minima of the universal hashes of non-empty rows."""
    a, b = _functions(count)
    x, starts = (h >> _U(32)).astype(_W), bound[:-1]
    out, work = np.empty((count, len(starts)), _W), np.empty(len(x), _W)
    for k in range(count):
        np.multiply(x, a[k], out=work)
        np.add(work, b[k], out=work)
        np.minimum.reduceat(work, starts, out=out[k])
    return out


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set digest h1 and h2, bands, s0 to s3) of each row; empty sets have no bands."""
    rows, bands = plan_bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                h, bound = shingle_rows(data, offsets, words)
                new = distinct(h, bound)
                n = row_sums(new.astype(np.int64), bound)
                digests = [row_sums(np.where(new, mix(h + _U(c)), _U(0)), bound).view(np.int64) for c in (0x1234567, 0x89ABCDEF)]
                full = np.flatnonzero(n > 0)
                keys, bits = np.zeros((len(full), bands), np.int64), np.zeros((len(full), 4), np.int64)
                if len(full):
                    low = minima(h, np.append(bound[:-1][full], bound[-1]), max(rows * bands, SIGNATURE_BITS))
                    for k in range(bands):
                        key = np.full(len(full), k + 1, _U)
                        for m in low[k * rows : (k + 1) * rows]:
                            key = mix(key * _U(0x9E3779B97F4A7C15) + m.astype(_U))
                        keys[:, k] = key.view(np.int64)
                    one = (low[:SIGNATURE_BITS] * _W(0x85EBCA6B) >> _W(31)).astype(bool).T
                    bits = np.ascontiguousarray(np.packbits(one, axis=1, bitorder="little")).view(np.int64)
                lengths = np.zeros(b - a, np.int64)
                lengths[full] = bands
                every = np.zeros((b - a, 4), np.int64)
                every[full] = bits
                bands_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.array(n), *(pa.array(d) for d in digests), bands_of, *(pa.array(every[:, k].copy()) for k in range(4))], names=["doc_id", "n_shingles", "h1", "h2", "bands", "s0", "s1", "s2", "s3"])

    return in_workers(docs.select("doc_id", "text"), run, SIGNED, "neardup")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full set of each row, as distinct 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                h, bound = shingle_rows(data, offsets, words)
                new = distinct(h, bound)
                ends = np.concatenate([[0], np.cumsum(row_sums(new.astype(np.int64), bound))])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[new].view(np.int64)))], names=["id", "shingles"])

    return in_workers(docs.select("doc_id", "text"), run, "id long, shingles array<long>", "neardup")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("u", "v")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every end of ``links`` (u, v): the smallest id reachable.

    Alternates large-star and small-star until the links stay as they are; each
    round is written to the shared folder, so a lost executor costs one round.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    stamp = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    before = None
    while True:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, name)
        now = edges.agg(stamp.alias("s")).first().s
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now


def _alike(percent: int):
    """Whether two classes' sizes and signatures allow the threshold."""
    agree = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(4)), F.lit(0))
    sizes = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return sizes & (agree <= SIGNATURE_BITS - least_agreement(percent))


#: Rows of one side of a unit of comparison, and shingles of their sets; larger buckets are cut into blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs that a task looks at together.
PAIRS = 1 << 17
#: Ids that are broadcast at most (8 bytes each) to find their texts; more are joined by a shuffle.
SMALL_IDS = 500_000


def in_units(rows: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Deal the rows (bucket, id, n, c, hc) of open buckets to units of comparison.

    Only pairs of different components (c) count. Most rows of a large bucket have the
    component of its smallest row (hc); they form one side, the others the second. Each
    block of the first meets each of the second, and those meet each other. So a unit has
    ``kind`` 0 (i of the first, j of the second) or 1 (i and j of the second), and two
    blocks of rows at most; a row's ``side`` is the unit's 0 or 1, or 2 if it is both. A
    block of the second meets itself where it meets the first block of the first, so a
    bucket of one block on each side is one unit, and holds each row once.
    """
    rows = rows.withColumn("second", F.col("c") != F.col("hc"))
    of = lambda second: (F.count_if(second), F.coalesce(F.sum(F.when(second, F.col("n"))), F.lit(0)))
    (m0, n0), (m1, n1) = of(~F.col("second")), of(F.col("second"))
    blocks = lambda m, n: F.greatest(F.lit(1), F.ceil(F.col(m) / block), F.ceil(F.col(n) / BLOCK_SHINGLES)).cast("int")
    sizes = rows.groupBy("bucket").agg(m0.alias("m0"), n0.alias("n0"), m1.alias("m1"), n1.alias("n1")).where("m1 > 0")
    rows = rows.join(sizes.select("bucket", blocks("m0", "n0").alias("b0"), blocks("m1", "n1").alias("b1")), "bucket")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("second"), F.col("b1")).otherwise(F.col("b0"))).cast("int")
    unit = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    first = F.transform(F.sequence(F.lit(0), F.col("b1") - 1), lambda j: unit(0, F.col("own"), j, F.lit(0)))
    across = F.transform(F.sequence(F.lit(0), F.col("b0") - 1), lambda i: unit(0, i, F.col("own"), F.when(i == 0, 2).otherwise(1)))
    others = F.filter(F.sequence(F.lit(0), F.col("b1") - 1), lambda j: j != F.col("own"))
    inside = F.transform(others, lambda j: unit(1, F.least("own", j), F.greatest("own", j), F.when(F.col("own") < j, 0).otherwise(1)))
    return rows.withColumn("own", own).select("bucket", "id", "c", F.inline(F.when(F.col("second"), F.concat(across, inside)).otherwise(first)))


UNIT = ["bucket", "kind", "i", "j"]
#: A unit's rows, without and with their sets.
SLIM = [*UNIT, "side", "id", "c", "n", "bands", "s0", "s1", "s2", "s3"]
FULL = [*SLIM, "shingles"]


def by_unit(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(columns).repartition(*UNIT).sortWithinPartitions(*UNIT)


def _candidates(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of pairs inside units whose components differ and whose sizes and
    signatures allow the threshold, each in the first bucket that both share."""
    bucket, kind, i, j, side, c, n = (table.column(k).to_numpy() for k in ("bucket", "kind", "i", "j", "side", "c", "n"))
    rows = len(bucket)
    new = np.ones(rows, bool)
    for k in (bucket, kind, i, j):
        new[1:] &= k[1:] == k[:-1]
    new[1:] = ~new[1:]
    start = np.flatnonzero(new)
    end = np.append(start[1:], rows)[np.cumsum(new) - 1]  # of each row's unit
    bits = np.stack([table.column(f"s{k}").to_numpy() for k in range(4)], 1).view(_U)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(rows, -1)
    place = (bands == bucket[:, None]).argmax(1)
    most = SIGNATURE_BITS - least_agreement(percent)
    later = end - np.arange(rows) - 1
    reach = np.cumsum(later)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + PAIRS, "right")))
        own = later[lo:hi]
        a = np.repeat(np.arange(lo, hi), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        lo = hi
        both = (c[a] != c[b]) & ((side[a] != side[b]) | (side[a] == 2)) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[both], b[both]
        near = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= most
        a, b = a[near], b[near]
        first = (bands[a] == bands[b]).argmax(1) >= place[a] if len(a) else np.zeros(0, bool)
        yield a[first], b[first]


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units: the last unit of a batch waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(len(UNIT))], 1)
        same = (keys == keys[-1]).all(1)
        cut_at = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1  # where the last unit begins
        if waiting and (cut_at or not np.array_equal(last, keys[-1])):
            yield pa.Table.from_batches([*waiting, *([batch.slice(0, cut_at)] if cut_at else [])])
            waiting = []
        elif cut_at:
            yield pa.Table.from_batches([batch.slice(0, cut_at)])
        waiting.append(batch.slice(cut_at))
        last = keys[-1]
    if waiting:
        yield pa.Table.from_batches(waiting)


def flagged(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of units (``SLIM``) that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units_of(batches):
            mark = np.zeros(table.num_rows, bool)
            for a, b in _candidates(table, percent):
                mark[a] = mark[b] = True
            if mark.any():
                yield from table.filter(pa.array(mark)).combine_chunks().to_batches()

    return in_workers(by_unit(rows, SLIM), run, rows.select(SLIM).schema, "neardup")


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between components inside units (``FULL``), as many as join what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units_of(batches):
            ids, c = table.column("id").to_numpy(), table.column("c").to_numpy()
            held, sorted_sets = table.column("shingles").to_numpy(), {}

            def shingles(k: int) -> np.ndarray:
                if k not in sorted_sets:
                    sorted_sets[k] = np.sort(held[k])
                return sorted_sets[k]

            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while x in joined:
                    x = joined[x]
                return x

            found = []
            for firsts, seconds in _candidates(table, percent):
                edges = np.flatnonzero(np.diff(firsts, prepend=-1, append=-1))
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    a = int(firsts[lo])
                    others = [b for b in seconds[lo:hi].tolist() if root(int(c[b])) != root(int(c[a]))]
                    if not others:
                        continue
                    own, sizes = shingles(a), np.array([len(held[b]) for b in others])
                    every = np.concatenate([held[b] for b in others])
                    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                    common = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                    for k in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common)).tolist():
                        found.append((int(ids[a]), int(ids[others[k]])))
                        if root(int(c[a])) != root(int(c[others[k]])):
                            joined[root(int(c[others[k]]))] = root(int(c[a]))
            if found:
                yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return in_workers(by_unit(rows, FULL), run, "u long, v long", "neardup")


def sets_of(docs: DataFrame, ids: DataFrame, words: int, name: str) -> DataFrame:
    """(id, shingles) of the rows of ``docs`` whose doc_id is in ``ids`` (id), written once."""
    wanted = cut(ids.select("id").distinct(), f"{name}-ids").withColumnRenamed("id", "doc_id")
    few = wanted.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    kept = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return cut(shingle_sets(kept, words), name)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    signed = cut(signatures(docs, words, percent), "minhash")
    # Rows of a class are dealt to salts; each (class, salt) is one row that knows the class's smallest id.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = signed.where("n_shingles > 0 and doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    dealt = full.groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("least"))
    classes = dealt.groupBy("h1", "h2").agg(F.min("least").alias("rep"))
    parts = cut(dealt.select("h1", "h2", "salt").join(classes, ["h1", "h2"]), "classes")  # a class has ``salts`` rows at most
    first_rows = full.join(parts.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "salt", "doc_id"]).dropDuplicates(["h1", "h2", "salt", "doc_id"])
    # Versions of one document may stand for several classes under one id: an id may have several rows.
    standing = cut(first_rows.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "s0", "s1", "s2", "s3"), "standing")

    # Buckets with more than one class; each row knows the bucket's smallest.
    rows = standing.select("id", "n", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("bucket", "hub")
    shared = cut(rows.join(hubs, "bucket").select("bucket", "id", "n", "hub"), "buckets")

    slim = standing.drop("bands")
    stars = shared.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    stars = stars.join(slim.alias("b"), F.col("v") == F.col("b.id")).join(slim.alias("a"), F.col("u") == F.col("a.id")).where(_alike(percent)).select("u", "v")
    pairs = cut(stars, "stars")
    first = cut(confirm(pairs, sets_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")), words, "star-sets"), percent), "links")
    found = components(first)

    # What the stars left apart: pairs of a bucket in different components. Those with
    # the bucket's smallest are decided, so it takes no part.
    placed = shared.join(found, "id", "left").select("bucket", "id", "n", (F.col("id") != F.col("hub")).alias("rest"), F.coalesce("component", "id").alias("c"))
    rest = F.when(F.col("rest"), F.col("c"))
    open_buckets = placed.groupBy("bucket").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.min(F.when(~F.col("rest"), F.col("c"))).alias("hc")).where("lo < hi").select("bucket", "hc")
    units = in_units(placed.where("rest").join(open_buckets, "bucket").select("bucket", "id", "n", "c", "hc"))
    marked = cut(flagged(units.join(standing, "id"), percent), "flagged")
    second = linked(marked.join(sets_of(docs, marked, words, "sets"), "id"), percent)

    # Versions of a document: classes that share a doc_id.
    several = full.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo < hi").select("doc_id")
    versions = full.select("doc_id", "h1", "h2", "salt").join(several, "doc_id").join(parts, ["h1", "h2", "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(first.unionByName(second).unionByName(versions))

    home = parts.join(final, parts["rep"] == final["id"], "left").select("h1", "h2", "salt", F.coalesce("component", "rep").alias("component"))
    grouped = full.select("doc_id", "n_shingles", "h1", "h2", "salt").join(home, ["h1", "h2", "salt"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
