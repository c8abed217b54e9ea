"""Mixing sources to target weights.

Each source's documents are dealt to blocks by a hash, so a block is a random
part of its source and the blocks' order a random permutation. A source's quota
is a number of blocks: whole passes over the source, then the first blocks of one
more pass, the last of them cut to the word. A splitting tree deals these quotas
to output shards: every node draws its left half's share of each source from the
multivariate hypergeometric distribution, and its children go on with what it
drew and what is left. A leaf, that is a shard, ends with a range of every
source's permuted blocks that no other leaf has, and draws these. Its rows are
ordered by a hash, which shuffles them locally. What a document gives to the mix
is the sum of the draws that leaves made of it.

The root's quotas are all that the driver knows: a row for each source (at most
``MOST_SOURCES``, or an error says so) and for each group of ``GROUP`` blocks.
Tasks split the tree from the root to their own range of leaves, since a node's
draw depends on its place alone; the draws are a table. Blocks have about
``BLOCK_WORDS`` words, more where there would be over ``MOST_DRAWS``, and a shard
those of ``SHARD_BLOCKS`` blocks, so shards follow the size of the mix. The table
of draws is broadcast if it has at most ``SMALL_DRAWS`` rows, and joined by a
shuffle of ids and sizes beyond. The plan does not shuffle texts, but for the one
block of each source that is cut to the word. The mix itself shuffles each drawn
text once, to its shard.

Cases: null or blank texts have size 0 and are taken 0 words; a null source is a
source of its own, the last; rows that repeat a doc_id count each on its own;
a null doc_id is a doc_id like others; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, in_workers

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_TIMES = 1.5, 2.0
#: Words of a block at least, blocks of a shard, sources at most.
BLOCK_WORDS, SHARD_BLOCKS, MOST_SOURCES = 20_000, 100, 200_000
#: Drawn blocks for which the hypergeometric draw is exact; blocks grow beyond.
MOST_DRAWS = 400_000_000
#: Blocks whose sum is one row on the driver, and draws that are broadcast (32 bytes each).
GROUP, SMALL_DRAWS = 4096, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most_times: float = MOST_TIMES) -> list[float]:
    """Words for each source: ``share`` of all by weight, at most ``most_times`` the
    source's own; what a capped source leaves goes to the others by weight."""
    budget, capped = share * sum(sizes), [False] * len(sizes)
    while True:
        left = budget - sum(most_times * n for n, c in zip(sizes, capped, strict=True) if c)
        total = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [most_times * n if c else left * w / total for n, w, c in zip(sizes, weights, capped, strict=True)]
        over = [i for i, (t, n) in enumerate(zip(out, sizes, strict=True)) if not capped[i] and t > most_times * n]
        if not over:
            return out
        for i in over:
            capped[i] = True


def _drawn(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    return int(rng.hypergeometric(good, bad, sample)) if bad else sample


def _left(own: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """What the left half of the node of leaves [lo, hi) gets of the blocks ``own`` of each source."""
    total, mid = int(own.sum()), (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    left = np.zeros(len(own), np.int64)
    need, rest = total * (mid - lo) // (hi - lo), total
    for k in np.flatnonzero(own):  # one colour after another: exact for totals of any size
        rest -= int(own[k])
        if need:
            left[k] = _drawn(rng, int(own[k]), rest, need)
            need -= int(left[k])
    return left


def leaves(quotas: np.ndarray, shards: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, start, blocks) of the leaves first..last - 1 of the splitting tree: of each
    source the leaf holds so many blocks, from its start-th in permuted order."""
    last = shards if last is None else last
    stack = [(0, shards, np.zeros(len(quotas), np.int64), np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, start, own = stack.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, start, own
            continue
        left, mid = _left(own, lo, hi, seed), (lo + hi) // 2
        stack += [(mid, hi, start + left, own - left), (lo, mid, start, left)]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shards, sources] blocks of each source in each shard."""
    return np.array([own for _, _, own in leaves(quotas, shards, seed)], np.int64).reshape(shards, len(quotas))


def drawn_blocks(spark, quotas: list[int], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(s, block, pass, shard): the blocks that the leaves draw, made by the tasks that hold the leaves."""
    sent = spark.sparkContext.broadcast((np.array(quotas, np.int64), np.array(blocks, np.int64)))  # two numbers for each source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_quotas, own_blocks = sent.value
        for batch in batches:
            ids = batch.column(0)
            if not len(ids):
                continue
            for shard, start, own in leaves(own_quotas, shards, seed, ids[0].as_py(), ids[-1].as_py() + 1):
                s = np.repeat(np.arange(len(own)), own)
                draw = np.arange(len(s)) - np.repeat(np.cumsum(own) - own, own) + start[s]
                yield pa.RecordBatch.from_pydict({"s": s.astype(np.int32), "block": draw % own_blocks[s], "pass": (draw // own_blocks[s]).astype(np.int32), "shard": np.full(len(s), shard)})

    tasks = max(1, min(shards // 64, 4096))
    return in_workers(spark.range(0, shards, 1, tasks), run, "s int, block long, pass int, shard long", "mixing")


def plan(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each row's part in the mix: doc_id, source, size, source_size, target,
    taken, and draws: array of (pass, shard, words, place), empty if nothing is taken.

    A shard's rows are ordered by ``place``. ``extra`` columns of ``docs`` are kept.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id", "source")
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    columns = ["doc_id", "source", count.alias("size"), order.alias("order"), F.xxhash64("text").alias("tie")]
    sized = cut(docs.select(*columns), "mix-sizes")
    whole_rows = docs.select(*columns, *extra) if extra else sized  # wide rows are read again rather than stored
    sources = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    sources.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [r.n for r in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share, most_times) if sum(sizes) else [0.0] * len(sizes)
    whole = [min(round(t), int(most_times * n)) for t, n in zip(goal, sizes, strict=True)]
    per_block = max(BLOCK_WORDS, -(-sum(whole) // MOST_DRAWS))
    blocks = [max(1, -(-n // per_block)) for n in sizes]
    passes = [w // n if n else 0 for w, n in zip(whole, sizes, strict=True)]
    known = spark.createDataFrame([(i, r.source, r.n, float(t), b) for i, (r, t, b) in enumerate(zip(sources, goal, blocks, strict=True))], "s int, source string, source_size long, target double, blocks long")

    def in_blocks(rows: DataFrame) -> DataFrame:
        own = rows.join(F.broadcast(known.withColumnRenamed("source", "own")), F.col("source").eqNullSafe(F.col("own"))).drop("own")  # at most MOST_SOURCES rows
        return own.withColumn("block", F.pmod("order", F.col("blocks")))

    # How far the last pass goes: the words of a source's blocks, one after another.
    held = cut(in_blocks(sized).groupBy("s", "block").agg(F.sum("size").alias("words")).withColumn("part", F.floor(F.col("block") / GROUP)), "mix-blocks")
    reached: dict[int, int] = {}
    begins = []
    for r in held.groupBy("s", "part").agg(F.sum("words").alias("n")).orderBy("s", "part").collect():  # a row for each source and GROUP blocks
        begins.append((r.s, r.part, reached.get(r.s, 0), whole[r.s] - passes[r.s] * sizes[r.s]))
        reached[r.s] = reached.get(r.s, 0) + r.n
    inner = Window.partitionBy("s", "part").orderBy("block")  # GROUP rows at most
    before = F.col("begin") + F.sum("words").over(inner) - F.col("words")
    lying = held.join(F.broadcast(spark.createDataFrame(begins, "s int, part long, begin long, rest long")), ["s", "part"]).withColumn("room", F.col("rest") - before)
    ends = {r.s: r.e for r in lying.where("room > 0").groupBy("s").agg(F.max(F.struct("block", "room", "words")).alias("e")).collect()}  # a row for each source
    quotas = [passes[s] * blocks[s] + (ends[s].block + 1 if s in ends else 0) for s in range(len(sources))]
    limits = [(s, e.block, passes[s], e.room) for s, e in ends.items() if e.room < e.words]
    draws = sum(quotas)
    shards = max(1, -(-draws // SHARD_BLOCKS))
    table = cut(drawn_blocks(spark, quotas, blocks, shards, seed), "mix-draws")
    table = table.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))  # a row for each pass
    small = F.broadcast if draws <= SMALL_DRAWS else lambda t: t

    # A block that is cut: its documents in hash order fill the words that are left.
    wide = in_blocks(whole_rows)
    cut_blocks = F.broadcast(spark.createDataFrame(limits, "s int, block long, cut_pass int, limit long"))  # at most one block of each source
    keep = ["s", "block", "doc_id", "source", "size", "source_size", "target", "order", "tie", *extra]
    sums = F.sum("size").over(Window.partitionBy("s", "block").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least("size", F.col("limit") - F.coalesce(sums, F.lit(0))))
    cut_rows = wide.join(cut_blocks, ["s", "block"]).withColumn("part", part).select(*keep, "part", "cut_pass")
    others = wide.join(cut_blocks, ["s", "block"], "left_anti").select(*keep, F.lit(None).cast("long").alias("part"), F.lit(-1).alias("cut_pass"))
    parts = [rows.join(small(table), ["s", "block"], "left") for rows in (others, cut_rows)]
    words = lambda d: F.when(d["pass"] == F.col("cut_pass"), F.col("part")).otherwise(F.col("size"))
    place = lambda d: F.xxhash64(F.lit(seed), d["shard"], d["pass"], "order", "tie")
    none = F.array().cast("array<struct<pass:int,shard:bigint>>")
    each = F.transform(F.coalesce("drawn", none), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), words(d).alias("words"), place(d).alias("place")))
    out = parts[0].unionByName(parts[1]).withColumn("draws", F.filter(each, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *extra)


def mixed(docs: DataFrame, seed: int = 0, places: bool = True, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw, a shard in one partition and in its order.

    A draw that takes part of a document holds its first words, joined by single
    spaces. Rows carry the columns of ``docs``; with ``places`` mix_shard and
    mix_order as well, which then stand for columns of ``docs`` with these names.
    """
    kept = [c for c in docs.columns if not (places and c in ("mix_shard", "mix_order"))]
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    rows = plan(packed, seed, extra=("__row",), **options).select(F.col("__row.text").alias("text"), "size", "__row", F.explode("draws").alias("draw"))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), 1, F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") < F.col("size"), some).otherwise(F.col("text"))
    drawn = rows.select(F.col("__row").withField("text", text).alias("__row"), F.col("draw.shard").alias("__shard"), F.col("draw.place").alias("__place"))
    ordered = drawn.repartition("__shard").sortWithinPartitions("__shard", "__place")
    return ordered.select("__row.*", *([F.col("__shard").alias("mix_shard"), F.col("__place").alias("mix_order")] if places else []))
