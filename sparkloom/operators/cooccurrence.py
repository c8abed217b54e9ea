"""Word vectors from the company that words keep, without a model file.

Words that stand within ``WINDOW`` places of each other are counted in pairs; a pair
weighs its positive pointwise mutual information. The symmetric matrix of these
weights is factorised at random: its product with signs drawn from the words' hashes
spans its main directions, one more product sharpens them, and the small matrix that
is left is solved on the driver. The sparse rows of the matrix stay in tasks; what
reaches the driver is ``dims`` times ``dims`` numbers, and the vectors of at most
``MOST_WORDS`` words, which is also what is broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import identifier_words, identifier_words_col, singular, singular_col
from sparkloom.session import shared_dir

#: Places between words of a pair at most; rows with a word at least; words of the model at most, the most frequent.
WINDOW, LEAST_ROWS, MOST_WORDS, DIMENSIONS = 5, 2, 50_000, 64
_FACTOR = "word string, y array<double>"


def unordered(rows: DataFrame, words: str, window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often two different words stand within ``window`` places, a before b in the alphabet."""
    at = F.posexplode(words).alias("pos", "word")
    near = rows.select(F.col(words).alias("__words"), at).select("word", F.explode(F.slice("__words", F.col("pos") + 2, F.lit(window))).alias("other")).where("word <> other")
    return near.groupBy(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).agg(F.count("*").alias("n"))


def both_ways(rows: DataFrame, *values: str) -> DataFrame:
    """(word, other, ``values``) from rows of (a, b, ``values``)."""
    return rows.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))), *values)


def pairs(rows: DataFrame, words: str, window: int = WINDOW) -> DataFrame:
    """(word, other, n): how often two different words stand within ``window`` places, both ways."""
    return both_ways(unordered(rows, words, window), "n")


def information(counts: DataFrame) -> DataFrame:
    """(word, other, w): positive pointwise mutual information of each pair, from ``pairs``; others are 0."""
    return both_ways(_weighed(counts.where("word < other").select(F.col("word").alias("a"), F.col("other").alias("b"), "n")), "w")


def word_information(rows: DataFrame, words: str, window: int = WINDOW) -> DataFrame:
    """``information`` of the ``pairs`` of rows; a pair is shuffled in one way alone."""
    return both_ways(_weighed(unordered(rows, words, window)), "w")


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _weighed(counts: DataFrame) -> DataFrame:
    """(a, b, w) of ``unordered`` pairs. Counts and totals are written, so pairs need no
    shuffle to meet the totals of a vocabulary that Spark finds small enough to broadcast."""
    counts = _kept(counts.sortWithinPartitions("a", "b"), "pairs")
    totals = _kept(counts.select(F.explode(F.array("a", "b")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("total")), "totals")
    every = totals.agg(F.sum("total").alias("all"))  # one row
    of = lambda word: totals.select(F.col("word").alias(word), F.col("total").alias(f"{word}_total"))
    whole = counts.join(of("a"), "a").join(of("b"), "b").join(F.broadcast(every))
    n, every_n, total, other = (F.col(c).cast("double") for c in ("n", "all", "a_total", "b_total"))
    w = F.log(n * every_n / (total * other))
    return whole.select("a", "b", w.alias("w")).where("w > 0")


def _signs(word: str, dims: int) -> np.ndarray:
    """Signs that only depend on the word."""
    bits = np.unpackbits(np.frombuffer(hashlib.blake2b(word.encode(), digest_size=-(-dims // 8)).digest(), np.uint8))[:dims]
    return bits * 2.0 - 1.0


def _product(matrix: DataFrame, vector_of: Callable[[str], np.ndarray]) -> DataFrame:
    """(word, y): for each word the weighted sum of its others' vectors. ``matrix`` comes sorted by word within its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, known, out = None, None, {}, []
        for batch in batches:
            for word, other, w in zip(*[batch.column(c).to_pylist() for c in ("word", "other", "w")], strict=True):
                if other not in known:
                    if len(known) > MOST_WORDS:
                        known.clear()
                    known[other] = vector_of(other)
                if word != now:
                    if now is not None:
                        out.append((now, total))
                    now, total = word, np.zeros_like(known[other])
                total = total + w * known[other]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y.tolist() for _, y in out], pa.list_(pa.float64()))], names=["word", "y"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["word", "y"])

    return matrix.select("word", "other", "w").repartition("word").sortWithinPartitions("word").mapInArrow(run, _FACTOR)


def word_vectors(rows: DataFrame, words: str, dims: int = DIMENSIONS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(word, weight, vector) from rows with an array of words. The weight is a word's
    inverse document frequency. Words without company have no vector."""
    spark, n = rows.sparkSession, rows.count()
    df = rows.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least_rows)
    known = df.orderBy(F.desc("df"), "word").limit(MOST_WORDS).persist()
    matrix = word_information(rows, words).join(F.broadcast(known.select("word")), "word", "left_semi").join(F.broadcast(known.select(F.col("word").alias("other"))), "other", "left_semi").persist()
    try:
        vectors = {r.word: np.array(r.y) for r in _product(matrix, lambda w: _signs(w, dims)).toLocalIterator()}  # at most MOST_WORDS
        for last in (False, True):
            names = sorted(vectors)
            if not names:
                return spark.createDataFrame([], "word string, weight double, vector array<float>")
            basis, _ = np.linalg.qr(np.array([vectors[w] for w in names]))  # its columns span the main directions
            shared = spark.sparkContext.broadcast(dict(zip(names, basis, strict=True)))
            zero = np.zeros(basis.shape[1])
            image = {r.word: np.array(r.y) for r in _product(matrix, lambda w: shared.value.get(w, zero)).toLocalIterator()}
            if not last:
                vectors = image
        small = basis.T @ np.array([image.get(w, zero) for w in names])
        values, axes = np.linalg.eigh((small + small.T) / 2)
        used = values > 1e-9
        found = basis @ (axes[:, used] * np.sqrt(values[used]))
        norm = np.linalg.norm(found, axis=1)
        rest = np.zeros((len(names), dims))
        rest[:, : found.shape[1]] = found / np.where(norm == 0, 1, norm)[:, None]
        made = spark.createDataFrame([(w, v.tolist()) for w, v, x in zip(names, rest, norm, strict=True) if x > 1e-9], "word string, vector array<float>")
        return made.join(known, "word").select("word", F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"), "vector")
    finally:
        known.unpersist()
        matrix.unpersist()


def name_words(text: Column) -> Column:
    """The words of ``WordEmbedder`` as a column: those of names, in the singular."""
    return F.transform(identifier_words_col(F.coalesce(text, F.lit(""))), singular_col)


class WordEmbedder:
    """Texts as the weighted mean of their words' vectors; unknown words add nothing."""

    def __init__(self, words: dict[str, tuple[float, np.ndarray]], dimensions: int = DIMENSIONS):
        self.words, self.dimensions = words, dimensions

    @classmethod
    def of(cls, table: DataFrame) -> WordEmbedder:
        """From a table (word, weight, vector) of at most ``MOST_WORDS`` rows."""
        rows = table.limit(MOST_WORDS).collect()
        return cls({r.word: (r.weight, np.array(r.vector, np.float32)) for r in rows}, len(rows[0].vector) if rows else DIMENSIONS)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in map(singular, identifier_words(text)):
                if word in self.words:
                    weight, vector = self.words[word]
                    row += np.float32(weight) * vector
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)
