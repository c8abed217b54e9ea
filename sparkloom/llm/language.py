"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes with the counts
of what followed them. A byte costs -log2 of its probability under the longest
context that the tree knows, where a symbol that did not follow there pays the
escape and goes on to the next shorter context (escape estimate: distinct
symbols over occurrences plus distinct symbols; no exclusion), down to 1/256.
Statistics are frozen after training, so the code length of a text is a sum of
table entries over its four-byte windows. A tree is sorted tables of the contexts
and symbols that it met, so the model grows with what was learned from, not with
languages times contexts; distinct windows of a chunk are looked up once for each
language.

Training counts are summed on the executors over a bounded sample of labelled
documents: of each language the first by a hash of id and text, up to ``SAMPLE_DOCS``
of them and until they reach the language's share of ``SAMPLE_BYTES``, at least one,
each whole. Rows with equal id and text are one document here. Every language is learned, with every context of its sample; only the
trees' counts come to the driver.

Cases: null text, or text without a letter, is ``und`` with score 0; ties go to
the language that sorts first; without training rows every text is ``und``;
rows that repeat a doc_id are scored each on its own; null ids are held out;
other columns, ``lang`` and ``source`` too, don't enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import LOWER, id_bucket, in_workers, row_sums, text_chunks

#: Documents of each language that train its tree, and bytes of all languages' documents.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 32 << 20
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last four bytes at each place, ASCII-lower-cased, zeros before a row's start."""
    low = LOWER[data].astype(np.uint32)
    w = low.copy()
    for back in (1, 2, 3):
        w[back:] |= low[:-back] << np.uint32(8 * back)
    starts = offsets[:-1][np.diff(offsets) > 0]
    ends = np.repeat(offsets[1:], 1)[np.diff(offsets) > 0]
    for back in (0, 1, 2):
        at = starts + back
        at = at[at < ends]
        w[at] &= np.uint32((1 << (8 * (back + 1))) - 1)
    return w


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted ``keys``, and where)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


@dataclass
class Tree:
    """One language's frozen contexts: bits of a byte without context, and of each order
    1 to 3 the contexts with the bits of their escapes, and the windows with their bits."""

    plain: np.ndarray  # [256]
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, w: np.ndarray, c: np.ndarray) -> Tree:
        """From distinct four-byte windows (uint32) and their counts."""
        w, orders = w.astype(np.uint32), []
        for bytes_ in (1, 2, 3, 4):
            keys, inverse = np.unique(w & np.uint32((1 << 8 * bytes_) - 1), return_inverse=True)
            count = np.bincount(inverse, c, len(keys))
            contexts, place, distinct = np.unique(keys >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(place, count, len(contexts))
            orders.append((contexts, -np.log2(distinct / (total + distinct)), keys, -np.log2(count / (total + distinct)[place])))
        _, escape, keys, bits = orders[0]
        plain = np.full(256, 8.0 + (escape[0] if len(escape) else 0.0))
        plain[keys] = bits
        return cls(plain, orders[1:])

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """Bits of each window's last byte after the three before it."""
        out = self.plain[windows & np.uint32(0xFF)]
        for n, (contexts, escape, keys, bits) in enumerate(self.orders):
            key = windows & np.uint32((1 << 8 * (n + 2)) - 1)
            known, at = _found(contexts, key >> np.uint32(8))
            out[known] += escape[at[known]]
            met, at = _found(keys, key)
            out[met] = bits[at[met]]
        return out


@dataclass
class Trees:
    """Frozen trees of all languages."""

    langs: list[str]
    trees: list[Tree]

    @classmethod
    def build(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
        """counts: for each language its windows (uint32, distinct) and their counts."""
        return cls(sorted(counts), [Tree.build(*map(np.asarray, counts[lang])) for lang in sorted(counts)])

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row's text under each language."""
        distinct, at = np.unique(windows(data, offsets), return_inverse=True)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for j, tree in enumerate(self.trees):
            out[:, j] = row_sums(tree.bits(distinct)[at], offsets)
        return out


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Trees from rows (doc_id, text, lang): see the module's sample bounds."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n"), F.min("order").alias("first")).collect()  # a row for each language
    if not sizes:
        return Trees.build({})
    # A threshold on the hash leaves a few times the sample, whatever the language's share, and the first document at least.
    shares = spark.createDataFrame([(r.lang, 4.0 * sample_docs / max(r.n, 1), r.first) for r in sizes], "lang string, share double, first long")
    near = rows.join(F.broadcast(shares), "lang").where((F.col("order") / F.lit(2.0**64) + 0.5 <= F.col("share")) | (F.col("order") == F.col("first")))
    near = near.dropDuplicates(["lang", "order"])  # copies go before the window
    first = Window.partitionBy("lang").orderBy("order", "text")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_docs)
    before = F.coalesce(F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = near.withColumn("before", before).where(F.col("before") < max(1, sample_bytes // len(sizes)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                for lang in sorted(set(langs[a:b])):
                    keep = np.array([x == lang for x in langs[a:b]])
                    w, c = np.unique(windows(data, offsets)[np.repeat(keep, np.diff(offsets))], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(w), pa.string()), "w": pa.array(w.astype(np.int64)), "n": pa.array(c.astype(np.int64))})

    counts = in_workers(chosen.select("lang", "text"), count, "lang string, w long, n long", "language").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    table = counts.toPandas()
    return Trees.build({lang: (own["w"].to_numpy().astype(np.uint32), own["n"].to_numpy().astype(np.float64)) for lang, own in table.groupby("lang")})


PREDICTION = T.StructType().add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")


def predict(docs: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """``docs`` (with text) -> columns ``keep``, lang_pred, score, bits_per_byte; ``keep`` may hold text.

    The score is the best language's share of 2 ** -bits over the languages,
    with the bits of long texts scaled down to those of 64 bytes.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    keep = [c for c in keep if c != "text"] + (["text"] if "text" in keep else [])  # a text goes to a worker once
    source = docs.select(*keep, *([] if "text" in keep else ["text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    fields = source.schema.fields[: len(keep)]
    schema = T.StructType([*fields, *PREDICTION])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            n = batch.num_rows
            pick, score, rate = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
            letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in text_chunks(batch.column("text")):
                if not model.langs:
                    continue
                bits, length = model.code_lengths(data, offsets), np.maximum(np.diff(offsets), 1)
                best = bits.argmin(1)
                rate[a:b] = bits.min(1) / length
                scaled = (bits - bits.min(1, keepdims=True)) * np.minimum(1, 64 / length)[:, None]
                score[a:b] = 1 / np.exp2(-scaled).sum(1)
                pick[a:b] = best
            pick[~letters], score[~letters] = len(model.langs), 0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(names[pick], pa.string()), pa.array(score), pa.array(rate)], names=[*(f.name for f in fields), "lang_pred", "score", "bits_per_byte"])

    return in_workers(source, run, schema, "language")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Predictions for all ``docs``, learned from those with crc32(doc_id) mod 5 other than 0."""
    trees = train(docs.where(id_bucket("doc_id", 5) != 0), sample_docs)
    return predict(docs.select("doc_id", "text", (id_bucket("doc_id", 5) == 0).alias("held_out")), trees, ["doc_id", "held_out"])
