"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal) updates.

Words are runs of letters, digits and bytes above 127, or runs of other marks.
Each text gives four families of n-grams, all hashed into one table: words,
pairs of words (a word said twice in a row is one special pair), the words'
shapes (case, digits, marks) and pairs of shapes. A family's value is its share
of occurrences in the text, so a score is a bias plus sparse dot products, and
does not depend on a text's length as such.

The model learns from a bounded sample of labelled rows: those whose hash of id and
text lies below the share that gives about ``SAMPLE_DOCS`` documents, and of them
the first by that hash with up to ``SAMPLE_ENTRIES`` table entries together, at least
one; each document whole, rows with equal id, text and label once.

Cases: null and empty texts score with the bias alone; without labelled rows
every score is 0.5; rows that repeat a doc_id are scored each on its own and
learn from every label row; labels that are null are left out; null ids are not
held out; other columns don't enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import LOWER, cut, id_bucket, in_workers, mix, row_sums, runs, span_hashes, text_chunks

TABLE_BITS = 18
SAMPLE_DOCS = 6000
SAMPLE_ENTRIES = 6_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 0.02, 1e-4, 1e-4
FAMILIES = 4

_KIND = np.full(256, 2, np.uint8)  # 1 word, 2 mark, 0 white space
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_U = np.uint64


def _table(h: np.ndarray, family: int) -> np.ndarray:
    salt = _U((family + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)
    return (mix(h + salt) >> _U(64 - TABLE_BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the table entries of all n-grams, row after row, and the rows' n + 1 bounds."""
    start, end, first = runs(_KIND[data], offsets)
    n, rows = len(start), len(offsets) - 1
    word = span_hashes(LOWER[data], start, end)
    if n:
        upper = np.add.reduceat(np.append((data >= 65) & (data < 91), False).astype(np.int64), np.stack([start, end], 1).ravel())[::2]
        size = end - start
        lead = data[start]
        mark = _KIND[lead] == 2
        shape = np.where(mark, 8 + lead.astype(np.int64) * 4 + np.minimum(size, 4) - 1, np.where((lead >= 48) & (lead < 58), 1, np.where((upper == size) & (size > 1), 2, np.where(upper > 0, 3, 4))))
        shape = shape.astype(_U)
    else:
        shape = np.zeros(0, _U)
    counts = np.diff(first)
    inner = np.ones(n, bool)
    inner[first[1:][counts > 0] - 1] = False  # the last word of a row opens no pair
    left = np.flatnonzero(inner)
    left = left[left < n - 1] if n else left
    pair_first = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
    same = word[left] == word[left + 1] if n else np.zeros(0, bool)
    pairs = np.where(same, _U(7), word[left] * _U(0x9E3779B97F4A7C15) + word[left + 1]) if n else np.zeros(0, _U)
    shapes = shape[left] * _U(0x9E3779B97F4A7C15) + shape[left + 1] if n else np.zeros(0, _U)
    assert len(first) == rows + 1
    return [(_table(word, 0), first), (_table(pairs, 1), pair_first), (_table(shape, 2), first), (_table(shapes, 3), pair_first)]


def score_rows(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Margins of all rows of a chunk."""
    out = np.full(len(offsets) - 1, bias)
    for entries, first in features(data, offsets):
        out += row_sums(weights[entries], first) / np.maximum(np.diff(first), 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal updates for logistic loss."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        """One example: distinct entries ``at`` with ``values``."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


BIAS_AT = 1 << TABLE_BITS


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_entries: int = SAMPLE_ENTRIES, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (doc_id, text, label), with their hash as ``order`` if it is
    known: see the module's sample bounds."""
    rows = labelled.where("label is not null")
    rows = rows.select("text", "label", "order" if "order" in rows.columns else F.xxhash64("doc_id", "text").alias("order"), "doc_id")
    known = rows.agg(F.approx_count_distinct("order").alias("n"), F.min("order").alias("first")).first()
    share = min(1.0, sample_docs / max(known.n, 1))
    chosen = rows.where((F.col("order") / F.lit(2.0**64) + 0.5 <= share) | (F.col("order") == F.lit(known["first"]))).dropDuplicates(["order", "label"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column("text")):
                own = features(data, offsets)
                entries, values = [], []
                for r in range(b - a):
                    at = np.concatenate([e[f[r] : f[r + 1]] for e, f in own])
                    v = np.concatenate([np.full(f[r + 1] - f[r], 1 / max(1, f[r + 1] - f[r])) for _, f in own])
                    distinct, inverse = np.unique(at, return_inverse=True)
                    entries.append(distinct.astype(np.int32))
                    values.append(np.bincount(inverse, v, len(distinct)).astype(np.float32))
                yield pa.RecordBatch.from_pydict({"entries": pa.array(entries, pa.list_(pa.int32())), "values": pa.array(values, pa.list_(pa.float32())), "label": batch.column("label")[a:b].cast(pa.int32()), "order": batch.column("order")[a:b], "doc_id": batch.column("doc_id")[a:b]})

    table = in_workers(chosen, hashed, "entries array<int>, values array<float>, label int, order long, doc_id long", "quality")
    table = cut(table, "quality-sample")
    sizes = table.select("order", F.size("entries").alias("n")).toPandas().groupby("order")["n"].sum().sort_index().cumsum()  # a row for each document of the sample
    last = int(sizes.index[max(1, int((sizes <= sample_entries).sum())) - 1]) if len(sizes) else None
    sample = table.where(F.col("order") <= last).orderBy("order", "doc_id", "label").toArrow() if last is not None else None
    examples = []  # views of the table's own buffers
    if sample is not None:
        for batch in sample.to_batches():
            at, entries, values = batch.column("entries").offsets.to_numpy(), batch.column("entries").values.to_numpy(), batch.column("values").values.to_numpy()
            examples += [(entries[i:j], values[i:j], float(y)) for i, j, y in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("label").to_pylist(), strict=True)]
    model = Ftrl(BIAS_AT + 1)
    for _ in range(epochs):
        for at, values, label in examples:
            model.update(np.append(at, BIAS_AT), np.append(values, 1.0), label)
    w = model.weights()
    return w[:BIAS_AT], float(w[BIAS_AT])


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str]) -> DataFrame:
    """``docs`` (with text) -> columns ``keep``, score, predicted; ``keep`` may hold text."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    keep = [c for c in keep if c != "text"] + (["text"] if "text" in keep else [])  # a text goes to a worker once
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = source.schema.fields[: len(keep)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in text_chunks(batch.column("text")):
                out[a:b] = sigmoid(score_rows(data, offsets, w, b0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*(f.name for f in fields), "score", "predicted"])

    return in_workers(source, run, schema, "quality")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, order, label) of rows that may be learned from: crc32(doc_id) mod 3 is not 1.

    The hash is made before the join, so that only the sample's texts go through it.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").alias("label"))
    return docs.where(id_bucket("doc_id", 3) != 1).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("order")).join(known, "doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs``, learned from the labelled ones that are not held out."""
    weights, bias = train(labelled(docs, labels))
    return score(docs.select("doc_id", "text", (id_bucket("doc_id", 3) == 1).alias("held_out")), weights, bias, ["doc_id", "held_out"])
