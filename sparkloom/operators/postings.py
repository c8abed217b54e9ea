"""Positional postings kept in segments, with a bound for each block, and search on them.

A segment holds its documents (key, unit, the words of each field) and, for each
word and span of up to ``SPAN`` documents, one block: the documents' places in the
span, occurrences, lengths and positions in ascending order, which the Parquet
writer delta-codes, and the block's most occurrences and shortest length. Blocks are
written in order of words, so a search reads the row groups of its words alone, and
the positions only for a phrase.

A word's weight needs the number of live documents that hold it. Blocks count what
was written; a segment that voids documents of earlier ones also writes, for each of
their words, how many (``minus``), and which places are dead. So scores are those of
the live documents alone, whatever the segments.

Top k: no document of a span can score more than the sum of its blocks' bounds, each
the score of the most occurrences in the shortest length. The spans with the highest
bounds are scored first; of the others those follow whose bound reaches the k-th
score that was found, and no more is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import lexical
from sparkloom.operators.segments import Segments, side_by_side
from sparkloom.workers import in_workers

SPAN_BITS = 10
SPAN = 1 << SPAN_BITS
#: Words whose blocks a task makes together; what it holds follows them, not the batch.
PART_WORDS = 1 << 18
#: Spans that are scored first, to know a k-th score.
FIRST_SPANS = 4

DOCS = "span long, offset int, key {key}, unit string, dl int, fields array<array<string>>"
BLOCKS = "term string, span long, n int, max_tf int, min_dl int, offsets array<int>, tfs array<int>, dls array<int>, positions array<array<int>>"
DEAD = "of_seg long, span long, offset int"
MINUS = "term string, n long"


def schemas(key: str = "string") -> dict[str, str]:
    return {"docs": DOCS.format(key=key), "blocks": BLOCKS, "dead": DEAD, "minus": MINUS}


UNITS = {"docs": {"file": "unit"}}


def documents(rows: DataFrame, key: str, unit: Column, fields: Column) -> DataFrame:
    """Rows of the table ``docs``: each under a place of its own in a span of its partition.

    ``fields``: an array of the word arrays that are searched; no phrase reaches from one into the next.
    """
    whole = F.transform(fields, lambda f: F.coalesce(f, F.array().cast("array<string>")))
    placed = rows.select(F.col(key).alias("key"), unit.alias("unit"), whole.alias("fields"), F.monotonically_increasing_id().alias("__at"))
    length = F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f))
    return placed.select(F.shiftright("__at", SPAN_BITS).alias("span"), F.col("__at").bitwiseAND(F.lit(SPAN - 1)).cast("int").alias("offset"), "key", "unit", length.alias("dl"), "fields")


def _blocks_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All blocks of a batch of documents (span, offset, dl, fields)."""
    span, offset, dl = (batch.column(c).to_numpy() for c in ("span", "offset", "dl"))
    outer = batch.column("fields")
    field_at = outer.offsets.to_numpy().astype(np.int64)
    inner = outer.values
    word_at = inner.offsets.to_numpy().astype(np.int64) if len(inner) else np.zeros(1, np.int64)
    words = inner.values.slice(word_at[field_at[0]], word_at[field_at[-1]] - word_at[field_at[0]])
    per_field = np.diff(word_at[field_at[0] : field_at[-1] + 1])
    of_field = np.diff(field_at)
    doc_of_field = np.repeat(np.arange(len(of_field)), of_field)
    number = np.arange(len(per_field)) - np.repeat(field_at[:-1] - field_at[0], of_field)  # of the field in its document
    doc = np.repeat(doc_of_field, per_field)
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc_of_field, per_field, len(of_field)).astype(np.int64))])
    # A field begins one place later than the last one ended, so no phrase reaches across.
    position = np.arange(len(doc)) - starts[doc] + np.repeat(number, per_field)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")  # places of a word stay in order of documents and positions
    code, doc, position = code[order], doc[order], position[order]
    fresh = lambda *of: np.flatnonzero(np.concatenate([np.ones(min(1, len(of[0])), bool), np.logical_or.reduce([x[1:] != x[:-1] for x in of])]))
    post = fresh(code, doc)  # where a document's postings begin
    tf = np.diff(np.append(post, len(code)))
    code, doc = code[post], doc[post]
    block = fresh(code, span[doc])
    n = np.diff(np.append(block, len(code)))
    at = pa.array(np.append(block, len(code)).astype(np.int32))
    reduced = lambda f, x: f.reduceat(x, block) if len(block) else x[:0]
    lists = lambda x: pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32)))
    places = pa.ListArray.from_arrays(pa.array(np.append(post, len(position)).astype(np.int32)), pa.array(position.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(code[block])), pa.array(span[doc[block]]), pa.array(n.astype(np.int32)), pa.array(reduced(np.maximum, tf).astype(np.int32)), pa.array(reduced(np.minimum, dl[doc]).astype(np.int32)), lists(offset[doc]), lists(tf), lists(dl[doc]), pa.ListArray.from_arrays(at, places)],
        names=[f.split()[0] for f in BLOCKS.split(", ")],
    )


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``PART_WORDS`` words, or one document."""
    ends, a = np.cumsum(lengths), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_WORDS, "right")))
        yield a, b
        a = b


def blocks(docs: DataFrame) -> DataFrame:
    """The blocks of documents; what a part of a batch has of a span is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _parts(batch.column("dl").to_numpy()):
                yield _blocks_of(batch.slice(a, b - a))

    return in_workers(docs.select("span", "offset", "dl", "fields"), run, BLOCKS, "postings")


def add(store: Segments, number: int, docs: DataFrame, gone: DataFrame | None = None) -> tuple[dict[str, int], dict]:
    """Write the segment's documents and blocks, and what it voids of earlier ones:
    the documents of units in ``gone`` (unit). Rows by table, and the new facts."""
    facts = store.facts
    store.write(number, "docs", docs)
    own = store.written(number, "docs")

    def indexed() -> tuple[int, int]:
        size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        if size.n <= SPAN:
            made = blocks(own.coalesce(1))
        else:
            # Ranges are found from words and spans alone; a frequent word's blocks are split by span.
            aside = f"aside/blocks-{number}"
            blocks(own).write.mode("overwrite").parquet(f"{store.folder}/{aside}")
            made = store.spark.read.schema(BLOCKS).parquet(f"{store.folder}/{aside}").repartitionByRange("term", "span")
        store.write(number, "blocks", made.sortWithinPartitions("term", "span"))
        if size.n > SPAN:
            store.remove(aside)
        return size.n, size.length

    def voided() -> tuple[int, int]:
        if gone is None or not store.manifest["segments"]:
            return 0, 0
        void = store.live("docs").join(gone.select("unit").distinct(), "unit", "left_semi").persist()
        try:
            lost = void.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            if lost.n:
                store.write(number, "dead", void.select(F.col("seg").alias("of_seg"), "span", "offset"))
                store.write(number, "minus", _words(void))
            return lost.n, lost.length
        finally:
            void.unpersist()

    (n, length), (dead, less) = side_by_side(indexed, voided)
    wrote = {"docs": n, "blocks": n} | ({"dead": dead, "minus": dead} if dead else {})
    return wrote, {"docs": facts.get("docs", 0) + n - dead, "length": facts.get("length", 0) + length - less}


def merged(store: Segments, number: int, segments: list[int]) -> dict[str, int]:
    """Write the live documents of ``segments`` as one segment, under new places; rows by table.

    What the merged ones void in other segments stays void: their dead places, and for
    each word how many of these places have it.
    """
    live = store.live("docs").where(F.col("seg").isin(segments))
    wrote, _ = add(store, number, documents(live, "key", F.col("unit"), F.col("fields")))
    others = [s["seg"] for s in store.manifest["segments"] if s["seg"] not in segments]
    if others:
        dead = store.rows("dead").where(F.col("of_seg").isin(others) & F.col("seg").isin(segments))
        store.write(number, "dead", dead)
        void = store.rows("docs").join(dead.select(F.col("of_seg").alias("seg"), "span", "offset"), ["seg", "span", "offset"], "left_semi")
        store.write(number, "minus", _words(void))
        wrote["dead"] = wrote["minus"] = store.written(number, "dead").count()
    return wrote


def _words(docs: DataFrame) -> DataFrame:
    """(term, n): documents with each word."""
    return docs.select(F.explode(F.array_distinct(F.flatten("fields"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _back(places: int):
    return lambda position: position - places


@dataclass
class Searcher:
    """Search over the live documents of a store's segments."""

    store: Segments

    @property
    def count(self) -> int:
        return self.store.facts.get("docs", 0)

    @property
    def mean(self) -> float:
        return self.store.facts.get("length", 0) / self.count if self.count and self.store.facts.get("length") else 1.0

    def _blocks(self, words: list[str]) -> DataFrame:
        return self.store.rows("blocks").where(F.col("term").isin(words))

    def _alive(self, postings: DataFrame) -> DataFrame:
        if not any(s["rows"].get("dead") for s in self.store.manifest["segments"]):
            return postings
        dead = self.store.rows("dead").select(F.col("of_seg").alias("seg"), "span", "offset").distinct()
        return postings.join(dead, ["seg", "span", "offset"], "left_anti")

    def weights(self, words: list[str]) -> dict[str, float]:
        """Of each word that a live document holds; a row for each word of the query comes to the driver."""
        held = self._blocks(words).groupBy("term").agg(F.sum("n").alias("n"))
        lost = self.store.rows("minus").where(F.col("term").isin(words)).select("term", (-F.col("n")).alias("n"))
        every = held.unionByName(lost).groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")
        weighed = every.select("term", lexical.idf(F.lit(float(self.count)), F.col("n")).alias("w"))
        return {r.term: r.w for r in weighed.collect()}

    def _weight(self, weights: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]

    def bounds(self, weights: dict[str, float]) -> DataFrame:
        """(seg, span, bound): what no document of a span can exceed."""
        most = lexical.contribution(self._weight(weights), F.col("max_tf"), F.col("min_dl"), F.lit(self.mean))
        heads = self._blocks(list(weights)).groupBy("seg", "span", "term").agg(F.max(most).alias("most"))  # a word may have several blocks in a span
        return heads.groupBy("seg", "span").agg(F.sum("most").alias("bound"))

    def word_scores(self, weights: dict[str, float], spans: DataFrame | None = None) -> DataFrame:
        """(seg, span, offset, score) of the documents with one of the words, in ``spans`` or all."""
        heads = self._blocks(list(weights)).select("seg", "span", "term", F.arrays_zip("offsets", "tfs", "dls").alias("p"))
        if spans is not None:
            heads = heads.join(spans.select("seg", "span"), ["seg", "span"], "left_semi")
        each = heads.select("seg", "span", "term", F.explode("p").alias("p")).select("seg", "span", F.col("p.offsets").alias("offset"), "term", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        own = lexical.contribution(self._weight(weights), F.col("tf"), F.col("dl"), F.lit(self.mean))
        return self._alive(each.select("seg", "span", "offset", own.alias("own"))).groupBy("seg", "span", "offset").agg(F.sum("own").alias("score"))

    def phrase_counts(self, phrase: list[str]) -> DataFrame:
        """(seg, span, offset, dl, tf) of live documents where the words stand one after another."""
        found = None
        for place, word in enumerate(phrase):
            rows = self._blocks([word]).select("seg", "span", F.explode(F.arrays_zip("offsets", "dls", "positions")).alias("p"))
            own = rows.select("seg", "span", F.col("p.offsets").alias("offset"), F.col("p.dls").alias("dl"), F.col("p.positions").alias("at"))
            if found is None:
                found = own
            else:
                back = own.select("seg", "span", "offset", F.transform("at", _back(place)).alias("more"))  # where the phrase would begin
                both = found.join(back, ["seg", "span", "offset"])
                found = both.withColumn("at", F.array_intersect("at", "more")).drop("more").where(F.size("at") > 0)
        return self._alive(found.select("seg", "span", "offset", "dl", F.size("at").alias("tf")))

    def scores(self, phrases: list[list[str]]) -> DataFrame:
        """(seg, span, offset, score) of every live document with one of the phrases."""
        words = [p[0] for p in phrases if len(p) == 1]
        parts = []
        if words and (weights := self.weights(list(dict.fromkeys(words)))):
            parts.append(self.word_scores(weights))
        for phrase in dict.fromkeys(tuple(p) for p in phrases if len(p) > 1):
            counts = self.phrase_counts(list(phrase))
            held = counts.agg(F.count("*").alias("df"))  # one row
            score = lexical.contribution(lexical.idf(F.lit(float(self.count)), F.col("df")), F.col("tf"), F.col("dl"), F.lit(self.mean))
            parts.append(counts.join(F.broadcast(held)).select("seg", "span", "offset", score.alias("score")))
        if not parts:
            return self.store.rows("docs").where("false").select("seg", "span", "offset", F.lit(0.0).alias("score"))
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        return every.groupBy("seg", "span", "offset").agg(F.sum("score").alias("score")) if len(parts) > 1 else every

    def keyed(self, scored: DataFrame) -> DataFrame:
        """(key, score)."""
        return scored.join(self.store.rows("docs").select("seg", "span", "offset", "key"), ["seg", "span", "offset"]).select("key", "score")

    def promising(self, words: list[str], k: int, digits: int = 6) -> tuple[dict[str, float], DataFrame | None]:
        """The words' weights, and the spans that may hold one of the k best (all: None)."""
        weights = self.weights(words)
        if not weights:
            return weights, None
        bounds = self.bounds(weights)
        first = bounds.orderBy(F.desc("bound"), "seg", "span").limit(FIRST_SPANS + 1).collect()
        if len(first) <= FIRST_SPANS:
            return weights, None
        seeds = self.store.spark.createDataFrame([(r.seg, r.span) for r in first[:FIRST_SPANS]], "seg long, span long")
        best = self.word_scores(weights, F.broadcast(seeds)).select(F.round("score", digits).alias("score")).orderBy(F.desc("score")).limit(k).collect()
        if len(best) < k:
            return weights, None
        return weights, bounds.where(F.col("bound") >= best[-1].score - 10.0**-digits)

    def top(self, phrases: list[list[str]], k: int, digits: int = 6) -> DataFrame:
        """(key, score): the k best by rounded score, ties by key."""
        if all(len(p) == 1 for p in phrases) and phrases:
            weights, spans = self.promising(list(dict.fromkeys(p[0] for p in phrases)), k, digits)
            scored = self.word_scores(weights, spans) if weights else self.scores([])
        else:
            scored = self.scores(phrases)
        return self.keyed(scored.withColumn("score", F.round("score", digits))).orderBy(F.desc("score"), "key").limit(k)
