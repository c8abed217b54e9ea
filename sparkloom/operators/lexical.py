"""BM25 and searches by it over kept postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def contribution(weight: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avgdl))


def top(rows: DataFrame, key: str, k: int, digits: int = 6) -> DataFrame:
    """The k best by rounded score, ties by key."""
    return rows.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), key).limit(k)


def search_kind(searcher, phrases: list[list[str]], of_kind: DataFrame, k: int) -> DataFrame:
    """The k best rows of a kind (``of_kind``: key); if there are none, of any kind (kind_filter_dropped)."""
    every = searcher.keyed(searcher.scores(phrases))
    kept = every.join(of_kind, "key", "left_semi")
    found = not kept.isEmpty()
    return top(kept if found else every, "key", k).withColumn("kind_filter_dropped", F.lit(not found))
