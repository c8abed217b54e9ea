"""Weighted reciprocal-rank fusion of a lexical and a vector ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

K_FUSE = 60
TEST, DOCS, PATH, ROUTE = 0.6, 0.7, 1.5, 1.5
OVERFETCH = 3


def ranked(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows with their rank from 1; the sort needs only what a limit keeps."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(lists: list[tuple[DataFrame, float]], key: str, k_fuse: int = K_FUSE) -> DataFrame:
    """(key, score, seen): sum of weight / (k_fuse + rank) over ranked lists (key, rank);
    ``seen`` orders keys by the list and rank where they came first."""
    parts = None
    for number, (rows, weight) in enumerate(lists):
        own = rows.select(key, (F.lit(weight) / (F.lit(k_fuse) + F.col("rank"))).alias("part"), F.struct(F.lit(number).alias("list"), "rank").alias("at"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy(key).agg(F.sum("part").alias("score"), F.min("at").alias("seen"))


def rank_symbols(fused: DataFrame, query: str, weights: tuple[float, float], limit: int, test: float = TEST, docs: float = DOCS, path: float = PATH, route: float = ROUTE) -> DataFrame:
    """Bonuses and penalties of a symbol ranking, then its ``limit`` best.

    ``fused``: qname, score, seen, file, and language, decorators (may be null).
    In this order: a bonus for the very name, one for shared name words (not for
    documents where code is found as well), then factors for tests, documents,
    named paths and routing decorators.
    """
    kind, name = T.query_class(query), T.exact_name(query)
    hints, words = T.path_hints(query), sorted(T.symbol_words(query, query=True))
    base = max(weights) / (K_FUSE + 1)
    prose = kind != "identifier"
    is_doc = F.coalesce(F.col("language"), F.lit("")).isin(*T.DOC_LANGUAGES)
    rows = fused.withColumn("code_found", F.max((~is_doc).cast("int")).over(Window.partitionBy()) == 1)
    demoted = F.lit(prose) & F.col("code_found") & is_doc
    score: Column = F.col("score")
    if name is not None:
        score = score + F.when(T.simple_name_col(F.col("qname")) == name, base).otherwise(0.0)
    if words:
        shared = F.size(F.array_intersect(T.symbol_words_col(F.col("qname")), F.array(*map(F.lit, words))))
        bonus = F.when(shared == 0, 0.0).when(shared == 1, base * 0.35).otherwise(F.least(shared, F.lit(3)) * base)
        score = score + F.when(demoted, 0.0).otherwise(bonus)
    file = F.coalesce(F.col("file"), F.lit(""))
    score = score * F.when(T.looks_like_test_col(F.col("qname"), file), test).otherwise(1.0) * F.when(demoted, docs).otherwise(1.0)
    if hints:
        found = F.lit(False)
        for hint in hints:
            found = found | file.contains(hint)
        score = score * F.when(found, path).otherwise(1.0)
    if T.asks_for_route(query):
        score = score * F.when(T.has_route_mark_col(F.col("decorators")), route).otherwise(1.0)
    return rows.withColumn("score", score).drop("code_found").orderBy(F.desc("score"), "seen", "qname").limit(limit)


def merge_terms(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """The k best of several searches; a row's score is its best."""
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)
