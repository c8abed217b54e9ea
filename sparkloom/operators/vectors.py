"""Dense vectors: embedding interface, exact dot-product top-k, upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import identifier_words, singular

DIMENSIONS = 384


class Embedder(Protocol):
    """Turns texts into unit vectors. Any model can stand behind it."""

    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of name words and their three-letter parts: no model
    file is needed, equal words give near vectors, paraphrases don't."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in map(singular, identifier_words(text)):
                grams = {f"{word}#"} | {f"#{word}#"[i : i + 3] for i in range(len(word))}
                for gram in sorted(grams):
                    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                    row[h % self.dimensions] += (1.0 if h >> 63 else -1.0) * (2.0 if gram.endswith("#") and gram[0] != "#" else 0.5)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed_column(rows: DataFrame, key: str, text: Column, embedder: Embedder) -> DataFrame:
    """(key, vector array<float>) of each row, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vector": list(embedder.embed(batch["text"].fillna("").tolist()))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text.alias("text")).mapInPandas(run, f"`{key}` {kind}, vector array<float>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None, digits: int = 6) -> DataFrame:
    """The k rows with the largest inner product; the filter comes before the scoring."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.where(F.col(vector).isNotNull()).select(key, F.round(dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), digits).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def missing(symbols: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Symbols without a vector."""
    return symbols.join(vectors.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
