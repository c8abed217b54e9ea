"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.

1. language: documents without a letter, or whose bytes the best language's
   trees cannot code in fewer than 8 bits each, go.
2. quality: documents that the classifier scores below 0.5 go.
3. near duplicates: of each group (five-word shingles, similarity of 0.8 or
   more) the document with the smallest id stays; a document without an id, or
   without words, is a group of its own. Rows that repeat an id are equally kept.
4. mixing: documents are repeated, kept, cut or dropped as the mix takes them.
5. packing: the mix's tokens in windows, from the mix's own shards in their order, so
   that its proportions hold in every shard; no window holds a document twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language, mixing, neardup, packing, quality
from sparkloom.llm.common import cut, id_bucket
from sparkloom.llm.tokens import public_path

#: Bits for a byte from which a text is like no language: raw bytes take no more.
MOST_BITS = 8.0


def whole_rows(docs: DataFrame) -> DataFrame:
    """(text, row): the text, and all other columns in one, so that no name can clash."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from (text, row)."""
    return rows.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = language.train(docs.where(id_bucket("doc_id", 5) != 0))
    known = language.predict(whole_rows(docs), trees, ["row", "text"])
    return as_before(known.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS)), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = quality.train(quality.labelled(docs, labels))
    return as_before(quality.score(whole_rows(docs), weights, bias, ["row", "text"]).where("predicted = 1"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, places=False)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_path("byte_bpe_50k.json"), gather=False, repeats=False)


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The models and tokenizers of the stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
