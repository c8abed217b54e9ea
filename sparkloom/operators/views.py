"""Nested outlines, repository maps and budgeted skeletons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sparkloom.session import shared_dir


def outline(children: DataFrame, parent: str, order: list[str], fields: list[str]) -> DataFrame:
    """(parent, members: array of structs in order, n)."""
    member = F.struct(*order, *[f for f in fields if f not in order])
    return children.groupBy(parent).agg(F.sort_array(F.collect_list(member)).alias("members")).withColumn("n", F.size("members"))


def repository_map(symbols: DataFrame, prefix: str | None = None, depth: int = 1) -> DataFrame:
    """(dir, file, module_doc, symbols, symbol_count) of files with something to show.

    symbols: qname, kind, file, line_start, signature, docstring, parent_qname.
    Top-level names alone at depth 1; their direct members nested at depth 2. The
    first module's doc string stands for its file.
    """
    if depth not in (1, 2):
        raise ValueError("depth is 1 or 2")
    rows = symbols if prefix is None else symbols.where((F.col("file") == prefix) | F.col("file").startswith(prefix.rstrip("/") + "/"))
    tops = rows.where("parent_qname is null")
    inner = rows.where("parent_qname is not null").groupBy(F.col("parent_qname").alias("qname")).agg(F.sort_array(F.collect_list(F.struct("line_start", "kind", F.col("qname").alias("member"), "signature"))).alias("children")) if depth == 2 else None
    if inner is not None:
        tops = tops.join(inner, "qname", "left")
    else:
        tops = tops.withColumn("children", F.lit(None).cast("array<struct<line_start:int,kind:string,member:string,signature:string>>"))
    shown = F.when(F.col("kind") != "module", F.struct("line_start", "kind", "qname", "signature", "children"))
    doc = F.when(F.col("kind") == "module", F.struct("line_start", "docstring"))
    files = tops.groupBy("file").agg(F.sort_array(F.collect_list(shown)).alias("symbols"), F.min(doc).alias("doc"))
    files = files.where((F.size("symbols") > 0) | F.col("doc.docstring").isNotNull())
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit("."))
    return files.select(folder.alias("dir"), "file", F.col("doc.docstring").alias("module_doc"), "symbols", F.size("symbols").alias("symbol_count"))


def running_sums(rows: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """``rows`` with ``used``: the sum of ``size`` up to each row of its group in order.

    Rows are dealt to ranges of (group, order), so a group may span tasks. Each range's
    sum for a group is one row; sums of the ranges before are added to sums within the
    range. ``order`` must tell rows of a group apart.
    """
    keys = [*group, *order]
    path = f"{shared_dir(rows.sparkSession)}/sums-{uuid.uuid4().hex}"
    # Written, so that a row stays in the range that its sum is made for.
    rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("__range", IntegerType())])).parquet(path)
    parts = dealt.groupBy(*group, "__range").agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = parts.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("__range") == F.col("__at")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    summed = dealt.withColumn("__own", F.sum(size).over(inside)).join(offsets, on)
    return summed.select(*rows.columns, (F.col("__own") + F.col("__before")).alias("used"))


def within_budget(blocks: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Blocks in order up to the first that overflows the budget; a later one that
    would fit stays out as well."""
    return running_sums(blocks, group, order, size).where(F.col("used") <= budget)


def merge_roots(scored: DataFrame, root: str, key: str, per_root: int, k: int) -> DataFrame:
    """The best rows of each root, then of all; scores were made per root."""
    best = Window.partitionBy(root).orderBy(F.desc("score"), key)
    return scored.withColumn("root_rank", F.row_number().over(best)).where(F.col("root_rank") <= per_root).orderBy(F.desc("score"), root, key).limit(k)
