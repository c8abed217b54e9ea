"""Postings of a table of texts, kept in the shared folder and brought up to date by file.

A file of the table is the unit of change: its documents go to the segment that is
written when the file is first seen or has another size or time, and are void from the
next one on. So a search pays for files that changed since the last one, and reads
postings otherwise.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import postings, snapshots
from sparkloom.operators.segments import Segments
from sparkloom.session import shared_dir

#: Changed files that are read by name; more of them are found by a join.
NAMED = 1000
SOURCES = "unit string, state string"


def text_postings(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> postings.Searcher:
    """Search over the words of ``text`` in the Parquet table at ``path``; rows with equal keys are documents of their own."""
    name = hashlib.sha1(f"{path}\0{key}\0{text}".encode()).hexdigest()
    rows = spark.read.parquet(path)
    kind = rows.schema[key].dataType.simpleString()
    store = Segments(spark, f"{shared_dir(spark)}/postings-{name}", postings.schemas(kind) | {"sources": SOURCES}, postings.UNITS | {"sources": {"file": "unit"}})
    refresh(store, rows, key, F.array(T.words(F.coalesce(text, F.lit("")))))
    return postings.Searcher(store)


def refresh(store: Segments, rows: DataFrame, key: str, fields: Column) -> dict[str, int]:
    """One segment for the files of ``rows`` that were added, changed or removed; their numbers."""
    file = F.col("_metadata.file_path")
    now = rows.select(file.alias("unit"), F.concat_ws(" ", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).alias("state")).distinct()
    status = snapshots.changes(store.live("sources").select("unit", "state"), now, "unit", "state").where("status <> 'unchanged'").persist()
    try:
        counts = {r.status: r.n for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return counts
        fresh, gone = status.where("status <> 'removed'").select("unit"), status.where("status <> 'added'").select("unit")
        if store.manifest["segments"]:
            few = counts.get("added", 0) + counts.get("changed", 0) <= NAMED
            names = [r.unit for r in fresh.collect()] if few else []
            changed = rows.sparkSession.read.schema(rows.schema).parquet(*names) if names else rows.where("false") if few else rows.join(fresh, file == F.col("unit"), "left_semi")
        else:
            changed = rows
        number = store.next()
        wrote, facts = postings.add(store, number, postings.documents(changed, key, file, fields), gone if len(counts.keys() - {"added"}) else None)
        store.write(number, "sources", now.join(fresh, "unit", "left_semi"))
        wrote["sources"] = counts.get("added", 0) + counts.get("changed", 0)
        if counts.keys() - {"added"}:
            store.write(number, "gone", gone.select(F.lit("file").alias("kind"), "unit"))
            wrote["gone"] = counts.get("changed", 0) + counts.get("removed", 0)
        store.publish({"seg": number, "rows": wrote}, facts)
    finally:
        status.unpersist()
    compact(store)
    return counts


def compact(store: Segments) -> bool:
    """Merge segments if it is time."""
    due = store.due("docs")
    if due:
        number = store.next()
        wrote = postings.merged(store, number, due)
        store.write(number, "sources", store.live("sources").where(F.col("seg").isin(due)))
        wrote["sources"] = store.written(number, "sources").count()
        if len(due) < len(store.manifest["segments"]):
            store.write(number, "gone", store.rows("gone").where(F.col("seg").isin(due)).select("kind", "unit").distinct())
            wrote["gone"] = store.written(number, "gone").count()
        store.publish({"seg": number, "rows": wrote}, {}, due)
    return bool(due)
