"""Debounced change events and streaming refresh."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.session import shared_dir


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Bursts of events of a key no further apart than ``gap``: (key, started, events).

    Works on tables and, behind a watermark, on streams.
    """
    window = F.session_window(ts, gap)
    return events.groupBy(key, window.alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events")


def debounced(stream: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """``sessions`` of a stream: a burst is given out once it is over for good."""
    return sessions(stream.withWatermark(ts, late), key, ts, gap)


def watch(changes: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "500 milliseconds") -> StreamingQuery:
    """Run ``refresh`` on each micro-batch of changes. The interval is the debounce;
    a batch that failed runs again, so ``refresh`` replaces by key."""
    return changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def replay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, summed batch by batch into a table, and read.

    Each batch appends its partial sums under its number, so a batch that runs
    again overwrites its own.
    """
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = _folder(spark, "totals")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).format("parquet").load(_listed(spark, sf_dir))

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.parquet(out)
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def _listed(spark: SparkSession, sf_dir: str) -> str:
    """A path that a file stream takes: a folder of files, or one file by a pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return f"{sf_dir}/events.parquet" if status.isDirectory() else f"{sf_dir}/events*.parquet"
