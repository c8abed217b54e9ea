"""A session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may do without; it gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir("file:///tmp/checkpoints/" + context.applicationId)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def session(name: str = "sparkloom", cpus: int | None = None) -> SparkSession:
    """A local session unless a master is set from outside, as spark-submit does."""
    build = SparkSession.builder.appName(name)
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        build = build.master(f"local[{cpus or '*'}]").config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    made = build.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(cpus or os.cpu_count() or 8)).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made
