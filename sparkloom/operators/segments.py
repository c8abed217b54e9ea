"""Tables kept as immutable segments under a versioned manifest, merged on read.

A writer puts what changed into a new segment: its rows of every table, and markers
of the units (files, calls) whose rows in earlier segments no longer hold. Then it
publishes a manifest that names the segments. Readers take the latest manifest, so
they see one version, whole. A manifest is written once under the number that follows
the one it was made from; of two writers that began from the same version one finds
its number taken, and fails. All files are reached through Hadoop's file system.

Merging rewrites the live rows of the segments after the first, the base, as one; and
all of them when those have grown to a share of the base. So a change costs what it
writes, a read at most ``MOST`` segments, and the markers stay few.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Segments after which the younger ones are merged, and their share of the base's rows from which all are.
MOST, SHARE = 8, 0.5


def side_by_side(*tasks: Callable[[], T]) -> list[T]:
    """Results of tasks that are short jobs each: Spark runs them at once."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


class Conflict(RuntimeError):
    """Another writer has published since."""


class Segments:
    """Tables of a folder. ``schemas``: DDL of each table; ``units``: for each table its
    marker kinds and the column that such a marker names."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], units: dict[str, dict[str, str]], manifest: dict | None = None):
        self.spark, self.folder, self.schemas, self.units = spark, folder.rstrip("/"), schemas | {"gone": "kind string, unit string"}, units
        self.manifest = manifest or self._latest()

    # ---- files ----

    def _path(self, name: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _latest(self) -> dict:
        fs, at = self._path("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "segments": [], "facts": {}}
        fs, at = self._path(f"manifests/{names[-1]}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        fs, at = self._path(name)
        fs.delete(at, True)

    # ---- reading ----

    @property
    def facts(self) -> dict:
        return self.manifest["facts"]

    def segment(self, table: str, number: int) -> DataFrame:
        """Rows that one segment has written, with its number."""
        return self._rows(table, [s for s in self.manifest["segments"] if s["seg"] == number])

    def rows(self, table: str) -> DataFrame:
        """Rows of all segments, dead ones too, with ``seg``."""
        return self._rows(table, self.manifest["segments"])

    def _rows(self, table: str, segments: list[dict]) -> DataFrame:
        schema = self.schemas[table] + ", seg long"
        paths = [f"{self.folder}/{table}/seg={s['seg']}" for s in segments if table in s["rows"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*paths)

    def live(self, table: str) -> DataFrame:
        """Rows that hold, with ``seg``: those that no later segment's marker names."""
        rows = self.rows(table)
        for kind, column in self.units.get(table, {}).items():
            if not any(s["rows"].get("gone") for s in self.manifest["segments"]):
                break
            marks = self.rows("gone").where(F.col("kind") == kind).groupBy(F.col("unit").alias("__unit")).agg(F.max("seg").alias("__since"))
            rows = rows.join(marks, (F.col(column).cast("string") == F.col("__unit")) & (F.col("seg") < F.col("__since")), "left_anti")
        return rows

    # ---- writing ----

    def next(self) -> int:
        return 1 + max([s["seg"] for s in self.manifest["segments"]] + [self.facts.get("last_seg", 0)])

    def write(self, number: int, table: str, rows: DataFrame) -> None:
        """Write the rows of one table of a segment. Nobody reads them before they are published."""
        columns = [c.split()[0] for c in _fields(self.schemas[table])]
        rows.select(*columns).write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{self.folder}/{table}/seg={number}")

    def written(self, number: int, table: str) -> DataFrame:
        """What was written for a segment that is not published yet."""
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{table}/seg={number}")

    def publish(self, segment: dict, facts: dict, instead: list[int] = ()) -> None:
        """Name a written segment in a new manifest, ``instead`` of these. Its rows by table:
        a number for each table that was written, 0 if it is known to be empty."""
        kept = [s for s in self.manifest["segments"] if s["seg"] not in instead]
        fresh = {"version": self.manifest["version"] + 1, "segments": sorted([*kept, segment], key=lambda s: s["seg"]), "facts": self.facts | facts | {"last_seg": segment["seg"]}}
        name = f"manifests/{fresh['version']:012d}"
        fs, aside = self._path(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(fresh).encode()))
        out.close()
        _, target = self._path(f"{name}.json")
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(f"version {fresh['version']} of {self.folder} is taken")
        before, self.manifest = self.manifest, fresh
        # A reader may still hold the version before; what only older ones name goes.
        named = {s["seg"] for m in (before, fresh) for s in m["segments"]}
        for s in before.get("dropped", []):
            if s not in named:
                for table in self.schemas:
                    self.remove(f"{table}/seg={s}")
        fresh["dropped"] = [s["seg"] for s in before["segments"] if s["seg"] not in {x["seg"] for x in fresh["segments"]}]

    def due(self, weight: str) -> list[int]:
        """Segments to be merged now, none if it is not time; sizes are rows of the table ``weight``."""
        every = self.manifest["segments"]
        if len(every) < 2:
            return []
        young, base = [s["rows"].get(weight, 0) for s in every[1:]], every[0]["rows"].get(weight, 0)
        if sum(young) + sum(s["rows"].get("gone", 0) for s in every[1:]) > max(1000, SHARE * base):
            return [s["seg"] for s in every]
        return [s["seg"] for s in every[1:]] if len(every) > MOST else []


def _fields(ddl: str) -> list[str]:
    """Fields of a DDL string; commas inside of types don't part them."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]
