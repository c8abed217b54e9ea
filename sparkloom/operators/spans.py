"""Line tables, literal and regex search, and attribution of lines to intervals."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from sparkloom.functions import text as T


def line_table(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line from 1, txt, lines: all of the row's)."""
    rows = files.select(key, T.lines(F.col(text)).alias("lines"))
    return rows.select(key, "lines", F.posexplode("lines").alias("p", "txt")).select(key, (F.col("p") + 1).alias("line"), "txt", "lines")


def context(line: Column, lines: Column, before: int, after: int) -> tuple[Column, Column]:
    """Arrays of the lines before and after, from the row's own lines: no window is needed."""
    first = F.greatest(F.lit(1), line - before)
    return F.slice(lines, first, line - first), F.slice(lines, line + 1, F.lit(after))


# Words that begin a declaration, and the pattern of a line that is one.
DECLARING = "def|class|function|interface|type|enum|namespace|module|struct|trait|impl|fn|func|fun|var|let|const|val|protocol|extension|record|object"
DEFINITION = rf"^\s*(?:export\s+)?(?:(?:public|private|protected|internal)\s+)?(?:(?:static|final|abstract|sealed|open)\s+)?(?:pub\s+)?(?:async\s+)?(?:{DECLARING})\b|^[A-Z_][A-Z0-9_]+\s*="


def definition_literal(pattern: str) -> str:
    """Regex of a line that defines the literal."""
    name = re.escape(pattern)
    return rf"(^|\s)({DECLARING})\s+{name}(\s|[(=:<{{,])|^{name}\s*="


def grep(files: DataFrame, key: str, text: str, pattern: str, regex: bool = False, ignore_case: bool = False, around: int = 1) -> DataFrame:
    """(key, line, txt, before, after, is_definition) of each matching line.

    Texts without a match are dropped before they are cut into lines.
    """
    if regex:
        hit = lambda c: c.rlike(("(?i)" if ignore_case else "") + pattern)
        whole = hit(F.col(text)) if not re.search(r"[\^$]|\\[AZz]|\(\?", pattern) else F.lit(True)
        rule = DEFINITION
    else:
        hit = (lambda c: F.lower(c).contains(pattern.lower())) if ignore_case else (lambda c: c.contains(pattern))
        whole, rule = hit(F.col(text)), definition_literal(pattern)
    rows = line_table(files.where(whole), key, text).where(hit(F.col("txt")))
    before, after = context(F.col("line"), F.col("lines"), around, around)
    rule = ("(?i)" if ignore_case else "") + rule
    return rows.select(key, "line", "txt", before.alias("before"), after.alias("after"), F.col("txt").rlike(rule).alias("is_definition"))


def attribute(hits: DataFrame, spans: DataFrame, key: str, prefer_members: bool = True) -> DataFrame:
    """The interval (start, stop, name, is_module) that each (key, line) falls in.

    ``prefer_members``: any member before the module, then the shortest; else the
    shortest alone. Ties go to the earlier start, then the name. Lines in none have
    null. Intervals may nest or cross. Those of a key and the lines that are asked for
    pass one task in order of lines; it holds the open intervals in a heap, the best on
    top, and drops what has ended when it comes to the top. So no pair of a line and an
    interval around it is ever made, however deep they nest.
    """
    wanted = hits.select(key, F.col("line").cast("long").alias("at")).distinct()
    kinds = {c: spans.schema[c].dataType for c in ("start", "stop", "name", "is_module")}
    own = spans.join(wanted.select(key).distinct(), key, "left_semi").select(key, F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("stop").cast("long").alias("stop"), "name", "is_module")
    asked = wanted.select(key, "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("stop"), F.lit(None).cast(kinds["name"]).alias("name"), F.lit(None).cast("boolean").alias("is_module"))
    made = StructType([hits.schema[key], StructField("line", LongType()), StructField("start", LongType()), StructField("stop", LongType()), StructField("name", kinds["name"]), StructField("is_module", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = object(), []
        for batch in batches:
            out, types = [], [batch.schema.field(c).type for c in (key, "at", "at", "stop", "name", "is_module")]
            for k, at, kind, stop, name, is_module in zip(*[batch.column(c).to_pylist() for c in (key, "at", "kind", "stop", "name", "is_module")], strict=True):
                if k != now:
                    now, opened = k, []
                if kind == 0:
                    if stop is not None and at is not None and stop >= at:
                        heapq.heappush(opened, (bool(is_module) and prefer_members, stop - at, at, "" if name is None else name, name, stop, is_module))
                    continue
                while opened and opened[0][5] < at:
                    heapq.heappop(opened)
                if opened:
                    _, _, start, _, name, stop, is_module = opened[0]
                    out.append((k, at, start, stop, name, is_module))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.name for f in made])

    swept = own.unionByName(asked).repartition(key).sortWithinPartitions(key, "at", "kind").mapInArrow(run, made)
    typed = swept.select(key, F.col("line").cast(hits.schema["line"].dataType).alias("line"), *[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    return hits.join(typed, [key, "line"], "left")


def overlapping(edits: DataFrame, key: str, start: str, stop: str, *ties: str) -> DataFrame:
    """Edits that begin before an earlier one of the same file has ended; ``ties``
    order edits of the same lines."""
    ordered = Window.partitionBy(key).orderBy(start, stop, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("reached", F.max(stop).over(ordered)).where(F.col(start) <= F.col("reached"))


def splice(text: Column, start: int | Column, stop: int | Column, new_lines: Column) -> Column:
    """``text`` with its lines start..stop (from 1) replaced; a final line feed stays."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    rows = F.split(text, "\n")
    left = F.slice(rows, F.lit(1), F.greatest(F.lit(0), start - 1))
    return F.array_join(F.concat(left, new_lines, F.slice(rows, stop + 1, F.greatest(F.lit(0), F.size(rows) - stop))), "\n")


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` stands in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")
