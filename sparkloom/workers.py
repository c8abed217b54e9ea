"""Python workers that tasks share: batches of bounded size, and freed memory given back."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What a worker keeps between tasks, and the operator that it is kept for.
kept_by_workers: list[dict] = []
_owner: list[str] = [""]


def _trim() -> None:
    """Give memory that tasks have freed back to the machine, for the executor's other processes."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator], owner: str) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that tasks of several operators share: what another
    operator keeps there is dropped first, and freed memory is given back at the end."""

    def task(batches: Iterator) -> Iterator:
        if _owner[0] != owner:
            for kept in kept_by_workers:
                kept.clear()
            _owner[0] = owner
            _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


#: Bytes of an Arrow batch that goes to a worker, beyond which a batch ends after the row.
BATCH_BYTES = 8 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_workers(rows: DataFrame, run: Callable[[Iterator], Iterator], schema, owner: str) -> DataFrame:
    """``rows.mapInArrow`` in lean workers, in batches of bounded size however long the rows are."""
    conf = rows.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", conf.get(_BATCH_LIMIT).lower()).groups()
    limit = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] if int(number) > 0 else 0
    if not 0 < limit <= BATCH_BYTES:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return rows.mapInArrow(lean(run, owner), schema)
