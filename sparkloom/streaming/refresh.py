"""Watching a root: bursts of changes are debounced, then the index is refreshed."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from sparkloom.plans.index import refresh
from sparkloom.sources.scan import list_files

log = logging.getLogger(__name__)


def stamps(root: str | Path) -> dict[str, tuple[int, int]]:
    """Time and size of every file that the scan takes."""
    base, out = Path(root), {}
    for rel in list_files(base):
        try:
            s = (base / rel).stat()
        except OSError:
            continue
        out[rel] = (s.st_mtime_ns, s.st_size)
    return out


def watch_root(spark: SparkSession, root: str | Path, debounce: float = 0.5, stop: Callable[[], bool] = lambda: False, poll: float = 0.1, on_refresh: Callable[[dict], None] | None = None) -> None:
    """Refresh once no file has changed for ``debounce`` seconds; a failed refresh is
    logged and the watch goes on until ``stop`` says so."""
    held, changed_at = stamps(root), None
    while not stop():
        time.sleep(poll)
        now = stamps(root)
        if now != held:
            held, changed_at = now, time.monotonic()
        elif changed_at is not None and time.monotonic() - changed_at >= debounce:
            changed_at = None
            try:
                counts = refresh(spark, root)
            except Exception:
                log.exception("refresh failed")
                continue
            if on_refresh:
                on_refresh(counts)
