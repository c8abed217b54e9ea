"""Operations over several roots at once.

Results of each root carry a ``root`` tag. Rankings are made per root and then
merged; operations on one name or path go to the root that has it.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.plans import read, write
from sparkloom.plans.index import Index, Location

MOST_THREADS = 8


def label(root: str | Path, anchor: str | Path | None) -> str:
    path = Path(root).resolve()
    return str(path.relative_to(Path(anchor).resolve())) if anchor and path.is_relative_to(Path(anchor).resolve()) else str(path)


def each_root(roots: list, run: Callable[[Path], dict]) -> tuple[list[tuple[Path, dict]], list[dict]]:
    """(answers in the roots' order, errors): jobs of all roots share the cluster."""

    def safe(root) -> tuple[Path, dict]:
        try:
            return Path(root), run(Path(root))
        except Exception as e:  # one root's failure leaves the others
            return Path(root), {"error": type(e).__name__, "hint": str(e).split("\n")[0]}

    with ThreadPoolExecutor(min(MOST_THREADS, max(1, len(roots)))) as pool:
        done = list(pool.map(safe, roots))
    return [(r, a) for r, a in done if "error" not in a], [{"root": str(r)} | a for r, a in done if "error" in a]


def _tagged(items: list[dict], root: Path, anchor) -> list[dict]:
    return [{"root": label(root, anchor)} | i for i in items]


def search_code_multi(spark: SparkSession, query: str, roots: list, k: int = 5, anchor=None, **options) -> dict:
    found, errors = each_root(roots, lambda r: read.search_code(spark, query, k, root=r, **options))
    hits = sorted((h for r, a in found for h in _tagged(a["results"], r, anchor)), key=lambda h: -h["score"])[:k]
    return {"query": query, "results": hits, "roots": [label(r, anchor) for r in roots], "errors": errors, "hint": read.search_hint(hits, query)}


def context_multi(spark: SparkSession, query: str, roots: list, k_seeds: int = 5, file_outline_limit: int = 8, anchor=None, **options) -> dict:
    found, errors = each_root(roots, lambda r: read.context(spark, query, k_seeds=k_seeds, root=r, **options))
    seeds = sorted((s for r, a in found for s in _tagged(a["seeds"], r, anchor)), key=lambda s: -s.get("score", 0))[:k_seeds]
    outlines = [o for r, a in found for o in _tagged(a["file_outlines"], r, anchor)][:file_outline_limit]
    out = {"query": query, "seeds": [s | {"rank": i} for i, s in enumerate(seeds, 1)], "file_outlines": outlines, "errors": errors}
    return out | {"token_estimate": read.T.rough_tokens(out), "hint": "For more, ask one root."}


def grep_files_multi(spark: SparkSession, pattern: str, roots: list, max_results: int = 200, definitions_first: bool = True, anchor=None, **options) -> dict:
    found, errors = each_root(roots, lambda r: read.grep_files(spark, pattern, r, max_results=max_results, definitions_first=definitions_first, **options))
    rows = [m for r, a in found for m in _tagged(a["matches"], r, anchor)]
    rows = sorted(rows, key=lambda m: not m["is_definition"]) if definitions_first else rows
    return {"pattern": pattern, "matches": rows[:max_results], "match_count": len(rows[:max_results]), "truncated": len(rows) >= max_results, "errors": errors}


def find_literal_multi(spark: SparkSession, literal: str, roots: list, max_results: int = 500, anchor=None, **options) -> dict:
    found, errors = each_root(roots, lambda r: read.find_literal(spark, literal, r, max_results=max_results, **options))
    rows = [m for r, a in found for m in _tagged(a["matches"], r, anchor)][:max_results]
    return {"literal": literal, "matches": rows, "match_count": len(rows), "truncated": len(rows) >= max_results, "errors": errors}


def map_repo_multi(spark: SparkSession, roots: list, anchor=None, **options) -> dict:
    found, errors = each_root(roots, lambda r: read.map_repo(spark, r, **options))
    return {"sections": [{"label": label(r, anchor)} | a for r, a in found], "file_count": sum(a["file_count"] for _, a in found), "symbol_count": sum(a["symbol_count"] for _, a in found), "errors": errors}


def owner_of_name(spark: SparkSession, qname: str, roots: list) -> Path | None:
    """The first root whose index has exactly this name."""
    tables = [Index(spark, r).symbols.where(F.col("qname") == qname).select(F.lit(i).alias("place")) for i, r in enumerate(roots) if Location(str(Path(r).resolve())).exists()]
    if not tables:
        return None
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    place = every.agg(F.min("place")).first()[0]
    return None if place is None else Path(roots[place])


def owner_of_path(path: str | Path, roots: list) -> Path | None:
    """The root with the longest path that holds this one."""
    at = Path(path).resolve()
    owners = [Path(r) for r in roots if at.is_relative_to(Path(r).resolve())]
    return max(owners, key=lambda r: len(str(r.resolve())), default=None)


def by_name(spark: SparkSession, operation: Callable, qname: str, roots: list, *args, anchor=None, **options) -> dict:
    """expand, get_source, edit_symbol, insert_symbol, delete_symbol, ... in the root that has the name."""
    root = owner_of_name(spark, qname, roots)
    if root is None:
        return write.error("not_found", "None of the roots has this name.", qname=qname, roots=[label(r, anchor) for r in roots])
    return {"root": label(root, anchor)} | operation(spark, qname, *args, root=root, **options)


def by_path(spark: SparkSession, operation: Callable, path: str, roots: list, *args, anchor=None, **options) -> dict:
    """outline, add_import, remove_import in the root of an absolute path, else in the first that has it."""
    root = owner_of_path(path, roots) if Path(path).is_absolute() else next((Path(r) for r in roots if (Path(r) / path).exists()), None)
    if root is None:
        return write.error("not_found", "None of the roots has this path.", path=path, roots=[label(r, anchor) for r in roots])
    return {"root": label(root, anchor)} | operation(spark, path, *args, root=root, **options)
