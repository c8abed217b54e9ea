"""Source trees as DataFrames, and the discovery of roots and packages."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.config import ScanConfig, load_config
from sparkloom.sources.ignore import ignored, ignored_by, load_rules
from sparkloom.sources.parsers import LANGUAGES, language_of

# Folders that hold no sources of their own, vendored ones, bundles.
SKIP_DIRS = frozenset(".git .hg .svn __pycache__ .mypy_cache .pytest_cache .ruff_cache dist build .tox .sparkloom .next .svelte-kit .nuxt .astro .turbo out .parcel-cache .expo coverage htmlcov".split())
VENDOR_DIRS = frozenset(".venv venv env node_modules bower_components vendor".split())
BUNDLE_SUFFIXES = (".min.js", ".min.mjs", ".min.cjs", ".bundle.js", ".min.css", ".map", ".worker.js", "-bundle.js", "-bundle.mjs", ".standalone.js", ".lib.js")
PROJECT_MARKERS = ("pyproject.toml", "package.json", "Cargo.toml", "go.mod", "Gemfile", "build.gradle", "build.gradle.kts", "pom.xml", "composer.json", "mix.exs")
STATE_DIR = ".sparkloom"


def skip_dirs(config: ScanConfig) -> frozenset[str]:
    return SKIP_DIRS | set(config.extra_skip_dirs) | (VENDOR_DIRS if config.skip_vendor_packages else frozenset())


def _admitted(config: ScanConfig, root: str, rules: list, any_text: bool):
    skips = skip_dirs(config)
    suffixes = config.extra_skip_suffixes + (BUNDLE_SUFFIXES if config.skip_vendor_bundles else ())

    def admit(rel: str) -> bool:
        parts = rel.split("/")
        if not skips.isdisjoint(parts) or config.extra_exclude and ignored(rel, config.extra_exclude):
            return False
        if not any_text:
            language = language_of(rel)
            if language is None or config.languages is not None and language not in config.languages:
                return False
        if parts[-1].endswith(suffixes):
            return False
        wanted = bool(config.extra_include) and ignored(rel, config.extra_include)
        return wanted or not (config.respect_gitignore and ignored_by(f"{root}/{rel}", rules))

    return admit


#: Files that one task reads at least.
FILES_PER_TASK = 64


def scan(spark: SparkSession, root: str | Path, config: ScanConfig | None = None, any_text: bool = False) -> DataFrame:
    """(file, rel, length, content binary) of a root's source files.

    The listing is made once, without looking into folders that are skipped; tasks
    read the contents. Spark's own file listing would hide names that begin with an
    underscore or a dot, such as __init__.py and .env. ``any_text`` takes every file
    without a NUL in its first 4096 bytes instead of those that a parser reads. A
    file that goes between the listing and its task is left out.
    """
    base = str(Path(root).resolve())
    names = list_files(base, config, any_text)
    return contents(spark.createDataFrame([(n,) for n in names], "rel string"), base, any_text, len(names))


def contents(listed: DataFrame, base: str, any_text: bool = False, number: int | None = None) -> DataFrame:
    """(file, rel, length, content binary) of the files named by ``listed`` (rel) below ``base``."""
    dealt = listed.select("rel").repartition(max(1, min((number if number is not None else listed.count()) // FILES_PER_TASK + 1, 10_000)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rel in batch["rel"]:
                try:
                    content = Path(base, rel).read_bytes()
                except OSError:
                    continue
                if not any_text or content and b"\0" not in content[:4096]:
                    rows.append((f"{base}/{rel}", rel, len(content), content))
                if len(rows) >= FILES_PER_TASK:
                    yield pd.DataFrame(rows, columns=["file", "rel", "length", "content"])
                    rows = []
            yield pd.DataFrame(rows, columns=["file", "rel", "length", "content"])

    return dealt.mapInPandas(read, "file string, rel string, length long, content binary")


def stamps(root: str | Path, names: list[str]) -> list[tuple[str, int, int]]:
    """(rel, size, time of change in nanoseconds) of files that are still there."""
    out = []
    for rel in names:
        try:
            s = os.stat(os.path.join(root, rel))
        except OSError:
            continue
        out.append((rel, s.st_size, s.st_mtime_ns))
    return out


def list_files(root: str | Path, config: ScanConfig | None = None, any_text: bool = False) -> list[str]:
    """The files' relative paths, sorted, by a walk that does not enter skipped folders."""
    base = str(Path(root).resolve())
    config = load_config(base) if config is None else config
    admit = _admitted(config, base, load_rules(base) if config.respect_gitignore else [], any_text)
    skips, found = skip_dirs(config), []
    for folder, dirs, names in os.walk(base):
        dirs[:] = sorted(d for d in dirs if d not in skips)
        for name in names:
            rel = os.path.relpath(os.path.join(folder, name), base).replace(os.sep, "/")
            if admit(rel) and os.path.getsize(os.path.join(folder, name)) <= config.max_file_size:
                found.append(rel)
    return sorted(found)


def has_marker(folder: Path) -> bool:
    return any((folder / m).exists() for m in PROJECT_MARKERS)


def subprojects(root: str | Path) -> list[Path]:
    """Folders one level down that look like projects."""
    return sorted(p for p in Path(root).iterdir() if p.is_dir() and not p.name.startswith(".") and p.name not in SKIP_DIRS | VENDOR_DIRS and has_marker(p))


def discover_roots(start: str | Path) -> list[Path]:
    """The nearest indexed folder at or above ``start``; else those one level down."""
    at = Path(start).resolve()
    for _ in range(20):
        if (at / STATE_DIR).is_dir():
            return [at]
        if at.parent == at:
            break
        at = at.parent
    below = Path(start).resolve()
    return sorted(p for p in below.iterdir() if p.is_dir() and not p.name.startswith(".") and (p / STATE_DIR).is_dir()) if below.is_dir() else []


def discover_packages(root: str | Path) -> dict[str, Path]:
    """Installed packages beside a root, by name; the first of a name wins."""
    base, found = Path(root), {}
    for env in (".venv", "venv", "env"):
        for site in sorted(base.glob(f"{env}/lib/python*/site-packages")):
            for p in sorted(site.iterdir()):
                if p.is_dir() and not p.name.startswith((".", "_")) and not p.name.endswith((".dist-info", ".egg-info")):
                    found.setdefault(p.name, p)
    modules = base / "node_modules"
    for p in sorted(modules.iterdir()) if modules.is_dir() else ():
        if p.is_dir() and not p.name.startswith((".", "_", "@")):
            found.setdefault(p.name, p)
    return found


def query_scope(query: str, packages: dict[str, Path]) -> tuple[str | None, str]:
    """(package, rest) of a query such as ``package: words``; None if it names none."""
    head, colon, rest = query.partition(":")
    if colon and re.fullmatch(r"[A-Za-z_][\w-]*", head) and head in packages:
        return head, rest.strip()
    return None, query


def enabled_extensions(config: ScanConfig) -> set[str]:
    return {e for name, parser in LANGUAGES.items() if config.languages is None or name in config.languages for e in parser.extensions}
