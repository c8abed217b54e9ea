"""The index of a source tree: parse what changed, resolve the calls that it touches, publish a version.

An index is a folder of segments: a refresh writes the rows of the files that changed,
with their postings and vectors, and markers that void their earlier rows. Calls of
other files are resolved again only if they need a name whose symbols changed. Readers
see one version or the other, never a mixture.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkloom.functions.stem import terms
from sparkloom.functions.text import embedding_text_col, identifier_words
from sparkloom.operators import cooccurrence, graph, postings, snapshots, vectors
from sparkloom.operators.segments import Segments, side_by_side
from sparkloom.sources.config import ScanConfig
from sparkloom.sources.names import VERSION, sha1
from sparkloom.sources.parsers import parse_file
from sparkloom.sources.routes import routes_of
from sparkloom.sources.scan import STATE_DIR, contents, discover_packages, list_files, stamps

TABLES = ("files", "symbols", "calls", "imports", "routes", "vectors")
SYMBOL_FIELDS = "qname string, kind string, signature string, docstring string, line_start int, line_end int, parent_qname string, decorators array<string>, bases array<string>, source_sha string"
SYMBOL = "struct<qname:string,kind:string,signature:string,docstring:string,line_start:int,line_end:int,parent_qname:string,decorators:array<string>,bases:array<string>,source_sha:string>"
CALL = "struct<caller_qname:string,callee_name:string,guess:string,line:int>"
IMPORT = "struct<module:string,name:string,alias:string,line:int>"
ROUTE = "struct<method:string,path:string,handler_qname:string,line:int,framework:string>"
PARSED = f"file string, rel string, sha string, language string, indexed_at double, content string, symbols array<{SYMBOL}>, calls array<{CALL}>, imports array<{IMPORT}>, routes array<{ROUTE}>"

#: Tables of a segment. ``kept``: of symbols with one name the one of the first file is.
SCHEMAS = postings.schemas() | {
    "files": "file string, rel string, sha string, language string, indexed_at double, content string, size long, changed long",
    "symbols": f"file string, language string, ord int, {SYMBOL_FIELDS}, kept boolean",
    "calls": "call_id long, caller_qname string, callee_name string, guess string, callee_qname string, file string, line int",
    "imports": "import_id long, file string, module string, name string, alias string, line int",
    "routes": "defined_in string, method string, path string, handler_qname string, line int, framework string",
    "vectors": "file string, qname string, vector array<float>",
    "needs": "name string, call_id long, file string",
    "words": "word string, weight double, vector array<float>",
}
UNITS = postings.UNITS | {t: {"file": "file"} for t in ("files", "symbols", "imports", "vectors", "needs")} | {"routes": {"file": "defined_in"}, "calls": {"file": "file", "call": "call_id"}}
#: Seconds before it was indexed in which a file may have changed once more without another time.
RACY = 2.0


@dataclass(frozen=True)
class Location:
    """Where the index of a root, or of a package beside it, is kept."""

    root: str
    scope: str | None = None

    @property
    def folder(self) -> Path:
        base = Path(self.root) / STATE_DIR
        return base / "vendor" / self.scope if self.scope else base

    def exists(self) -> bool:
        at = self.folder / "manifests"
        return at.is_dir() and any(at.glob("*.json"))

    def store(self, spark: SparkSession) -> Segments:
        return Segments(spark, f"file://{self.folder}", SCHEMAS, UNITS)

    @contextmanager
    def writing(self):
        """One writer at a time."""
        self.folder.mkdir(parents=True, exist_ok=True)
        with open(self.folder / "LOCK", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield


class Index:
    """Tables of the current version."""

    def __init__(self, spark: SparkSession, root: str | Path, scope: str | None = None):
        self.spark, self.location = spark, Location(str(Path(root).resolve()), scope)
        if not self.location.exists():
            raise FileNotFoundError(f"no index at {self.location.folder}: run index first")
        self.store = self.location.store(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        rows = self.store.live(name)
        return (rows.where("kept").drop("seg", "kept") if name == "symbols" else rows.drop("seg")) if name != "vectors" else rows.drop("seg", "file")

    @property
    def embedder(self) -> vectors.Embedder:
        """What the symbols' vectors were made by."""
        return cooccurrence.WordEmbedder.of(self.store.live("words")) if self.store.facts.get("embedder") == "words" else vectors.HashEmbedder()

    @property
    def searcher(self) -> postings.Searcher:
        """Search over the names, signatures, docstrings and decorators of the symbols."""
        return postings.Searcher(self.store)


def parse_rows(files: DataFrame) -> DataFrame:
    """One row per file with all it holds; parsing runs where the contents are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [[f.split(":")[0] for f in kind[7:-1].replace("array<string>", "array").split(",")] for kind in (SYMBOL, CALL, IMPORT, ROUTE)]
        for batch in batches:
            rows = []
            for file, rel, content in zip(batch["file"], batch["rel"], batch["content"], strict=True):
                content = bytes(content)
                language, parsed = parse_file(rel, content)
                text = content.decode("utf-8", "replace")
                parts = (parsed.symbols, parsed.calls, parsed.imports, routes_of(rel, text))
                rows.append((file, rel, sha1(content), language, time.time(), text, *([dict(zip(n, x, strict=True)) for x in part] for n, part in zip(names, parts, strict=True))))
            yield pd.DataFrame(rows, columns=["file", "rel", "sha", "language", "indexed_at", "content", "symbols", "calls", "imports", "routes"])

    return files.select("file", "rel", "content").mapInPandas(run, PARSED)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def index_terms(qname: pd.Series, signature: pd.Series, doc: pd.Series, decorators: pd.Series) -> pd.Series:
    """Terms of the four searched columns."""
    return pd.Series([[terms(" ".join(identifier_words(q))), terms(s), terms(d), terms(m)] for q, s, d, m in zip(qname, signature, doc, decorators, strict=True)])


def _raw(parsed: DataFrame) -> dict[str, DataFrame]:
    """Symbols, calls, imports and routes of parsed files; of a file's symbols with one name the first."""
    symbols = parsed.select("file", "language", F.posexplode("symbols").alias("ord", "s")).select("file", "language", "ord", "s.*")
    first = Window.partitionBy("file", "qname").orderBy("ord")
    symbols = symbols.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    number = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    place = F.xxhash64("file").bitwiseAND(F.lit((1 << 40) - 1)) * F.lit(1 << 22)
    calls = parsed.select("file", F.posexplode("calls").alias("ord", "c")).select((place + number).alias("call_id"), "c.caller_qname", "c.callee_name", F.col("c.guess").alias("guess"), "file", "c.line")
    imports = parsed.select("file", F.posexplode("imports").alias("ord", "i")).select((place + number).alias("import_id"), "file", "i.*")
    return {"symbols": symbols, "calls": calls, "imports": imports, "routes": parsed.select(F.col("file").alias("defined_in"), F.inline("routes"))}


def _states(known: DataFrame, now: DataFrame) -> DataFrame:
    """(file, rel, size, changed, sha, state): removed, unchanged, or maybe, if only its content can tell.

    known: file, sha, size, changed, indexed_at; now: file, rel, size, changed.
    """
    old = known.select("file", "sha", F.col("size").alias("__size"), F.col("changed").alias("__changed"), "indexed_at")
    same = (F.col("size") == F.col("__size")) & (F.col("changed") == F.col("__changed")) & (F.col("changed") < (F.col("indexed_at") - RACY) * 1e9)
    state = F.when(F.col("size").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("maybe")
    return now.join(old, "file", "full_outer").select("file", "rel", "size", "changed", "sha", state.alias("state"))


def refresh(spark: SparkSession, root: str | Path, force: bool = False, scope: str | None = None, source: str | Path | None = None, config: ScanConfig | None = None, embedder: vectors.Embedder | str | None = None, progress: Callable[[int, int, str], None] | None = None, only: list[str] | None = None) -> dict:
    """Bring the index of ``root`` up to date: only files whose hash changed are parsed.

    Files are listed; those with another size or time than when they were indexed, or a
    time too near to that, are read and hashed. ``scope`` and ``source``: a package beside
    the root, kept in an index of its own. ``only``: files (below the root) that may have
    changed; no others are looked at. ``embedder``: ``"words"`` learns word vectors from the
    symbols when all of them are indexed anew, and later refreshes use these. Returns counts of updated, skipped and removed files,
    and of symbols and calls.
    """
    base = str(Path(root).resolve())
    location = Location(base, scope)
    tree = str(Path(source).resolve()) if source else base
    with location.writing():
        store = location.store(spark)
        facts = store.facts
        stale = force or not store.manifest["segments"] or facts.get("parser") != VERSION or facts.get("root") != base
        embedder = embedder or ("words" if facts.get("embedder") == "words" and facts.get("root") == base else vectors.HashEmbedder())
        names = list_files(tree, config)
        if only is not None and not stale:
            asked = {os.path.relpath(os.path.join(tree, f), tree).replace(os.sep, "/") for f in only}
            names = [n for n in names if n in asked]
        listed = spark.createDataFrame(stamps(tree, names), "rel string, size long, changed long").withColumn("file", F.concat(F.lit(f"{tree}/"), "rel"))
        known = store.live("files").select("file", "sha", "size", "changed", "indexed_at")
        if stale:
            known = known.where("false")
        elif only is not None:
            known = known.where(F.col("file").isin([f"{tree}/{n}" for n in sorted(asked)]))
        states = _states(known, listed).persist()
        try:
            return _apply(spark, location, store, states, stale, tree, base, embedder, progress, len(names), only is None)
        finally:
            states.unpersist()


def _apply(spark: SparkSession, location: Location, store: Segments, states: DataFrame, stale: bool, tree: str, base: str, embedder: vectors.Embedder | str, progress: Callable | None, listed: int, whole: bool) -> dict:
    """Parse what changed, write it as one segment, publish."""
    facts = store.facts
    aside = f"file://{location.folder}/aside/parsed-{store.next()}"
    maybe = states.where("state = 'maybe'").select("file", "rel", "size", "changed", F.col("sha").alias("__sha"))
    tried = maybe.count()
    found = contents(maybe, tree, number=tried).drop("rel", "length").join(maybe, "file") if tried else None
    changed = found.where(F.col("__sha").isNull() | (F.col("__sha") != F.sha1("content"))) if tried else None
    if tried:
        parse_rows(changed).join(maybe.select("file", "size", "changed"), "file").write.mode("overwrite").parquet(aside)
    parsed = spark.read.schema(PARSED + ", size long, changed long").parquet(aside) if tried else None
    updated = parsed.count() if tried else 0
    removed = states.where("state = 'removed'").count()
    if progress:
        fresh = {r.file for r in parsed.select("file").collect()} if tried else set()
        rows = sorted((r.file, "removed" if r.state == "removed" else "updated" if r.file in fresh else "unchanged") for r in states.select("file", "state").collect())
        for done, (file, what) in enumerate(rows, 1):
            try:
                progress(done, len(rows), f"{what} {file}")
            except Exception:  # noqa: S110  a report must not stop the work
                pass
    known_files = facts.get("files", 0)
    out = {"updated": updated, "skipped": (listed if whole or stale else known_files) - updated, "removed": removed}
    try:
        if not stale and not updated and not removed:
            return out | {"symbols": facts["symbols"], "calls": facts["calls"], "version": store.manifest["version"]}
        number, wrote, more = _segment(spark, location, store, parsed, states, stale, embedder)
        store.publish({"seg": number, "rows": wrote}, more | {"parser": VERSION, "root": base, "at": time.time()}, [s["seg"] for s in store.manifest["segments"]] if stale else ())
        compact(store)
    finally:
        shutil.rmtree(location.folder / "aside", ignore_errors=True)
    return out | {"symbols": store.facts["symbols"], "calls": store.facts["calls"], "version": store.manifest["version"]}


def _segment(spark: SparkSession, location: Location, store: Segments, parsed: DataFrame | None, states: DataFrame, stale: bool, embedder: vectors.Embedder | str) -> tuple[int, dict[str, int], dict]:
    """Write the segment of parsed and removed files: (its number, rows by table, facts)."""
    number, facts = store.next(), store.facts
    empty = spark.createDataFrame([], PARSED + ", size long, changed long")
    parsed = empty if parsed is None else parsed
    removed = states.where("state = 'removed'").select("file")
    if stale:
        gone = removed.where("false")
        old = store.live("symbols").where("false")
    else:
        gone = _small(removed.unionByName(parsed.select("file")))
        old = _small(store.live("symbols").join(gone, "file", "left_semi"))
        # Files that share a symbol's name with what changes: which of them is kept may change with it.
        names = _small(old.select("qname").unionByName(parsed.select(F.explode("symbols.qname").alias("qname"))).distinct())
        rivals = _small(store.live("symbols").select("file", "qname").join(gone, "file", "left_anti").join(names, "qname", "left_semi").select("file").distinct())
        if not rivals.isEmpty():
            again = store.live("files").join(rivals, "file", "left_semi")
            at = f"file://{location.folder}/aside/rivals-{number}"
            parse_rows(again.select("file", "rel", F.col("content").cast("binary").alias("content"))).join(again.select("file", "size", "changed"), "file").write.mode("overwrite").parquet(at)
            parsed = parsed.unionByName(spark.read.schema(PARSED + ", size long, changed long").parquet(at))
            gone = _small(gone.unionByName(rivals))
            old = _small(store.live("symbols").join(gone, "file", "left_semi"))
    raw = _raw(parsed)
    first = raw["symbols"].groupBy("qname").agg(F.min("file").alias("__first"))
    if not stale:
        kept_by = store.live("symbols").join(gone, "file", "left_anti").select("qname", F.col("file").alias("__first")).join(first.select("qname"), "qname", "left_semi")
        first = first.unionByName(kept_by).groupBy("qname").agg(F.min("__first").alias("__first"))
    symbols = raw["symbols"].join(first, "qname").withColumn("kept", F.col("file") == F.col("__first"))
    plain = {"files": parsed, "symbols": symbols, "imports": raw["imports"], "routes": raw["routes"], "needs": graph.needs(raw["calls"], raw["imports"])}
    side_by_side(*[partial(store.write, number, table, rows) for table, rows in plain.items()])
    own = partial(store.written, number)
    fresh = own("symbols").where("kept").drop("kept")

    # Postings and vectors of the symbols that are kept.
    fields = F.col("terms")
    named = fresh.withColumn("terms", index_terms("qname", "signature", "docstring", F.array_join("decorators", "\n")))
    base = Segments(spark, store.folder, store.schemas, store.units, {"version": 0, "segments": [], "facts": {}}) if stale else store
    indexed = partial(postings.add, base, number, postings.documents(named, "qname", F.col("file"), fields), None if stale else gone.select(F.col("file").alias("unit")))
    text = embedding_text_col(F.col("qname"), F.col("signature"), F.coalesce("docstring", F.lit("")))
    if embedder == "words":
        if stale:
            learned = cooccurrence.word_vectors(fresh.select(cooccurrence.name_words(text).alias("words")), "words")
            store.write(number, "words", learned)
        embedder, by_words = cooccurrence.WordEmbedder.of(own("words") if stale else store.live("words")), True
    else:
        by_words = False
    embedded = vectors.embed_column(fresh, "qname", text, embedder).join(fresh.select("qname", "file"), "qname")

    # Calls of these files, and of others that need a name whose symbols changed.
    calls = raw["calls"].select("call_id", "caller_qname", "callee_name", "guess", "file", "line")
    imports, needs, everything = own("imports"), own("needs"), fresh
    if not stale:
        live = store.live("calls").drop("seg")
        names = _small(graph.changed_names(old.where("kept"), fresh))
        touched = _small(graph.touched_calls(live, store.live("needs").drop("seg"), names, gone))
        again = touched.select(*calls.columns)
        calls = calls.unionByName(again)
        imports = imports.select("import_id", "file", "module", "name", "alias", "line").unionByName(store.live("imports").drop("seg").join(touched.select("file").distinct(), "file", "left_semi"))
        needed = _small(needs.select("name").unionByName(store.live("needs").join(touched.select("call_id"), "call_id", "left_semi").select("name")).distinct())
        kept = store.live("symbols").where("kept").drop("seg", "kept").join(gone, "file", "left_anti").unionByName(fresh)
        everything = _small(kept.withColumn("name", graph.simple_name(F.col("qname"))).join(needed, "name", "left_semi").drop("name"))
    asked = calls.withColumn("callee_qname", F.col("guess")).select("call_id", "caller_qname", "callee_name", "callee_qname", "file", "line")
    resolved = graph.resolve_calls(asked, everything, imports, location.scope is None).join(calls.select("call_id", "guess"), "call_id")
    if not stale:
        before = touched.select("call_id", F.col("callee_qname").alias("__before"), F.lit(True).alias("__held"))
        resolved = resolved.join(before, "call_id", "left").where(F.col("__held").isNull() | ~F.col("callee_qname").eqNullSafe(F.col("__before")))
    (more, counted), _, _ = side_by_side(indexed, partial(store.write, number, "vectors", embedded), partial(store.write, number, "calls", resolved))
    counts = [own("files"), own("symbols").where("kept"), raw["calls"]]
    if not stale:
        marks = gone.select(F.lit("file").alias("kind"), F.col("file").alias("unit"))
        moved = own("calls").join(gone, "file", "left_anti").select(F.lit("call").alias("kind"), F.col("call_id").cast("string").alias("unit"))
        store.write(number, "gone", marks.unionByName(moved))
        counts += [own("gone"), store.live("files").join(gone, "file", "left_semi"), old.where("kept"), store.live("calls").join(gone, "file", "left_semi")]
    n_files, n_symbols, n_calls, *less = side_by_side(*[rows.count for rows in counts])
    wrote = more | {t: n_files for t in (*plain, "vectors", "calls", *(["words"] if by_words and stale else []))} | {"symbols": n_symbols}
    if not stale:
        wrote["gone"] = less[0]
        n_files, n_symbols, n_calls = (facts[t] + n - x for t, n, x in zip(("files", "symbols", "calls"), (n_files, n_symbols, n_calls), less[1:], strict=True))
        for held in (gone, old, names, rivals, touched, needed, everything):
            held.unpersist()
    return number, wrote, counted | {"files": n_files, "symbols": n_symbols, "calls": n_calls, "embedder": "words" if by_words else "given"}


#: Rows that a refresh brings to the driver to shorten what Spark plans next.
SMALL = 2000


def _small(rows: DataFrame) -> DataFrame:
    """The same rows: given as they are, to be broadcast, if there are few; kept by Spark otherwise."""
    first = rows.limit(SMALL + 1).collect()
    if len(first) > SMALL:
        return rows.persist()
    return F.broadcast(rows.sparkSession.createDataFrame(first, rows.schema))


def compact(store: Segments) -> bool:
    """Merge segments if it is time."""
    due = store.due("symbols")
    if due:
        number = store.next()
        wrote = postings.merged(store, number, due)
        for table in ("files", "symbols", "calls", "imports", "routes", "vectors", "needs", "words"):
            store.write(number, table, store.live(table).where(F.col("seg").isin(due)))
            wrote[table] = 1
        wrote["symbols"] = store.written(number, "symbols").count()
        if len(due) < len(store.manifest["segments"]):
            store.write(number, "gone", store.rows("gone").where(F.col("seg").isin(due)).select("kind", "unit").distinct())
            wrote["gone"] = store.written(number, "gone").count()
        store.publish({"seg": number, "rows": wrote}, {}, due)
    return bool(due)


def refresh_package(spark: SparkSession, root: str | Path, name: str) -> dict:
    """Index an installed package, whatever is ignored or vendored inside."""
    packages = discover_packages(root)
    if name not in packages:
        return {"error": "unknown_package", "package": name, "known": sorted(packages)}
    loose = ScanConfig(respect_gitignore=False, skip_vendor_packages=False)
    return refresh(spark, root, scope=name, source=packages[name], config=loose)


def indexed_packages(root: str | Path) -> list[str]:
    folder = Path(root) / STATE_DIR / "vendor"
    return sorted(p.name for p in folder.iterdir() if Location(str(Path(root).resolve()), p.name).exists()) if folder.is_dir() else []


def forget_package(root: str | Path, name: str) -> bool:
    folder = Location(str(Path(root).resolve()), name).folder
    found = folder.is_dir()
    shutil.rmtree(folder, ignore_errors=True)
    return found


def folder_versions(spark: SparkSession, root: str | Path) -> DataFrame:
    """(folder, digest) of the source files as they are now. Files that are as the index
    saw them count with the hash that it has; tasks hash the others."""
    base, location = str(Path(root).resolve()), Location(str(Path(root).resolve()))
    names = list_files(base)
    now = spark.createDataFrame(stamps(base, names), "rel string, size long, changed long").withColumn("file", F.concat(F.lit(f"{base}/"), "rel"))
    if location.exists():
        known = location.store(spark).live("files").select("file", "sha", "size", "changed", "indexed_at")
    else:
        known = spark.createDataFrame([], "file string, sha string, size long, changed long, indexed_at double")
    states = _states(known, now)
    held = states.where("state = 'unchanged'").select("rel", "sha")
    fresh = contents(states.where("state = 'maybe'"), base).select("rel", F.sha1("content").alias("sha"))
    return snapshots.folder_digests(held.unionByName(fresh), "rel", "sha")


def source_version(spark: SparkSession, root: str | Path) -> str:
    """The digest of the root: it changes exactly when a source file does."""
    found = folder_versions(spark, root).where("folder = ''").first()
    return found.digest if found else sha1("")


class Preloads:
    """Texts kept for a mode as long as no source changes."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark = spark
        self.root, self.folder = Path(root).resolve(), Path(root).resolve() / STATE_DIR / "preloads"

    def get(self, mode: str) -> str | None:
        path = self.folder / f"{mode}.json"
        if not path.exists():
            return None
        held = json.loads(path.read_text())
        return held["content"] if held["source_version"] == source_version(self.spark, self.root) else None

    def put(self, mode: str, content: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        fresh = self.folder / f".{mode}.{os.getpid()}"
        fresh.write_text(json.dumps({"content": content, "source_version": source_version(self.spark, self.root), "generated_at": int(time.time())}))
        os.replace(fresh, self.folder / f"{mode}.json")

    def clear(self) -> int:
        held = list(self.folder.glob("*.json")) if self.folder.is_dir() else []
        for path in held:
            path.unlink(missing_ok=True)
        return len(held)
