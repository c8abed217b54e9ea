"""Read operations: search, context, expand, outline, source, find, grep, map,
skeleton and routes.

The scans, joins and rankings run as DataFrames over the index tables; what comes
to the driver is the bounded answer: k hits, a cap of matches, one pack.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.stem import terms as stemmed
from sparkloom.operators import fusion, graph, spans, vectors, views
from sparkloom.plans.index import Index, indexed_packages, refresh
from sparkloom.sources.names import sha1
from sparkloom.sources.scan import contents, list_files

SOFT_TOKENS, HARD_TOKENS, LEAST_BODY = 8000, 16000, 400
ACTION = {"outline": "Its members: outline of its file.", "expand": "What it calls: expand.", "read_body": "Its source: get_source, or search with bodies."}


# ---- shared ------------------------------------------------------------------


def body_of(index: Index, rows: DataFrame, cap: int | None = None) -> DataFrame:
    """``rows`` (file, line_start, line_end) with their source lines, cut at ``cap``."""
    files = index.files.select("file", T.lines(F.col("content")).alias("__lines"))
    whole = F.array_join(F.slice("__lines", F.col("line_start"), F.greatest(F.lit(0), F.col("line_end") - F.col("line_start") + 1)), "\n")
    out = rows.join(files, "file", "left").withColumn("source", whole).drop("__lines")
    if cap is None:
        return out
    more = F.length("source") - cap
    return out.withColumn("source", F.when(more > 0, F.concat(F.left("source", F.lit(cap)), F.lit("\n# ... truncated ("), more.cast("string"), F.lit(" chars) ..."))).otherwise(F.col("source")))


def shown(row) -> dict:
    """A symbol as an answer gives it."""
    out = {"qname": row.qname, "kind": row.kind, "signature": row.signature, "docstring": T.doc_summary(row.docstring), "file": row.file, "lines": f"{row.line_start}-{row.line_end}", "decorators": list(row.decorators) or None}
    have = row.asDict()
    for extra in ("score", "source", "next_action"):
        if extra in have:
            out[extra] = round(have[extra], 4) if extra == "score" else have[extra]
    return out


def resolve_name(index: Index, qname: str) -> tuple[str | None, str | None]:
    """(the name as indexed, a hint if it was written otherwise)."""
    bare = re.sub(r"\.(pyi?|tsx?|jsx?|mjs|cjs|mts|cts|sh|bash)(?=:|$)", "", qname)
    module, colon, member = bare.partition(":")
    swapped = module.replace("/", ".") if "/" in module else module.replace(".", "/")
    tries = list(dict.fromkeys([qname, bare, *(f"{m}{colon}{member}" for m in (swapped,)), re.sub(r"\.(pyi?|tsx?|jsx?)$", "", swapped) + colon + member]))
    tries += [t + ":" for t in tries if ":" not in t]
    ranked = index.spark.createDataFrame(list(enumerate(tries)), "place int, qname string")
    found = index.symbols.select("qname").join(F.broadcast(ranked), "qname").orderBy("place").first()  # a few candidates
    if found is None:
        return None, None
    return found.qname, None if found.qname == qname else f"{qname!r} was read as {found.qname!r}"


# ---- search ------------------------------------------------------------------


def lexical_scores(index: Index, query: str) -> DataFrame:
    """(qname, score): BM25 over the four searched fields, words with underscores as phrases."""
    phrases = [p for p in (stemmed(" ".join(w)) for w in T.match_terms(query)) if p]
    search = index.searcher
    return search.keyed(search.scores(phrases)).withColumnRenamed("key", "qname")


def vector_scores(index: Index, query: str, k: int, kinds: DataFrame | None, embedder: vectors.Embedder) -> DataFrame:
    rows = index.vectors if kinds is None else index.vectors.join(kinds, "qname", "left_semi")
    return vectors.vector_top(rows, "qname", "vector", embedder.embed([query])[0].tolist(), k)


def _one_term(index: Index, query: str, k: int, kind: str | None, mode: str, embedder: vectors.Embedder) -> DataFrame:
    """Symbols with score: the k best for one query."""
    symbols = index.symbols.drop("terms")
    kinds = symbols.where(F.col("kind") == kind).select("qname") if kind else None
    lex = lexical_scores(index, query) if mode != "vector" else None
    if lex is not None and kinds is not None:
        lex = lex.join(kinds, "qname", "left_semi")
    if mode == "lexical":
        best = fusion.ranked(lex, "qname", k)
        return best.drop("rank").join(symbols, "qname")
    vec = vector_scores(index, query, fusion.OVERFETCH * k, kinds, embedder)
    if mode == "vector":
        return vec.limit(k).join(symbols, "qname")
    weights = T.class_weights(T.query_class(query))
    fused = fusion.fuse([(fusion.ranked(lex, "qname", fusion.OVERFETCH * k), weights[0]), (fusion.ranked(vec, "qname", fusion.OVERFETCH * k), weights[1])], "qname")
    known = fused.join(symbols.withColumn("__marks", F.array_join("decorators", "\n")), "qname")
    ranked = fusion.rank_symbols(known.withColumnRenamed("decorators", "__list").withColumnRenamed("__marks", "decorators"), query, weights, k)
    return ranked.drop("decorators", "seen").withColumnRenamed("__list", "decorators")


def search_code(spark: SparkSession, query: str, k: int = 5, kind: str | None = None, root: str | Path = ".", mode: str = "hybrid", scope: str | None = None, with_bodies: bool = False, body_char_cap: int = 1500, also: list[str] | None = None, embedder: vectors.Embedder | None = None) -> dict:
    """The k best symbols for a query and further terms.

    A kind that no hit has is dropped, and the answer says so.
    """
    index = Index(spark, root, scope)
    embedder = embedder or index.embedder
    queries = list(dict.fromkeys([query, *(also or [])]))

    def run(wanted: str | None) -> list:
        parts = [_one_term(index, q, k, wanted, mode, embedder) for q in queries]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        best = Window.partitionBy("qname").orderBy(F.desc("score"))
        rows = every.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n").orderBy(F.desc("score"), "qname").limit(k)
        rows = rows.withColumn("next_action", T.next_action_col(F.col("kind"), F.col("docstring")))
        return (body_of(index, rows, body_char_cap) if with_bodies else rows).orderBy(F.desc("score"), "qname").collect()

    rows, out = run(kind), {"query": query, "mode": mode}
    if kind and not rows and (rows := run(None)):
        out |= {"kind_filter_dropped": True, "actual_kinds": sorted({r.kind for r in rows})}
    if kind and T.exact_name(query) and not any(T.simple_name(r.qname) == T.exact_name(query) for r in rows if r.kind == kind):
        named = index.symbols.where((T.simple_name_col(F.col("qname")) == T.exact_name(query)) & (F.col("kind") != kind)).select("qname", "kind").limit(2).collect()
        if len(named) == 1:
            out["kind_suggestion"] = {"qname": named[0].qname, "kind": named[0].kind}
    results = [shown(r) for r in rows]
    if with_bodies and rows:
        out["constants"] = referenced_constants(index, [r["source"] or "" for r in results], [r["qname"] for r in results])
    return out | {"results": results, "hint": search_hint(results, query, with_bodies, bool(also), kind)}


def search_hint(results: list[dict], query: str = "", with_bodies: bool = False, also: bool = False, kind: str | None = None) -> str:
    """What to do next with an answer."""
    if not results:
        return "No matches: other words, or another kind, may have some."
    if query and T.AUDIT.search(query) and not with_bodies:
        return "The query asks for every place: search with bodies shows the hits' sources at once." + ("" if also else " Further terms can go along with also.")
    kinds = sorted({r["kind"] for r in results[:3] if r.get("kind")})
    if not kind and len(kinds) >= 3:
        return f"The first hits are of {len(kinds)} kinds ({', '.join(kinds)}): a kind narrows them."
    top = results[0]
    if top.get("next_action") == "read_body" and with_bodies:
        return f"{top['qname']} is shown in full."
    return f"{top['qname']}: {ACTION[top['next_action']]}"


# ---- constants ---------------------------------------------------------------


def _constants(index: Index) -> DataFrame:
    rows = index.symbols.where("kind = 'constant'").select("qname", "signature")
    return rows.select("qname", F.element_at(F.split("qname", r"[:.]"), -1).alias("name"), F.trim(F.regexp_extract("signature", r"=\s*(.*)$", 1)).alias("value"))


def constant_chain(index: Index, qname: str, hops: int = 3) -> dict | None:
    """Follow NAME = OTHER from a constant: the chain, and the value at its end."""
    found = graph.constant_chains(_constants(index), index.spark.createDataFrame([(qname,)], "qname string"), hops).first()
    return {"chain": found.chain, "terminal_qname": found.terminal, "value": found.value} if found is not None and found.chain else None


def referenced_constants(index: Index, bodies: list[str], exclude: list[str]) -> dict:
    """Constants that the bodies name, with the values at the ends of their chains, in one job."""
    names = list(dict.fromkeys(n for b in bodies for n in re.findall(r"\b[A-Z][A-Z0-9_]{2,}\b", b)))
    if not names:
        return {}
    consts = _constants(index)
    first = consts.where(F.col("name").isin(names) & ~F.col("qname").isin(*exclude)).groupBy("name").agg(F.min("qname").alias("qname"))
    rows = first.join(graph.constant_chains(consts, first).withColumnRenamed("start", "qname"), "qname").collect()
    return {r["name"]: {"qname": r.qname, "value": r.value} | ({"chain": r.chain} if r.chain else {}) for r in rows}


# ---- graph -------------------------------------------------------------------


def _steps(index: Index, direction: str) -> DataFrame:
    """(src, dst, way, line, call_id): edges to walk; unresolved callees are ?:name."""
    down = index.calls.select(F.col("caller_qname").alias("src"), F.coalesce("callee_qname", F.concat(F.lit("?:"), "callee_name")).alias("dst"), F.lit(0).alias("way"), "line", "call_id")
    up = index.calls.where("callee_qname is not null").select(F.col("callee_qname").alias("src"), F.col("caller_qname").alias("dst"), F.lit(1).alias("way"), "line", "call_id")
    return {"callees": down, "callers": up, "both": down.unionByName(up)}[direction]


def expand(spark: SparkSession, qname: str, direction: str = "callees", depth: int = 1, root: str | Path = ".", scope: str | None = None) -> dict:
    """Layers of callees, callers or both around a symbol."""
    if direction not in ("callees", "callers", "both"):
        raise ValueError("direction is callees, callers or both")
    index = Index(spark, root, scope)
    name, hint = resolve_name(index, qname)
    if name is None:
        return {"qname": qname, "error": "not_found", "hint": "No symbol has this name: search finds similar ones."}
    start = spark.createDataFrame([(name,)], "node string")
    found = graph.expand(_steps(index, direction), start, depth, ("way", "line", "call_id")).where("hop > 0")
    known = index.symbols.select(F.col("qname").alias("node"), "kind", "signature", "docstring", "file")
    rows = found.join(known, "node", "left").orderBy("hop", "ord").collect()
    layers = [[{"qname": r.node, "via": r.via, "kind": r.kind, "signature": r.signature, "docstring": T.doc_summary(r.docstring), "file": r.file} for r in rows if r.hop == h] for h in range(1, depth + 1)]
    layers = [layer for layer in layers if layer]
    other = cross_package(index, [r.node[2:] for r in rows if r.node.startswith("?:")], name) if direction != "callers" else {}
    for layer in layers:
        for node in layer:
            if (hit := other.get(node["qname"][2:])) and node["qname"].startswith("?:"):
                node |= {"qname": f"{hit['package']}::{hit['qname']}", "package": hit["package"], "signature": hit["signature"]}
    return {"qname": name, "direction": direction, "depth": depth, "layers": layers, "hint": hint or ("" if layers else f"No {direction} are known; a wider direction or text search may help.")}


def cross_package(index: Index, names: list[str], caller: str) -> dict[str, dict]:
    """Unresolved callees found in indexed packages, by the caller's imports in line order."""
    packages = [p for p in indexed_packages(index.location.root) if p != index.location.scope]
    if not names or not packages:
        return {}
    file = index.symbols.where(F.col("qname") == caller).select("file").first()
    brought = index.imports.where(F.col("file") == file.file).orderBy("line", "import_id").collect() if file else []
    wanted = []  # (name, place, package, qname)
    for name in dict.fromkeys(names):
        head, *rest = name.split(".")
        for at, i in enumerate(brought):
            lookup = i.alias or i.name or i.module.partition(".")[0]
            if lookup != head:
                continue
            whole = [*i.module.split("."), *([i.name] if i.name and i.name != "*" else []), *rest] if (i.name or i.alias) else [*name.split(".")]
            if whole[0] in packages:
                wanted += [(name, at * 100 + k, whole[0], f"{'.'.join(whole[1:cut])}:{'.'.join(whole[cut:])}") for k, cut in enumerate(range(len(whole) - 1, 0, -1))]
    if not wanted:
        return {}
    asked = index.spark.createDataFrame(wanted, "name string, place int, package string, qname string")
    tables = [Index(index.spark, index.location.root, p).symbols.select(F.lit(p).alias("package"), "qname", "signature", "docstring") for p in sorted({w[2] for w in wanted})]
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    hits = asked.join(every, ["package", "qname"]).groupBy("name").agg(F.min_by(F.struct("package", "qname", "signature"), "place").alias("hit")).collect()
    return {r["name"]: r.hit.asDict() for r in hits}


def neighbors(index: Index, qnames: list[str], direction: str, limit: int, depth: int) -> dict[str, list[dict]]:
    """For each symbol its first ``limit`` calls, with those of its neighbours inside."""
    steps = _steps(index, direction)
    if direction == "callees":
        steps = steps.where(~graph.is_builtin_col(F.col("dst")))
    known = index.symbols.select(F.col("qname").alias("dst"), "kind", "signature", "docstring")
    steps = steps.join(known, "dst", "left" if direction == "callees" else "inner")
    order = Window.partitionBy("src").orderBy("line", "call_id") if direction == "callees" else Window.partitionBy("src").orderBy("dst", "line")
    steps = steps.withColumn("pos", F.row_number().over(order))

    def level(names: list[str], cap: int, left: int) -> dict[str, list[dict]]:
        rows = steps.where(F.col("src").isin(names) & (F.col("pos") <= cap)).orderBy("src", "pos").collect() if names else []
        inner = level(sorted({r.dst for r in rows if not r.dst.startswith("?:")}), max(3, cap // 2), left - 1) if left > 1 and rows else {}
        out: dict[str, list[dict]] = {}
        for r in rows:
            entry = {"qname": r.dst, "kind": r.kind, "signature": r.signature, "docstring": T.doc_summary(r.docstring), "line": r.line}
            if inner.get(r.dst):
                entry[direction] = inner[r.dst]
            out.setdefault(r.src, []).append(entry)
        return out

    return level(qnames, limit, depth)


# ---- outlines and sources ----------------------------------------------------


def _tree(rows: list) -> list[dict]:
    """Symbols of one file, members inside their parents."""
    made = {r.qname: {"qname": r.qname, "kind": r.kind, "signature": r.signature, "docstring": T.doc_summary(r.docstring), "lines": f"{r.line_start}-{r.line_end}"} | ({"source": r.source} if "source" in r.asDict() else {}) for r in rows}
    roots = []
    for r in rows:
        if r.parent_qname in made and r.parent_qname != r.qname:
            made[r.qname].pop("source", None)
            made[r.parent_qname].setdefault("children", []).append(made[r.qname])
        else:
            roots.append(made[r.qname])
    return roots


def outline(spark: SparkSession, path: str, root: str | Path = ".", scope: str | None = None, max_files: int = 50, with_bodies: bool = False, body_char_cap: int = 1500) -> dict:
    """The nested symbols of a file, or of the files below a folder."""
    index = Index(spark, root, scope)
    at = str((Path(root).resolve() / path).resolve())
    symbols = index.symbols.where((F.col("file") == at) | F.col("file").startswith(at.rstrip("/") + "/")).drop("terms")
    files = [r.file for r in symbols.select("file").distinct().orderBy("file").limit(max_files + 1).collect()]
    if not files:
        hint = "The path does not exist." if not Path(at).exists() else "Nothing below this folder is indexed." if Path(at).is_dir() else "The file holds no symbols, or is not indexed."
        return {"path": path, "symbols": [], "hint": hint}
    rows = symbols.where(F.col("file").isin(files[:max_files]))
    rows = (body_of(index, rows, body_char_cap) if with_bodies else rows).orderBy("file", "line_start", F.desc("line_end"), "qname").collect()
    if files == [at]:
        return {"path": path, "file": at, "symbols": _tree(rows), "hint": ""}
    total = symbols.select("file").distinct().count() if len(files) > max_files else len(files)
    return {"path": path, "files": [{"file": f, "symbols": _tree([r for r in rows if r.file == f])} for f in files[:max_files]], "total_files": total, "truncated": total > max_files, "hint": ""}


def get_source(spark: SparkSession, qname: str, with_neighbors: bool = False, root: str | Path = ".", scope: str | None = None) -> dict:
    """A symbol's source. A file that changed since it was indexed is indexed first."""
    index = Index(spark, root, scope)
    name, hint = resolve_name(index, qname)
    if name is None:
        return {"qname": qname, "error": "not_found", "hint": "No symbol has this name: search finds similar ones."}
    row = index.symbols.where(F.col("qname") == name).join(index.files.select("file", "sha"), "file").first()
    path = Path(row.file)
    if scope is None and (not path.exists() or sha1(path.read_bytes()) != row.sha):
        refresh(spark, root, only=[str(path)])
        index = Index(spark, root)
        name, hint = resolve_name(index, qname)
        if name is None:
            return {"qname": qname, "error": "not_found", "hint": "The symbol went when its file changed."}
    row = body_of(index, index.symbols.where(F.col("qname") == name)).first()
    out = shown(row) | {"hint": hint or ""}
    if row.kind == "constant" and (chain := constant_chain(index, name)):
        out["resolved_value"] = chain
    if with_neighbors:
        out |= {way: neighbors(index, [name], way, 8, 1).get(name, []) for way in ("callees", "callers")}
    return out


# ---- exhaustive search -------------------------------------------------------


def _within(file, root: str | Path, in_path: str | None):
    if in_path is None:
        return F.lit(True)
    at = str((Path(root).resolve() / in_path).resolve())
    return (file == at) | file.startswith(at.rstrip("/") + "/")


def find_literal(spark: SparkSession, literal: str, root: str | Path = ".", scope: str | None = None, in_path: str | None = None, kind: str | None = None, with_bodies: bool = False, with_callers: bool = False, body_char_cap: int = 1500, max_results: int = 500) -> dict:
    """Every line of indexed symbols that holds the literal, with its innermost symbol."""
    if not literal:
        return {"literal": literal, "matches": [], "match_count": 0, "truncated": False, "hint": "A literal is needed."}
    index = Index(spark, root, scope)
    files = index.files.where(_within(F.col("file"), root, in_path)).select("file", "content")
    hits = spans.grep(files, "file", "content", literal).select("file", "line", "txt")
    symbols = index.symbols.drop("terms") if kind is None else index.symbols.drop("terms").where(F.col("kind") == kind)
    places = symbols.select("file", F.col("line_start").alias("start"), F.col("line_end").alias("stop"), F.col("qname").alias("name"), (F.col("kind") == "module").alias("is_module"))
    found = spans.attribute(hits, places, "file").where("name is not null").select("file", "line", "txt", F.col("name").alias("qname"))
    rows = found.join(symbols.drop("file"), "qname").orderBy("file", "line", "qname").limit(max_results)
    rows = (body_of(index, rows, body_char_cap) if with_bodies else rows).orderBy("file", "line", "qname").collect()
    callers: dict[str, list] = {}
    if with_callers and rows:
        for r in graph.callers_of(index.calls, "callee_qname", "caller_qname", "line").where(F.col("callee_qname").isin(sorted({r.qname for r in rows}))).orderBy("caller_qname").collect():
            callers.setdefault(r.callee_qname, []).append({"qname": r.caller_qname, "line": r.first_line})
    matches = [shown(r) | {"match_line": r.line, "match_text": r.txt} | ({"callers": callers.get(r.qname, [])} if with_callers else {}) for r in rows]
    full = len(matches) >= max_results
    hint = "Nothing indexed holds it: grep reads other files as well." if not matches else f"{len(matches)} places" + (", and there may be more." if full else ".")
    return {"literal": literal, "matches": matches, "match_count": len(matches), "truncated": full, "hint": hint}


def grep_files(spark: SparkSession, pattern: str, root: str | Path = ".", scope: str | None = None, regex: bool = False, in_path: str | None = None, case_insensitive: bool = False, context_lines: int = 1, max_results: int = 200, max_files: int = 5000, definitions_first: bool = True) -> dict:
    """Matching lines of all text files below the root, definitions first."""
    if scope is not None:
        return {"pattern": pattern, "error": "scope_unsupported", "hint": "Packages are searched through their index."}
    if regex:
        try:
            re.compile(pattern)
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:  # either dialect refuses it
            return {"pattern": pattern, "error": "invalid_regex", "hint": str(e).split("\n")[0]}
    base = str(Path(root).resolve())
    below = None if in_path is None else str((Path(base) / in_path).resolve())
    names = [n for n in list_files(base, any_text=True) if below is None or f"{base}/{n}" == below or f"{base}/{n}".startswith(below.rstrip("/") + "/")]
    listed = spark.createDataFrame([(n,) for n in names], "rel string")
    files = contents(listed, base, True, len(names))
    if max_files is not None and len(names) > max_files:  # names are limited, and only then contents read
        text = files.select("rel").orderBy("rel").limit(max_files)
        files = contents(text, base, True, max_files)
    files = files.select("file", F.decode("content", "UTF-8").alias("content"))
    hits = spans.grep(files, "file", "content", pattern, regex, case_insensitive, context_lines)
    rows = hits.orderBy("file", "line").limit(max_results)  # the cap comes before the sort by definition
    try:
        symbols = Index(spark, root).symbols
        places = symbols.select("file", F.col("line_start").alias("start"), F.col("line_end").alias("stop"), F.col("qname").alias("name"), (F.col("kind") == "module").alias("is_module"))
        rows = spans.attribute(rows, places, "file", prefer_members=False)
    except FileNotFoundError:
        rows = rows.withColumn("name", F.lit(None).cast("string"))
    rows = rows.orderBy(*([F.desc("is_definition")] if definitions_first else []), "file", "line").collect()
    matches = [{"file": r.file, "line": r.line, "text": r.txt, "before": list(r.before), "after": list(r.after), "is_definition": r.is_definition, "qname": r.name if isinstance(r.name, str) else None} for r in rows]
    return {"pattern": pattern, "regex": regex, "matches": matches, "match_count": len(matches), "truncated": len(matches) >= max_results, "hint": "" if matches else "No line matches; the literal may be spelt otherwise, or ignored by the scan's rules."}


# ---- maps --------------------------------------------------------------------


def map_repo(spark: SparkSession, root: str | Path = ".", scope: str | None = None, depth: int = 1, prefix: str | None = None, mode: str = "lean") -> dict:
    """Folders, files and their top-level symbols."""
    if mode not in ("lean", "full"):
        raise ValueError("mode is lean or full")
    index, base = Index(spark, root, scope), str(Path(root).resolve())
    at = None if prefix is None else str((Path(base) / prefix).resolve())
    rows = views.repository_map(index.symbols.drop("terms"), at, depth).orderBy("dir", "file").collect()
    folders: dict[str, list] = {}
    for r in rows:
        def one(s, name):
            return {"qname": s[name], "kind": s.kind, "lines": s.line_start} | ({"signature": s.signature} if mode == "full" else {}) | ({"children": [one(c, "member") for c in s.children]} if "children" in s and s.children else {})

        folders.setdefault(r.dir, []).append({"file": r.file.removeprefix(base + "/"), "docstring": T.doc_summary(r.module_doc), "symbols": [one(s, "qname") for s in r.symbols]})
    return {"root": base, "depth": depth, "directories": [{"dir": d.removeprefix(base).lstrip("/") or ".", "files": files} for d, files in folders.items()], "file_count": len(rows), "symbol_count": sum(r.symbol_count for r in rows)}


def session_skeleton(spark: SparkSession, roots: list[str | Path], render: str = "compact", max_chars: int = 8000, anchor: str | Path | None = None) -> str:
    """A text of folders, files and names; it ends before the first folder that no longer fits."""
    if render not in ("compact", "lines"):
        raise ValueError("render is compact or lines")
    blocks, lost = [], []
    for number, root in enumerate(roots):
        base = str(Path(root).resolve())
        label = str(Path(base).relative_to(Path(anchor).resolve())) if anchor and Path(base).is_relative_to(Path(anchor).resolve()) else base
        try:
            index = Index(spark, base)
        except FileNotFoundError:
            lost.append(f"# {label}: not indexed")
            continue
        tops = index.symbols.where("parent_qname is null and kind <> 'module'")
        name = F.regexp_replace("qname", "^.*:", "")
        files = tops.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line_start", name.alias("name")))).alias("n"))
        line = F.concat(F.regexp_replace("file", "^.*/", ""), F.lit(": "), F.array_join(F.transform("n", lambda x: x["name"]), ", " if render == "compact" else "\n    "))
        dirs = files.groupBy(F.regexp_replace(F.substring("file", len(base) + 2, 1 << 20), "/?[^/]*$", "").alias("dir")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
        blocks.append(dirs.select(F.lit(number).alias("place"), "dir", F.concat(F.lit(f"## {label}/"), "dir", F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("block")))
    if not blocks:
        return "\n".join(lost)
    every = blocks[0]
    for more in blocks[1:]:
        every = every.unionByName(more)
    every = every.withColumn("size", F.length("block"))
    kept = views.within_budget(every, [], ["place", "dir"], "size", max_chars).orderBy("place", "dir").collect()
    skipped = every.count() - len(kept)
    return "\n".join([*lost, *(r.block for r in kept), *([f"# ... {skipped} more folders"] if skipped else [])])


# ---- routes ------------------------------------------------------------------


def list_routes(spark: SparkSession, root: str | Path = ".") -> dict:
    rows = Index(spark, root).routes.orderBy("path", "method", "defined_in", "line").collect()
    return {"routes": [r.asDict() for r in rows], "route_count": len(rows), "hint": "" if rows else "No urls.py or route file declares a route."}


def lookup_route(spark: SparkSession, path: str, root: str | Path = ".") -> dict:
    rows = Index(spark, root).routes.where(F.col("path") == path).orderBy("method", "defined_in", "line").collect()
    return {"path": path, "routes": [r.asDict() for r in rows], "hint": "" if rows else "The path must be written as it is declared: list the routes."}


# ---- context -----------------------------------------------------------------


def context(spark: SparkSession, query: str, k_seeds: int = 5, source_for_top: int = 5, expand_depth: int = 2, neighbor_limit: int = 8, body_char_cap: int = 2000, file_outline_limit: int = 8, outline_discovery_k: int = 15, mode: str = "hybrid", kind: str | None = None, root: str | Path = ".", scope: str | None = None, embedder: vectors.Embedder | None = None) -> dict:
    """Search hits with sources, neighbours and outlines in one answer, within a budget of tokens."""
    index = Index(spark, root, scope)
    exact = index.symbols.where(F.col("qname") == query).drop("terms").first() if ":" in query else None
    if exact is not None:
        seeds = pool = [shown(exact) | {"score": 1.0}]
        mode = "exact"
    else:
        pool = search_code(spark, query, max(k_seeds, outline_discovery_k), kind, root, mode, scope, embedder=embedder)["results"]
        seeds = pool[:k_seeds]
    names = [s["qname"] for s in seeds]
    bodies = {r.qname: r.source for r in body_of(index, index.symbols.where(F.col("qname").isin(names[:source_for_top])), body_char_cap).select("qname", "source").collect()} if names else {}
    around = {way: neighbors(index, names, way, neighbor_limit, expand_depth) for way in ("callees", "callers")} if names else {}
    out_seeds = []
    for rank, seed in enumerate(seeds, 1):
        entry = {"rank": rank} | {k: v for k, v in seed.items() if k != "next_action"} | {way: found.get(seed["qname"], []) for way, found in around.items()}
        entry |= {"source": bodies[seed["qname"]]} if seed["qname"] in bodies else {}
        if seed["kind"] == "constant" and (chain := constant_chain(index, seed["qname"])):
            entry["resolved_value"] = chain
        out_seeds.append(entry)
    files = list(dict.fromkeys(p["file"] for p in pool))[:file_outline_limit]
    rows = index.symbols.where(F.col("file").isin(files)).select("file", "qname", "kind", "signature", "line_start", "line_end").orderBy("line_start", "qname").collect() if files else []
    outlines = [{"file": f, "symbols": [{"qname": r.qname, "kind": r.kind, "signature": r.signature, "lines": f"{r.line_start}-{r.line_end}"} for r in rows if r.file == f]} for f in files]
    out = {"query": query, "mode": mode} | ({"scope": scope} if scope else {}) | {"seeds": out_seeds, "file_outlines": outlines}
    literal = T.audit_literal(query)
    if literal:
        found = find_literal(spark, literal, root, scope)
        out["find_results"] = {"literal": literal, "match_count": found["match_count"], "truncated": found["truncated"], "matches": [{k: m[k] for k in ("qname", "file", "match_line", "match_text")} for m in found["matches"]]}
    return within_tokens(out)


def within_tokens(out: dict, soft: int = SOFT_TOKENS, hard: int = HARD_TOKENS) -> dict:
    """Over the soft budget outlines go, over the hard one bodies are halved, down to 400 characters."""
    note = ""
    if T.rough_tokens(out) > soft:
        out["file_outlines"], note = [], "File outlines were left out for size. "
    cap = max((len(s.get("source") or "") for s in out["seeds"]), default=0)
    while T.rough_tokens(out) > hard and cap > LEAST_BODY:
        cap = max(LEAST_BODY, cap // 2)
        for s in out["seeds"]:
            if len(s.get("source") or "") > cap:
                s["source"] = s["source"][:cap] + "\n# ... truncated ..."
        note = "Sources were cut for size. "
    if "find_results" in out:
        note = f"Every place of {out['find_results']['literal']!r} is in find_results ({out['find_results']['match_count']}). " + note
    return out | {"token_estimate": T.rough_tokens(out), "hint": note + "For more, expand, outline or get_source on one name."}
