"""Traversal, intervals and call resolution against plain versions; refreshes against an index made anew."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cooccurrence, graph, segments, snapshots, spans, vectors, views
from sparkloom.plans import index as ix
from sparkloom.plans import read


def test_walk_finds_nodes_in_the_order_of_its_layers(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), int(way), n) for n, (a, b, way) in enumerate(zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 2, 300), strict=True))]
    layer, seen, want = [3], {3}, [(3, 0, None)]
    for hop in (1, 2, 3):
        fresh = []
        for node in layer:
            for _, dst, _, _ in sorted((e for e in edges if e[0] == node), key=lambda e: (e[2], e[3])):
                if dst not in seen:
                    seen.add(dst)
                    fresh.append(dst)
                    want.append((dst, hop, node))
        layer = fresh
    rows = spark.createDataFrame(edges, "src long, dst long, way int, n int").repartition(5)
    got = graph.expand(rows, spark.createDataFrame([(3,)], "node long"), 3, ("way", "n")).orderBy("hop", "ord").collect()
    assert [(r.node, r.hop, r.via) for r in got] == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]


def _plain_attribute(hits, places, members):
    out = []
    for key, line in hits:
        around = [((m and members), stop - start, start, name) for k, start, stop, name, m in places if k == key and start <= line <= stop]
        out.append((key, line, min(around)[3] if around else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("members", [True, False])
def test_lines_get_the_innermost_interval_whether_nested_or_crossing(spark, members):
    rng = np.random.default_rng(2)
    places = [(f"f{rng.integers(4)}", int(a), int(a + n), f"n{k}", bool(k % 9 == 0)) for k, (a, n) in enumerate(zip(rng.integers(1, 80, 200), rng.integers(-2, 30, 200), strict=True))]
    hits = [(f"f{rng.integers(5)}", int(line)) for line in rng.integers(1, 120, 150)]
    got = spans.attribute(spark.createDataFrame(hits, "file string, line int"), spark.createDataFrame(places, "file string, start int, stop int, name string, is_module boolean"), "file", members)
    assert sorted([(r.file, r.line, r.name) for r in got.collect()], key=str) == _plain_attribute(hits, places, members)


def test_ten_thousand_nested_intervals_make_no_pairs(spark):
    depth = 10_000
    nested = spark.range(depth).select(F.lit("f").alias("file"), (F.col("id") + 1).cast("int").alias("start"), (F.lit(2 * depth) - F.col("id")).cast("int").alias("stop"), F.col("id").cast("string").alias("name"), (F.col("id") == 0).alias("is_module"))
    hits = spark.range(2 * depth).select(F.lit("f").alias("file"), (F.col("id") + 1).cast("int").alias("line"))
    got = {r.line: r.name for r in spans.attribute(hits, nested, "file").collect()}
    assert len(got) == 2 * depth and all(got[n] == str(min(n, 2 * depth + 1 - n) - 1) for n in range(1, 2 * depth + 1))


def test_imports_match_modules_by_their_prefixes(spark):
    offered = spark.createDataFrame([("run", "a.b", "a.b:run"), ("run", "a.b.c", "a.b.c:run"), ("run", "ab", "ab:run"), ("go", "x.y.z", "x.y.z:go"), ("go", "", ":go")], "o_name string, o_module string, found_q string")
    wanted = spark.createDataFrame([(1, "run", "a"), (2, "run", "a.b.c"), (3, "run", "ab"), (4, "go", "x"), (5, "go", "x.y.z.w"), (6, "go", ""), (7, "run", "a.b")], "call_id long, real string, i_module string")
    got = {r.call_id: r.found_q for r in graph.imported_targets(wanted, offered).collect()}
    assert got == {2: "a.b.c:run", 3: "ab:run", 4: "x.y.z:go", 6: ":go"}  # two fit calls 1 and 7


def test_imports_that_many_fit_make_no_pairs(spark):
    offered = spark.range(20_000).select(F.lit("run").alias("o_name"), F.lit("a.b").alias("o_module"), F.col("id").alias("found_q")).union(spark.createDataFrame([("go", "a", 7)]))
    wanted = spark.range(40_000).select(F.col("id").alias("call_id"), F.when(F.col("id") == 5, "go").otherwise("run").alias("real"), F.lit("a").alias("i_module"))
    found = graph.imported_targets(wanted, offered)
    rows = lambda: _made(found)
    assert [tuple(r) for r in found.collect()] == [(5, 7)]
    assert 0 < max(rows()) <= 60_000  # 800 million pairs fit


def _made(frame):
    """Rows that each join of a plan that has run has made."""
    plan, found = frame._jdf.queryExecution().executedPlan(), []
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
        elif hasattr(node, "plan") and name.endswith("QueryStage"):
            waiting.append(node.plan())
        else:
            if "Join" in name:
                found.append(node.longMetric("numOutputRows").value())
            children = node.children()
            waiting += [children.apply(k) for k in range(children.size())]
    return found


def _world(rng, files):
    """Symbols, calls and imports of made-up files; every name is shared by some."""
    names = [f"n{k}" for k in range(12)]
    symbols, calls, imports = {}, {}, {}
    for file in files:
        module = f"pkg{file % 3}.m{file}"
        tops = list(dict.fromkeys(rng.choice(names, 3)))
        symbols[file] = [(f"{module}:{n}", "function", str(file), None) for n in tops] + [(f"{module}:C", "class", str(file), None), (f"{module}:C.{rng.choice(names)}", "method", str(file), f"{module}:C")]
        caller = symbols[file][0][0]
        calls[file] = [(1000 * file + k, caller if k % 2 else f"{module}:C.m", str(c), f"{module}:{c}" if k % 5 == 0 else None, str(file), k) for k, c in enumerate([*rng.choice(names, 4), f"self.{rng.choice(names)}", f"self.{rng.choice(names)}"])]
        imports[file] = [(10 * file + k, str(file), f"pkg{rng.integers(3)}" + (f".m{rng.integers(14)}" if k else ""), str(rng.choice(names)), None if k else "n0", k) for k in range(2)]
    return symbols, calls, imports


SYMBOLS, CALLS, IMPORTS = "qname string, kind string, file string, parent_qname string", "call_id long, caller_qname string, callee_name string, callee_qname string, file string, line int", "import_id long, file string, module string, name string, alias string, line int"


def test_two_hundred_edits_resolve_as_all_calls_anew(spark):
    rng = np.random.default_rng(7)
    symbols, calls, imports = _world(rng, range(14))
    flat = lambda t: [r for f in sorted(t) for r in t[f]]
    made = lambda s, c, i: (spark.createDataFrame(flat(s), SYMBOLS), spark.createDataFrame(flat(c), CALLS), spark.createDataFrame(flat(i), IMPORTS))
    whole = lambda: {r.call_id: r.callee_qname for r in graph.resolve_calls(*(lambda s, c, i: (c, s, i))(*made(symbols, calls, imports))).collect()}
    held, redone = whole(), 0
    for _ in range(5):
        before = spark.createDataFrame(flat(symbols), SYMBOLS)
        edited = set()
        for _ in range(40):
            file = int(rng.integers(14)) if rng.random() < 0.2 else int(rng.integers(3))
            edited.add(file)
            part = _world(rng, [file])
            for table, own in zip((symbols, calls, imports), part, strict=True):
                table[file] = own[file] if rng.random() < 0.9 else []
        s, c, i = made(symbols, calls, imports)
        gone = spark.createDataFrame([(str(f),) for f in edited], "file string")
        needs = graph.needs(c.withColumnRenamed("callee_qname", "guess"), i)
        names = graph.changed_names(before.join(gone, "file", "left_semi"), s.join(gone, "file", "left_semi"))
        again = graph.touched_calls(c, needs, names, gone)
        ask = again.unionByName(c.join(gone, "file", "left_semi"))
        asked_names = needs.join(ask.select("call_id"), "call_id", "left_semi").select("name").distinct()
        few = s.withColumn("name", graph.simple_name(F.col("qname"))).join(asked_names, "name", "left_semi").drop("name")
        fresh = {r.call_id: r.callee_qname for r in graph.resolve_calls(ask, few, i).collect()}
        redone += len(fresh)
        known = {r[0] for r in flat(calls)}
        held = {k: v for k, v in held.items() if k in known} | fresh
        assert held == whole()
    assert any(held.values()) and redone < 5 * len(held)


def _state(spark, tree):
    index = ix.Index(spark, tree)
    rel = lambda f: f.removeprefix(str(tree))
    return {
        "symbols": sorted((r.qname, rel(r.file), r.kind, r.line_start) for r in index.symbols.collect()),
        "calls": sorted((r.caller_qname, r.callee_name, r.callee_qname or "", r.line, rel(r.file)) for r in index.calls.collect()),
        "imports": sorted((rel(r.file), r.module, r.name or "") for r in index.imports.collect()),
        "files": sorted((rel(r.file), r.sha) for r in index.files.collect()),
        "vectors": sorted(r.qname for r in index.vectors.collect()),
        "search": [(r["qname"], round(r["score"], 6)) for q in ("hash token", "load_settings") for r in read.search_code(spark, q, root=tree, mode="lexical")["results"]],
    }


def test_refreshes_by_file_equal_an_index_made_anew(spark, tree, monkeypatch):
    monkeypatch.setattr(segments, "MOST", 2)
    ix.refresh(spark, tree)
    before = ix.Index(spark, tree).store.manifest["segments"]
    (tree / "pkg/utils.py").write_text("from pkg.auth import login\nTTL = 1\n\n\ndef digest(x):\n    return login(x)\n\n\ndef load_settings():\n    return digest(1)\n")
    out = ix.refresh(spark, tree)
    after = ix.Index(spark, tree).store.manifest["segments"]
    assert out["updated"] == 1 and [s["seg"] for s in after[:-1]] == [s["seg"] for s in before] and after[-1]["rows"]["files"] == 1
    (tree / "pkg/rival.py").write_text("def login(name):\n    return 2\n")
    (tree / "pkg/auth/").mkdir()
    (tree / "pkg/auth/__init__.py").write_text("def login(name):\n    return 3\n")  # the name of a symbol in pkg/auth.py
    ix.refresh(spark, tree)
    (tree / "pkg/auth.py").unlink()
    (tree / "pkg/utils.py").write_text("def hash_token(token):\n    return len(token)\n")
    ix.refresh(spark, tree, only=["pkg/utils.py", "pkg/auth.py"])
    got = _state(spark, tree)
    ix.refresh(spark, tree, force=True)
    assert got == _state(spark, tree)
    assert ("pkg.auth:login", "/pkg/auth/__init__.py", "function", 1) in got["symbols"]


def test_running_sums_of_one_group_come_from_many_tasks(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 5000).alias("n"), (F.col("id") % 5 + 1).alias("size")).unionByName(spark.createDataFrame([(None, 1, 3), (None, 0, 4), ("h", 9, None), ("h", 10, 2)], "g string, n long, size long"))
    got = {(r.g, r.n): r.used for r in views.running_sums(rows.repartition(4), ["g"], ["n"], "size").collect()}
    total = 0
    for n, size in sorted((i * 7919 % 5000, i % 5 + 1) for i in range(5000)):
        total += size
        assert got["g", n] == total
    assert got[None, 0] == 4 and got[None, 1] == 7 and got["h", 10] == 2 and len(got) == 5004


def test_constant_chains_follow_names_and_never_return(spark):
    consts = [("m:A", "A", "B"), ("m:B", "B", "pkg.C"), ("m:C", "C", "D"), ("m:D", "D", "E"), ("m:E", "E", "5"), ("m:X", "X", "Y"), ("m:Y", "Y", "X"), ("n:B", "B", "9"), ("m:S", "S", "'text'"), ("m:L", "L", "L")]
    got = {r.start: (r.chain, r.terminal, r.value) for r in graph.constant_chains(spark.createDataFrame(consts, "qname string, name string, value string"), spark.createDataFrame([(c[0],) for c in consts] + [("gone",)], "qname string")).collect()}
    assert got["m:A"] == (["m:B", "m:C", "m:D"], "m:D", "E") and got["m:C"] == (["m:D", "m:E"], "m:E", "5")
    assert got["m:X"] == (["m:Y"], "m:Y", "X") and got["m:S"] == ([], "m:S", "'text'") and got["m:L"] == ([], "m:L", "L") and "gone" not in got


def test_folder_digests_change_on_the_path_of_a_changed_file_alone(spark):
    files = {"a.py": "1", "p/b.py": "2", "p/q/c.py": "3", "p/q/r/d.py": "4", "s/e.py": "5"}
    digests = lambda f: {r.folder: r.digest for r in snapshots.folder_digests(spark.createDataFrame(list(f.items()), "rel string, sha string"), "rel", "sha").collect()}
    before = digests(files)
    assert set(before) == {"", "p", "p/q", "p/q/r", "s"} and before == digests(dict(reversed(files.items())))
    after = digests(files | {"p/q/c.py": "x"})
    assert {f for f in before if before[f] != after[f]} == {"", "p", "p/q"}
    assert digests({k: v for k, v in files.items() if k != "s/e.py"}).keys() == before.keys() - {"s"}
    assert digests({"p": "2"})[""] != digests({"p/b.py": "2"})[""]
    assert snapshots.folder_digests(spark.createDataFrame([], "rel string, sha string"), "rel", "sha").count() == 0


def _company(rng):
    """Texts in which words of a group stand among the same others, but never beside each other."""
    groups = {("login", "entry"): ["user", "session", "token", "account"], ("parse", "scanning"): ["grammar", "lexer", "syntax", "tree"], ("invoice", "receipt"): ["price", "tax", "total", "payment"]}
    out = []
    for alike, company in groups.items():
        for word in alike:
            for _ in range(60):
                out.append(" ".join([word, *rng.choice(company, 3), *rng.choice(["get", "set", "make"], 1)]))
    return out, list(groups)


def test_words_of_the_same_company_are_near_where_names_share_nothing(spark):
    texts, groups = _company(np.random.default_rng(6))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    table = cooccurrence.word_vectors(rows.select(cooccurrence.name_words(F.col("text")).alias("words")), "words", dims=16)
    model, plain = cooccurrence.WordEmbedder.of(table), vectors.HashEmbedder()
    names = [w for g in groups for w in g]
    near, far = model.embed(names) @ model.embed(names).T, plain.embed(names) @ plain.embed(names).T
    for k in range(0, len(names), 2):
        others = [n for n in range(len(names)) if n not in (k, k + 1)]
        assert near[k, k + 1] > 0.7 > max(near[k, n] for n in others) + 0.2 and abs(far[k, k + 1]) < 0.3
    assert not model.embed(["unseen", ""]).any()
    again = {r.word: r.vector for r in cooccurrence.word_vectors(rows.repartition(3).select(cooccurrence.name_words(F.col("text")).alias("words")), "words", dims=16).collect()}
    assert np.allclose(np.abs(again["login"]), np.abs(model.words["login"][1]), atol=1e-4)
    assert cooccurrence.word_vectors(rows.limit(0).select(cooccurrence.name_words(F.col("text")).alias("words")), "words").count() == 0


def test_pairs_and_information_are_those_of_a_plain_count(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "c"],), (["b", "a"],), (["c"],), ([],), (None,)], "words array<string>")
    got = {(r.word, r.other): r.n for r in cooccurrence.pairs(rows, "words", 2).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    w = {(r.word, r.other): r.w for r in cooccurrence.information(cooccurrence.pairs(rows, "words", 2)).collect()}
    assert w["a", "b"] == pytest.approx(np.log(3 * 10 / (4 * 4))) and ("b", "c") in w and w["b", "c"] == pytest.approx(np.log(10 / (4 * 2)))


def test_information_shuffles_a_pair_in_one_way_alone(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "c"],), (["b", "a"],), (["c"],), ([],), (None,)], "words array<string>")
    assert {(r.a, r.b): r.n for r in cooccurrence.unordered(rows, "words", 2).collect()} == {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 1}
    w = cooccurrence.word_information(rows, "words", 2)
    assert sorted(w.collect()) == sorted(cooccurrence.information(cooccurrence.pairs(rows, "words", 2)).collect()) and w.count() == 6
    assert "SortMergeJoin" not in w._jdf.queryExecution().executedPlan().toString()  # pairs meet a small vocabulary where they are


def test_an_index_with_learned_words_keeps_them(spark, tree):
    ix.refresh(spark, tree, embedder="words")
    index = ix.Index(spark, tree)
    assert isinstance(index.embedder, cooccurrence.WordEmbedder) and index.embedder.words
    (tree / "pkg/utils.py").write_text("def hash_token(token):\n    return len(token)\n\n\ndef token_session(token):\n    return hash_token(token)\n")
    ix.refresh(spark, tree)
    again = ix.Index(spark, tree)
    assert again.embedder.words.keys() == index.embedder.words.keys()
    assert len(again.vectors.where("qname = 'pkg.utils:token_session'").first().vector) == cooccurrence.DIMENSIONS
    assert read.search_code(spark, "session token", root=tree)["results"]
