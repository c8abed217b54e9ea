"""Text functions, ranking, parsers, scan rules: small cases without a tree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.stem import stem, terms
from sparkloom.operators import fusion, graph, lexical, spans
from sparkloom.sources import config, ignore, names, routes, scan
from sparkloom.sources.parsers import language_of, parse_file, python, script, shell


# ---- text ---------------------------------------------------------------------


@pytest.mark.parametrize(("query", "kind"), [("run_exscript", "identifier"), ("apps.auth:login", "identifier"), ("getUser now", "identifier"), ("MAX", "identifier"), ("rate limit", "mixed"), ("", "mixed"), ("how does the login work", "natural"), ("where is the cache", "natural"), ("cache of user data", "mixed")])
def test_query_class(spark, query, kind):
    assert T.query_class(query) == kind
    if query:
        assert spark.range(1).select(T.query_class_col(F.lit(query))).first()[0] == kind


def test_names():
    assert T.exact_name("Button") == "button" and T.exact_name("two words") is None and T.exact_name("x") is None
    assert T.simple_name("app.auth:User.login") == "login" and T.simple_name("plain") == "plain"
    assert T.identifier_words("SessionManager.refresh_tokenHTTPServer2") == ["session", "manager", "refresh", "token", "http", "server2"]
    assert T.name_parts("HTTPServer2 getX") == ["http", "server", "2", "get", "x"]
    assert T.singular("queries") == "query" and T.singular("ties") == "tie" and T.singular("bus") == "bus"
    assert T.symbol_words("the default Navigators model", query=True) == {"default", "navigator", "model"}
    assert T.path_hints("see frontend/i18n, http://a/b and a/b") == ["frontend/i18n"]
    assert T.audit_literal("find all transaction.atomic sites") == "transaction.atomic"
    assert T.audit_literal("find all a.b and c.d") is None and T.audit_literal("transaction.atomic") is None
    assert T.doc_summary("\n first\nsecond") == "first" and T.doc_summary("") is None and T.line_range("3-9") == (3, 9)
    assert T.match_terms("run_exscript !!! a") == [["run", "exscript"], ["a"]] and T.match_terms("!!!") == []


def test_columns_agree_with_plain_functions(spark):
    samples = ["app.auth:User.getTokens", "HTTPServer_x9", "a-b/c.d", "pkg:Ties", "plain"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", T.identifier_words_col(F.col("s")), T.simple_name_col(F.col("s")), T.symbol_words_col(F.col("s"))).collect()
    for s, words, simple, symbols in rows:
        assert words == T.identifier_words(s) and simple == T.simple_name(s) and set(symbols) == T.symbol_words(s)


def test_lines_as_splitlines(spark):
    samples = ["a\nb\n", "", "\n", "a\r\nb\rc", "x\x0cy z", "no end", "a\n\n"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", T.lines(F.col("s"))).collect()
    for s, lines in rows:
        assert lines == s.splitlines(), repr(s)


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "electrical": "electr", "hopefulness": "hope", "adoption": "adopt", "controll": "control", "roll": "roll", "runs": "run", "generalization": "gener"}
    assert {w: stem(w) for w in pairs} == pairs
    assert terms("Café runs_fast") == ["cafe", "run", "fast"]


# ---- ranking --------------------------------------------------------------------


def _fused(spark, rows):
    return spark.createDataFrame([(q, s, (0, i), f, lang, d) for i, (q, s, f, lang, d) in enumerate(rows)], "qname string, score double, seen struct<list:int,rank:int>, file string, language string, decorators string")


def _order(df):
    return [r.qname for r in df.collect()]


def test_rank_bonuses_and_penalties(spark):
    rows = [("m:test_it", 0.02, "/r/tests/a.py", "python", None), ("m:other", 0.0199, "/r/a.py", "python", None)]
    assert _order(fusion.rank_symbols(_fused(spark, rows), "some words here", (1.0, 1.5), 5)) == ["m:other", "m:test_it"]
    docs = [("README.md:Navigation", 0.02, "/r/README.md", "markdown", None), ("m:go", 0.0199, "/r/a.py", "python", None)]
    assert _order(fusion.rank_symbols(_fused(spark, docs), "how does navigation work here", (0.5, 2.5), 5)) == ["m:go", "README.md:Navigation"]
    assert _order(fusion.rank_symbols(_fused(spark, docs[:1]), "how does navigation work here", (0.5, 2.5), 5)) == ["README.md:Navigation"]
    named = [("m:uses_button", 0.02, "/r/a.py", "python", None), ("m:Button", 0.01, "/r/b.py", "python", None)]
    assert _order(fusion.rank_symbols(_fused(spark, named), "Button", (1.0, 1.5), 1)) == ["m:Button"]
    routed = [("m:one", 0.02, "/r/a.py", "python", None), ("m:two", 0.019, "/r/b.py", "python", "@api_view(['GET'])")]
    assert _order(fusion.rank_symbols(_fused(spark, routed), "the view for it", (1.0, 1.5), 5))[0] == "m:two"
    hinted = [("m:one", 0.02, "/r/a.py", "python", None), ("m:two", 0.019, "/r/frontend/i18n/b.py", "python", None)]
    assert _order(fusion.rank_symbols(_fused(spark, hinted), "thing in frontend/i18n", (1.0, 1.5), 5))[0] == "m:two"


def test_fuse_and_merge(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    got = {r.k: r.score for r in fusion.fuse([(a, 1.0), (b, 1.5)], "k").collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1.5 / 61})
    two = [spark.createDataFrame([("x", 0.5), ("y", 0.1)], "k string, score double"), spark.createDataFrame([("y", 0.9)], "k string, score double")]
    assert [tuple(r) for r in fusion.merge_terms(two, "k", 2).collect()] == [("y", 0.9), ("x", 0.5)]


def test_intervals(spark):
    hits = spark.createDataFrame([("f", 3), ("f", 9), ("g", 1)], "file string, line int")
    places = spark.createDataFrame([("f", 1, 4, "mod", True), ("f", 1, 5, "cls", False), ("f", 2, 4, "meth", False)], "file string, start int, stop int, name string, is_module boolean")
    got = {(r.file, r.line): r.name for r in spans.attribute(hits, places, "file").collect()}
    assert got == {("f", 3): "meth", ("f", 9): None, ("g", 1): None}
    wide = spark.createDataFrame([("f", 1, 4, "mod", True), ("f", 1, 5, "cls", False)], places.schema)
    one = hits.where("line = 3")
    assert spans.attribute(one, wide, "file").first().name == "cls" and spans.attribute(one, wide, "file", prefer_members=False).first().name == "mod"


def test_expand_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (1, 3)], "src int, dst int")
    got = {r.node: (r.hop, r.via) for r in graph.expand(edges, spark.createDataFrame([(1,)], "node int"), 5).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1)}


def test_builtin_names(spark):
    rows = spark.createDataFrame([("?:len",), ("?:mine",), ("?:a.b.map",), ("?:a.mine",), ("m:len",)], "n string").select(graph.is_builtin_col(F.col("n"))).collect()
    assert [r[0] for r in rows] == [True, False, True, False, False]


# ---- sources ----------------------------------------------------------------------


def test_module_names():
    assert names.dotted_module("src/app/auth.py") == "src.app.auth" and names.dotted_module("src/app/__init__.py") == "src.app"
    assert names.slashed_module("src/index.tsx") == "src" and names.qualified("m", ["A", "b"]) == "m:A.b" and names.qualified("m") == "m:"
    assert language_of("x/.env") == "env" and language_of("a.min.js") == "typescript" and language_of("x.unknown") is None
    for bad, kind in ((None, TypeError), ("", ValueError), ("m:", ValueError), (":x", ValueError), ("m", ValueError)):
        with pytest.raises(kind):
            names.require_member(bad)
    names.require_member("m:x")


def test_python_parser():
    text = '''#!/usr/bin/env python
# This module explains in words what it is here for.
from typing import overload
import a.b as ab
from .rel import thing as t
LIMIT: int = 3
low: str = "x"
made: int = compute()
class Base(ab.Other, metaclass=Meta):
    KEY = (1, 2)
    @overload
    def f(self, x: int): ...
    @property
    def f(self, x: int = 1, /, *args: str, k=2, **kw) -> bool:
        def inner():
            return t()
        self.g(); self.a.b(); ab.run(x)
        return inner()
    async def g(self): return late()
def outer(x=make()): pass
'''
    language, out = parse_file("pkg/m.py", text.encode())
    kinds = {s[0]: s[1] for s in out.symbols}
    assert language == "python" and kinds == {"pkg.m:": "module", "pkg.m:LIMIT": "constant", "pkg.m:low": "constant", "pkg.m:Base": "class", "pkg.m:Base.KEY": "constant", "pkg.m:Base.f": "method", "pkg.m:Base.f.inner": "function", "pkg.m:Base.g": "method", "pkg.m:outer": "function"}
    by_name = {s[0]: s for s in out.symbols}
    assert by_name["pkg.m:"][3] == "This module explains in words what it is here for."
    assert by_name["pkg.m:Base.f"][2] == "def f(self, x: int=1, /, *args: str, k=2, **kw) -> bool".replace("int=1", "int = 1").replace("k=2", "k = 2")
    assert by_name["pkg.m:Base"][2] == "class Base(ab.Other, metaclass=Meta)" and by_name["pkg.m:Base"][8] == ["ab.Other"] and by_name["pkg.m:Base"][6] is None
    calls = {(c[0], c[1]): c[2] for c in out.calls}
    assert calls[("pkg.m:Base.f", "self.g")] == "a.b:Other.g"  # the member comes later: the first base is guessed
    assert calls[("pkg.m:Base.f", "self.a.b")] is None and calls[("pkg.m:Base.f", "ab.run")] == "a.b:run" and calls[("pkg.m:Base.f.inner", "t")] == "rel:thing"
    assert ("pkg.m:outer", "make") not in calls
    assert python.parse("x.py", "def (:").symbols == [] and python.parse("x.py", "").symbols == []
    assert python.leading_prose(["# import os", "# from x import y"]) is None


def test_script_parser():
    text = '''/** What it is. */
import React, { useState as us } from "react";
import * as api from "./lib/api";
export const MAX = 10;
const btn = cva("a");
export interface Shape extends Base { a: number }
export type Kind = "a" | "b";
export enum Color { Red }
/** Greets. */
export async function greet(name: string, o: { x: number } = { x: 1 }): Promise<string> {
  const inner = (a) => helper(a);
  return api.call(`x ${us(name)} }`); // }
}
function helper(a) { return a /* { */ }
export class Cat extends Animal implements Pet {
  static LIMIT = 5;
  constructor(private x: string) { super(x); this.run(); }
  async run(a: string): Promise<void> { greet(a); }
  go = (b) => { this.run(b); };
}
export const Card = ({ title }) => <div><Icon name="x" /></div>;
export default function Page() { return <Card title="a" />; }
'''
    _, out = parse_file("src/a/b.tsx", text.encode())
    kinds = {s[0].partition(":")[2]: s[1] for s in out.symbols}
    assert kinds == {"": "module", "MAX": "constant", "btn": "constant", "Shape": "interface", "Kind": "type", "Color": "class", "greet": "function", "greet.inner": "function", "helper": "function", "Cat": "class", "Cat.LIMIT": "constant", "Cat.constructor": "method", "Cat.run": "method", "Cat.go": "method", "Card": "component", "Page": "component"}
    lines = {s[0].partition(":")[2]: (s[4], s[5]) for s in out.symbols}
    assert lines["greet"] == (10, 13) and lines["Cat"] == (15, 20) and lines["Cat.constructor"] == (17, 17)
    calls = {(c[0].partition(":")[2], c[1]): c[2] for c in out.calls}
    assert calls[("greet", "api.call")] == "src/a/lib/api:call" and calls[("greet", "us")] == "react:useState" and calls[("Cat.go", "this.run")] == "src/a/b:Cat.run"
    assert calls[("Card", "<Icon>")] is None and calls[("Page", "<Card>")] == "src/a/b:Card" and calls[("greet.inner", "helper")] == "src/a/b:helper"
    assert out.imports == [("react", "default", "React", 2), ("react", "useState", "us", 2), ("./lib/api", "*", "api", 3)]
    assert script.introduced_problem("a(", "a((") == (1, 1) and script.introduced_problem("a(", "b(") is None and script.problems("'(' + `${f(1)}(`") == (0, None)


def test_shell_parser():
    text = "#!/bin/bash\n# Deploys.\nsource ./lib/util.sh\n\n# Says hi.\nhello() {\n  echo '}' # }\n}\nfunction main {\n  hello && echo hello\n}\n"
    _, out = parse_file("s/run.sh", text.encode())
    assert [(s[0], s[3], s[4], s[5], s[6]) for s in out.symbols] == [("s/run:", "Deploys.", 1, 11, None), ("s/run:hello", "Says hi.", 6, 8, "s/run:"), ("s/run:main", None, 9, 11, "s/run:")]
    assert out.calls == [("s/run:main", "hello", "s/run:hello", 10)] and out.imports == [("lib/util", None, None, 3)]
    assert shell.hide('a "b # c" # d') == 'a "     "    '


def test_markup_and_data_parsers():
    _, md = parse_file("d/a.md", b"Intro\nline\n\n# One\n## Two\n```\n# no\n```\n# Three #\n")
    assert [(s[0], s[4], s[5], s[6]) for s in md.symbols] == [("d/a.md:", 1, 9, None), ("d/a.md:One", 4, 8, "d/a.md:"), ("d/a.md:One.Two", 5, 8, "d/a.md:One"), ("d/a.md:Three", 9, 9, "d/a.md:")]
    assert md.symbols[0][3] == "Intro line"
    _, html = parse_file("t.html", b"<title>A &amp; B</title>\n<h1>Top {{ x }}</h1><!-- <b> -->\n<h2><b>Sub</b></h2>" + b" word" * 200)
    assert html.symbols[1][0] == "t.html:A & B" and html.symbols[2][0] == "t.html:Top" and html.symbols[-1][0] == "t.html:Top.Sub"
    assert html.symbols[0][3].endswith("word…") and len(html.symbols[0][3]) <= 481
    _, toml = parse_file("c.toml", b"# Head\na = 1\n[x.y]\nb = 2\n")
    assert [(s[0], s[1]) for s in toml.symbols] == [("c.toml:", "module"), ("c.toml:x.y", "class"), ("c.toml:a", "constant"), ("c.toml:x.y.b", "constant")] and toml.symbols[0][3] == "Head"
    assert len(parse_file("c.toml", b"a = = 1")[1].symbols) == 1 and len(parse_file("c.json", b"[1]")[1].symbols) == 1
    _, js = parse_file("c.json", b'{\n  "a": {\n    "b": 1\n  },\n  "c": 2\n}')
    assert [s[0] for s in js.symbols] == ["c.json:", "c.json:a", "c.json:c"] and js.symbols[1][2] == '"a": {'
    assert [s[0] for s in parse_file("c.yml", b"a: 1\n  b: 2\n- c\nd:\n")[1].symbols] == ["c.yml:", "c.yml:a", "c.yml:d"]
    assert [s[0] for s in parse_file(".env", b"# x\nexport A_B=1\nc=2\n")[1].symbols] == [".env:", ".env:A_B", ".env:c"]


def test_routes():
    text = "from django.urls import path\nfrom .views import Home as H\nfrom pkg import api\nurlpatterns = [path('a/', H.as_view()), re_path(r'^b$', api.list), path('c/', include('x.urls')), path(name, H), other(1, 2)]\n"
    assert [r[1:3] + r[4:] for r in routes.routes_of("site/urls.py", text)] == [("a/", "site.views:Home", "django"), ("^b$", "pkg.api:list", "django"), ("c/", None, "django:include=x.urls")]
    assert routes.routes_of("app/users/[id]/route.ts", "export const GET = 1;\nexport function helper() {}\n") == [("GET", "/users/[id]", "app/users/[id]/route:GET", 1, "nextjs")]
    assert routes.routes_of("a/views.py", text) == []


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.log", "a/b.log", True), ("/x", "x", True), ("/x", "a/x", False), ("dir/", "a/dir/f", True), ("dir/", "dir", False), ("a/**/z", "a/b/c/z", True), ("a/**", "a/b", True), ("**/k", "k", True), ("f?o", "f/o", False), ("[ab].c", "b.c", True), ("[!ab].c", "b.c", False), ("#x", "#x", False), ("\\#x", "#x", True), ("a/b", "x/a/b", False)])
def test_ignore_rules(pattern, path, hit):
    assert ignore.ignored(path, (pattern,)) is hit


def test_ignore_negation():
    assert ignore.ignored("a.log", ("*.log", "!a.log")) is False and ignore.ignored("b.log", ("*.log", "!a.log")) is True


def test_config(tmp_path):
    assert config.load_config(tmp_path) == config.ScanConfig()
    path = tmp_path / config.CONFIG_NAME
    path.write_text('[walker]\nlanguages = ["python"]\nextra_skip_dirs = ["gen"]\nunknown = 1\n')
    made = config.load_config(tmp_path)
    assert made.languages == {"python"} and made.extra_skip_dirs == ("gen",) and scan.enabled_extensions(made) == {".py", ".pyi"} and "gen" in scan.skip_dirs(made)
    for bad in ("max_file_size = 0", "max_file_size = true", "languages = []", 'extra_include = "x"', "skip_vendor_bundles = 1"):
        path.write_text(f"[walker]\n{bad}\n")
        with pytest.raises(ValueError):
            config.load_config(tmp_path)


def test_scan_and_listing_agree(spark, tree):
    got = sorted(r.rel for r in scan.scan(spark, tree).select("rel").collect())
    assert got == scan.list_files(tree) and "node_modules/lib/index.js" not in got and "ignored/secret.py" not in got and "pkg/a.log.py" not in got
    every = {r.rel for r in scan.scan(spark, tree, any_text=True).select("rel").collect()}
    assert every >= set(got) - {"pkg/__init__.py"}


def test_roots_and_packages(tmp_path):
    (tmp_path / "a/.sparkloom").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "b/package.json").write_text("{}")
    assert scan.discover_roots(tmp_path / "a") == [tmp_path / "a"] and scan.discover_roots(tmp_path) == [tmp_path / "a"]
    assert scan.subprojects(tmp_path) == [tmp_path / "b"]
    for name in (".venv/lib/python3.1/site-packages/dj", ".venv/lib/python3.1/site-packages/dj-1.dist-info", "node_modules/react", "node_modules/@s", "node_modules/dj"):
        (tmp_path / name).mkdir(parents=True)
    found = scan.discover_packages(tmp_path)
    assert set(found) == {"dj", "react"} and "site-packages" in str(found["dj"])
    assert scan.query_scope("dj: how it works", found) == ("dj", "how it works") and scan.query_scope("other: x", found)[0] is None


def test_watch_debounces(spark, tree):
    import threading
    import time

    from sparkloom.plans import index as ix
    from sparkloom.streaming.refresh import watch_root

    ix.refresh(spark, tree)
    seen, done = [], threading.Event()
    thread = threading.Thread(target=watch_root, args=(spark, tree, 0.3, done.is_set, 0.05, lambda c: (seen.append(c), done.set())))
    thread.start()
    time.sleep(0.4)
    for k in range(3):
        (tree / "pkg/utils.py").write_text(f"A = {k}\n")
        time.sleep(0.05)
    thread.join(120)
    done.set()
    assert len(seen) == 1 and seen[0]["updated"] == 1


def test_streaming_sessions(spark, tmp_path):
    from sparkloom.streaming import watch

    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:20"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:00:05")], "k string, ts string").selectExpr("k", "cast(ts as timestamp) ts")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = watch.debounced(stream, "k", "ts", "1 minute", "1 second")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {(r.k, r.events) for r in watch.sessions(rows, "k", "ts", "1 minute").collect()}
    assert batch == {("a", 2), ("a", 1), ("b", 1)}
    assert {(r.k, r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect()} <= batch
