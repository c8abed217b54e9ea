"""The engine end to end on a small tree: index, read, write."""

from __future__ import annotations

import json

import pytest

from sparkloom.plans import index as ix
from sparkloom.plans import multi, read, write


@pytest.fixture
def indexed(spark, tree):
    ix.refresh(spark, tree)
    return tree


def test_incremental_refresh(spark, tree):
    first = ix.refresh(spark, tree)
    assert first["updated"] == 8 and first["removed"] == 0 and first["version"] == 1
    assert ix.refresh(spark, tree) == {"updated": 0, "skipped": 8, "removed": 0, "symbols": first["symbols"], "calls": first["calls"], "version": 1}
    (tree / "pkg/utils.py").write_text("def other():\n    return 2\n")
    (tree / "web/views.py").unlink()
    seen = []
    again = ix.refresh(spark, tree, progress=lambda *a: seen.append(a) or 1 / 0)
    assert (again["updated"], again["skipped"], again["removed"]) == (1, 6, 1) and len(seen) == 8
    index = ix.Index(spark, tree)
    names = {r.qname for r in index.symbols.select("qname").collect()}
    assert "pkg.utils:other" in names and "pkg.utils:hash_token" not in names
    assert {r.qname for r in index.vectors.collect()} == names
    call = index.calls.where("callee_name = 'hash_token'").first()
    assert call.callee_qname is None  # the target went: demoted
    assert not [r for r in index.routes.collect() if r.defined_in.endswith("views.py")]


def test_resolution_and_expand(spark, indexed):
    calls = {(r.caller_qname, r.callee_name): r.callee_qname for r in ix.Index(spark, indexed).calls.collect()}
    assert calls["pkg.auth:Session.refresh", "self.check"] == "pkg.auth:Session.check"
    assert calls["pkg.auth:Session.refresh", "hash_token"] == "pkg.utils:hash_token"
    assert calls["pkg.auth:login", "Session"] == "pkg.auth:Session"
    out = read.expand(spark, "pkg.auth:Session.refresh", "callees", 2, indexed)
    assert {n["qname"] for n in out["layers"][0]} == {"pkg.auth:Session.check", "pkg.utils:hash_token", "?:str"}
    up = read.expand(spark, "pkg/utils.py:hash_token", "callers", 1, indexed)
    assert up["qname"] == "pkg.utils:hash_token" and up["hint"]
    assert [n["qname"] for n in up["layers"][0]] == ["pkg.auth:Session.refresh"]
    assert read.expand(spark, "pkg.nope:x", root=indexed)["error"] == "not_found"


def test_search_and_context(spark, indexed):
    lex = read.search_code(spark, "hash_token", root=indexed, mode="lexical")
    assert lex["results"][0]["qname"] == "pkg.utils:hash_token"
    assert read.search_code(spark, "!!!", root=indexed, mode="lexical")["results"] == []
    found = read.search_code(spark, "hash token", root=indexed, with_bodies=True)
    assert found["results"][0]["qname"] == "pkg.utils:hash_token" and "return len(token)" in found["results"][0]["source"]
    dropped = read.search_code(spark, "login", kind="interface", root=indexed)
    assert dropped["kind_filter_dropped"] and dropped["results"]
    pack = read.context(spark, "pkg.auth:Session.refresh", root=indexed)
    assert pack["mode"] == "exact" and len(pack["seeds"]) == 1
    assert {c["qname"] for c in pack["seeds"][0]["callees"]} == {"pkg.auth:Session.check", "pkg.utils:hash_token"}
    audit = read.context(spark, "find all transaction.atomic sites", root=indexed)
    assert audit["find_results"]["match_count"] == 1
    const = read.get_source(spark, "pkg.auth:DEFAULT_TTL", root=indexed)
    assert const["resolved_value"] == {"chain": ["pkg.utils:FALLBACK_TTL"], "terminal_qname": "pkg.utils:FALLBACK_TTL", "value": "60"}


def test_find_grep_outline_map(spark, indexed):
    hit = read.find_literal(spark, "DEFAULT_TTL", indexed, with_callers=True)
    assert [(m["qname"], m["match_line"]) for m in hit["matches"]] == [("pkg.auth:DEFAULT_TTL", 4), ("pkg.auth:Session.check", 18)]
    assert hit["matches"][1]["callers"] == [{"qname": "pkg.auth:Session.refresh", "line": 14}]
    rows = read.grep_files(spark, "hash_token", indexed)["matches"]
    assert rows[0]["is_definition"] and rows[0]["file"].endswith("utils.py") and len(rows) == 3
    assert read.grep_files(spark, "(", indexed, regex=True)["error"] == "invalid_regex"
    assert read.grep_files(spark, "x", indexed, scope="y")["error"] == "scope_unsupported"
    tree = read.outline(spark, "pkg/auth.py", indexed)["symbols"]
    session = next(s for s in tree if s["qname"] == "pkg.auth:Session")
    assert [c["qname"].rpartition(".")[2] for c in session["children"]] == ["LIMIT", "refresh", "check"]
    below = read.outline(spark, "pkg", indexed, max_files=1)
    assert below["truncated"] and below["total_files"] == 2
    whole = read.map_repo(spark, indexed, depth=2)
    assert {d["dir"] for d in whole["directories"]} >= {"pkg", "web", "docs"}
    assert "Session" in read.session_skeleton(spark, [indexed]) and "not indexed" in read.session_skeleton(spark, [indexed / "web"])
    with pytest.raises(ValueError):
        read.map_repo(spark, indexed, depth=3)


def test_routes(spark, indexed):
    rows = {(r["method"], r["path"]): r["handler_qname"] for r in read.list_routes(spark, indexed)["routes"]}
    assert rows == {("ANY", "login/"): "web.views:login_view", ("ANY", "api/"): None, ("GET", "/api/items"): "app/api/items/route:GET", ("POST", "/api/items"): "app/api/items/route:POST"}
    assert read.lookup_route(spark, "login/", indexed)["routes"][0]["framework"] == "django"


def test_edits(spark, indexed):
    out = write.edit_symbol(spark, "pkg.utils:hash_token", "def hash_token(token):\n    return 7\n", indexed)
    assert out["lines_replaced"] == "5-7" and (indexed / "pkg/utils.py").read_text().endswith("    return 7\n")
    assert write.edit_symbol(spark, "pkg.utils:hash_token", "def broken(:\n", indexed)["error"] == "syntax_error"
    with pytest.raises(ValueError):
        write.edit_symbol(spark, "pkg.utils:", "x", indexed)
    assert write.edit_symbol_search_replace(spark, "pkg.utils:hash_token", "7", "8", indexed)["chars_replaced"] == 1
    assert write.edit_symbol_search_replace(spark, "pkg.utils:hash_token", "zzz", "8", indexed)["error"] == "not_found"
    assert write.edit_symbol_search_replace(spark, "pkg.utils:hash_token", "token", "t", indexed)["error"] == "ambiguous"
    batch = write.edit_symbol_batch(spark, [{"qname": "pkg.auth:Session", "new_body": "class Session:\n    pass"}, {"qname": "pkg.auth:Session.check", "new_body": "    x = 1"}, {"qname": "pkg.utils:hash_token", "new_body": "def hash_token(t):\n    return 9"}, {"bad": 1}], indexed)
    assert {e["error"] for e in batch["errors"]} == {"overlapping_edits", "invalid_edit"}
    assert [a["qname"] for a in batch["applied"]] == ["pkg.utils:hash_token"]
    put = write.insert_symbol(spark, "pkg.utils:hash_token", "def more():\n    return 1", indexed)
    assert put["lines_inserted"] == 2 and "return 9\n\n\ndef more" in (indexed / "pkg/utils.py").read_text()
    gone = write.delete_symbol(spark, "pkg.utils:more", indexed)
    assert "def more" not in (indexed / "pkg/utils.py").read_text() and gone["file"].endswith("utils.py")


def test_imports_rename_files(spark, indexed):
    write.add_import(spark, "pkg/auth.py", "import os", indexed)
    assert write.add_import(spark, "pkg/auth.py", "import os", indexed)["changed"] is False
    assert (indexed / "pkg/auth.py").read_text().split("\n")[1:3] == ["from pkg.utils import hash_token", "import os"]
    write.remove_import(spark, "pkg/auth.py", "import os", indexed)
    out = write.rename_symbol(spark, "pkg.utils:hash_token", "digest", indexed)
    assert out["new_qname"] == "pkg.utils:digest" and len(out["files"]) == 2
    assert "from pkg.utils import digest" in (indexed / "pkg/auth.py").read_text() and "digest(str(seconds))" in (indexed / "pkg/auth.py").read_text()
    assert write.rename_symbol(spark, "pkg.utils:digest", "1x", indexed)["error"] == "invalid_new_name"
    assert write.create_file(spark, "../x.py", "", indexed)["error"] == "outside_root"
    assert write.create_file(spark, "pkg/new.py", "A = 1\n", indexed)["created"]
    moved = write.move_file(spark, "pkg/utils.py", "pkg/tools.py", indexed)
    assert [f.rpartition("/")[2] for f in moved["importing_files"]] == ["auth.py"]
    assert write.delete_file(spark, "pkg/new.py", indexed)["symbols_removed"] == 2


def test_preloads(spark, indexed):
    held = ix.Preloads(spark, indexed)
    held.put("map", "text")
    assert held.get("map") == "text"
    (indexed / "pkg/utils.py").write_text("Z = 1\n")
    assert held.get("map") is None and held.clear() == 1


def test_many_roots(spark, tree):
    ix.refresh(spark, tree / "pkg")
    ix.refresh(spark, tree / "web")
    roots = [tree / "pkg", tree / "web"]
    hits = multi.search_code_multi(spark, "login", roots, anchor=tree)
    assert {h["root"] for h in hits["results"]} <= {"pkg", "web"} and not hits["errors"]
    assert multi.by_name(spark, read.get_source, "views:login_view", roots, anchor=tree)["root"] == "web"
    assert multi.by_name(spark, read.get_source, "views:nope", roots)["error"] == "not_found"
    assert multi.map_repo_multi(spark, roots)["file_count"] == sum(s["file_count"] for s in multi.map_repo_multi(spark, roots)["sections"])
    json.dumps(hits)
