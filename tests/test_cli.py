"""The command line over the shared session."""

from __future__ import annotations

import json

import pytest

from sparkloom import cli


@pytest.fixture
def run(spark, tree, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)

    def call(*args: str) -> tuple[int, dict | str]:
        code = cli.main([*args, "--root", str(tree)])
        text = capsys.readouterr().out
        try:
            return code, json.loads(text)
        except ValueError:
            return code, text

    return call


def test_commands(run, tree):
    assert run("index")[1]["updated"] == 8
    assert run("search", "hash_token", "--mode", "lexical")[1]["results"][0]["qname"] == "pkg.utils:hash_token"
    assert run("source", "pkg.utils:hash_token")[1]["source"].startswith("def hash_token")
    assert run("expand", "pkg.auth:Session.refresh")[1]["layers"]
    assert run("outline", "pkg/utils.py")[1]["symbols"]
    assert run("find", "FALLBACK_TTL")[1]["match_count"] == 2
    assert run("grep", "Hash a", "--in-path", "pkg")[1]["match_count"] == 1
    assert run("routes", "--path", "login/")[1]["routes"][0]["handler_qname"] == "web.views:login_view"
    assert "auth.py" in run("skeleton")[1] and run("map")[1]["file_count"]
    assert run("roots")[1]["roots"] == [str(tree)]
    assert run("import-add", "pkg/utils.py", "import os")[1]["changed"]
    code, out = run("edit", "pkg.utils:nope", "--body", "x")
    assert code == 1 and out["error"] == "not_found"
    with pytest.raises(SystemExit):
        run("edit", "pkg.utils:hash_token")
    assert run("edit-batch", "--body", json.dumps([{"qname": "pkg.utils:hash_token", "new_body": "def hash_token(t):\n    return 1"}]))[1]["applied"]


def test_packages(run, tree):
    for name, text in {"alpha/core.py": "from beta.tools import helper\n\ndef work():\n    return helper()\n", "beta/tools.py": "def helper():\n    return 1\n"}.items():
        path = tree / ".venv/lib/python3.13/site-packages" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert run("vendor", "index", "beta")[1]["updated"] == 1
    layers = run("expand", "core:work", "--pkg", "alpha")[1]["layers"]
    assert layers[0][0]["qname"] == "beta::tools:helper" and layers[0][0]["package"] == "beta"
    assert run("vendor", "list")[1]["packages"] == ["alpha", "beta"]
    assert run("vendor", "forget", "beta")[1]["forgotten"] is True
