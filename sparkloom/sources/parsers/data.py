"""TOML, JSON, YAML and .env files: their tables and keys."""

from __future__ import annotations

import json
import re
import tomllib

from sparkloom.sources.names import Parsed, qualified, sha1


def _leading_comments(lines: list[str]) -> str | None:
    kept = []
    for line in lines:
        if line.strip().startswith("#"):
            kept.append(line.strip().lstrip("#").strip())
        elif line.strip() or kept:
            break
    return " ".join(kept) if kept else None


def _start(rel: str, text: str, kind: str, doc: str | None) -> tuple[Parsed, list[str]]:
    out, lines = Parsed(), text.splitlines()
    out.symbol(qualified(rel), "module", f"{kind} {rel}", doc, 1, max(1, len(lines)), sha=sha1(text))
    return out, lines


def _key(out: Parsed, rel: str, path: list[str], signature: str, line: int, parent: str) -> None:
    out.symbol(qualified(rel, path), "constant", signature, path[-1], line, line, parent)


def parse_toml(rel: str, text: str) -> Parsed:
    out, lines = _start(rel, text, "toml", _leading_comments(text.splitlines()))
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return out
    heads = [(i, [p.strip() for p in m[1].split(".")]) for i, line in enumerate(lines, 1) if (m := re.match(r"^\s*\[\[?([^\]]+)\]\]?\s*(?:#.*)?$", line))]
    for k, (at, path) in enumerate(heads):
        end = heads[k + 1][0] - 1 if k + 1 < len(heads) else max(1, len(lines))
        out.symbol(qualified(rel, path), "class", f"[{'.'.join(path)}]", ".".join(path), at, end, qualified(rel))
    for i, line in enumerate(lines, 1):
        if m := re.match(r"^\s*([A-Za-z_][\w\-.]*)\s*=", line):
            table = next((path for at, path in reversed(heads) if at <= i), [])
            _key(out, rel, [*table, m[1]], line.strip(), i, qualified(rel, table))
    return out


def parse_json(rel: str, text: str) -> Parsed:
    out, lines = _start(rel, text, "json", None)
    try:
        whole = json.loads(text)
    except ValueError:
        return out
    depth = 0
    for i, line in enumerate(lines if isinstance(whole, dict) else (), 1):
        if depth == 1 and (m := re.match(r'^\s*"([^"\\]+)"\s*:', line)):
            _key(out, rel, [m[1]], line.strip().rstrip(","), i, qualified(rel))
        depth = max(0, depth + line.count("{") - line.count("}"))
    return out


def _flat(rel: str, text: str, kind: str, rule: str) -> Parsed:
    out, lines = _start(rel, text, kind, _leading_comments(text.splitlines()))
    for i, line in enumerate(lines, 1):
        if not line.lstrip().startswith("#") and (m := re.match(rule, line)):
            _key(out, rel, [m[1]], line.rstrip(), i, qualified(rel))
    return out


def parse_yaml(rel: str, text: str) -> Parsed:
    return _flat(rel, text, "yaml", r"^([A-Za-z_][\w\-]*)\s*:(?:\s|$)")


def parse_env(rel: str, text: str) -> Parsed:
    return _flat(rel, text, "env", r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=")
