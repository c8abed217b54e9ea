"""Shell scripts: functions, calls between them, and sourced files."""

from __future__ import annotations

import re

from sparkloom.sources.names import Parsed, qualified, sha1, slashed_module

FUNCTION = re.compile(r"^[ \t]*(?:function[ \t]+([A-Za-z_][\w-]*)[ \t]*(?:\(\))?|([A-Za-z_][\w-]*)[ \t]*\(\))[ \t\r\n]*(?=\{)", re.M)
SOURCED = re.compile(r"^[ \t]*(?:source|\.)[ \t]+[\"']?([^\s\"';]+)", re.M)


def hide(text: str) -> str:
    """The text with comments and quoted parts blanked, places kept."""
    out, i, quote = list(text), 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote == '"':
                out[i : i + 2] = "  "[: len(text) - i]
                i += 2
                continue
            if c == quote:
                quote = ""
            elif c != "\n":
                out[i] = " "
        elif c == "\\":
            i += 2
            continue
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t\n;({"):
            while i < len(text) and text[i] != "\n":
                out[i] = " "
                i += 1
            continue
        i += 1
    return "".join(out)


def closing(code: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``; -1 if there is none."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] == "{":
            depth += 1
        elif code[i] == "}":
            depth -= 1
            if not depth:
                return i
    return -1


def _comments_above(lines: list[str], at: int) -> str | None:
    """Comment lines right above line ``at`` (from 0)."""
    kept = []
    while at > 0 and lines[at - 1].strip().startswith("#") and not lines[at - 1].startswith("#!"):
        at -= 1
        kept.insert(0, lines[at].strip().lstrip("#").strip())
    return "\n".join(kept).strip() or None


def parse(rel: str, text: str) -> Parsed:
    out, module, code, lines = Parsed(), slashed_module(rel), hide(text), text.split("\n")
    top = []
    for line in lines[1:] if text.startswith("#!") else lines:
        if not line.strip().startswith("#"):
            if line.strip() or top:
                break
            continue
        top.append(line.strip().lstrip("#").strip())
    whole = qualified(module)
    out.symbol(whole, "module", f"shell script {module}", "\n".join(top).strip() or None, 1, max(1, text.count("\n") + (not text.endswith("\n"))), sha=sha1(text))
    found = []
    for m in FUNCTION.finditer(code):
        opening = code.index("{", m.end())
        if (end := closing(code, opening)) >= 0:
            found.append((m[1] or m[2], m.start() + len(m[0]) - len(m[0].lstrip()), opening, end))
    names = {f[0] for f in found}
    for name, begin, opening, end in found:
        first, body = code.count("\n", 0, begin) + 1, code[opening + 1 : end]
        qname = qualified(module, [name])
        out.symbol(qname, "function", f"{name}()", _comments_above(lines, first - 1), first, code.count("\n", 0, end) + 1, whole, sha=sha1(text[opening + 1 : end]))
        start_line = code.count("\n", 0, opening) + 1
        for c in re.finditer(r"(?:^|[\n;&|()`])[ \t]*([^\W\d][\w-]*)(?![\w-])", body):
            if c[1] in names and c[1] != name:
                out.calls.append((qname, c[1], qualified(module, [c[1]]), start_line + body.count("\n", 0, c.start(1))))
    for m in SOURCED.finditer(text):
        path = m[1].lstrip("./")
        out.imports.append((re.sub(r"\.(sh|bash)$", "", path), None, None, text.count("\n", 0, m.start()) + 1))
    return out
