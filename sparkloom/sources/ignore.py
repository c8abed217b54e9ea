"""Ignore rules in the pattern language of .gitignore files."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

MOST_LEVELS = 20


@lru_cache(4096)
def pattern_regex(pattern: str) -> tuple[re.Pattern, bool] | None:
    """(regex over a relative path, negated) of one line; None for blanks and comments."""
    line = pattern.rstrip("\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    if not line:
        return None
    return re.compile(("" if anchored else "(?:.*/)?") + out + ("/.+" if folder else "(?:/.*)?")), negated


def ignored(rel: str, patterns: tuple[str, ...]) -> bool:
    """Whether the last pattern that matches the path ignores it."""
    state = False
    for pattern in patterns:
        rule = pattern_regex(pattern)
        if rule and rule[0].fullmatch(rel):
            state = not rule[1]
    return state


def load_rules(root: str | Path) -> list[tuple[str, tuple[str, ...]]]:
    """(folder, lines) of the .gitignore files from ``root`` up to the folder with .git."""
    found, at = [], Path(root).resolve()
    for _ in range(MOST_LEVELS):
        if (at / ".gitignore").is_file():
            found.append((str(at), tuple((at / ".gitignore").read_text(errors="replace").splitlines())))
        if (at / ".git").exists() or at.parent == at:
            break
        at = at.parent
    return found


def ignored_by(path: str, rules: list[tuple[str, tuple[str, ...]]]) -> bool:
    """Whether any of the files' rules ignores the absolute path."""
    return any(path.startswith(folder.rstrip("/") + "/") and ignored(path[len(folder.rstrip("/")) + 1 :], lines) for folder, lines in rules)
