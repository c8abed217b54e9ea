"""Names of modules and symbols, and the records that parsers give."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

VERSION = 2

FILES = "root string, scope string, file string, rel string, sha string, language string, indexed_at double, content string"
SYMBOLS = "root string, scope string, file string, qname string, kind string, language string, signature string, docstring string, line_start int, line_end int, parent_qname string, decorators array<string>, bases array<string>, source_sha string"
CALLS = "root string, scope string, file string, call_id long, caller_qname string, callee_name string, callee_qname string, line int"
IMPORTS = "root string, scope string, file string, import_id long, module string, name string, alias string, line int"
ROUTES = "root string, scope string, method string, path string, handler_qname string, defined_in string, line int, framework string"
VECTORS = "root string, scope string, qname string, vector array<float>"
PRELOADS = "root string, mode string, content string, source_version string, generated_at long"


@dataclass
class Parsed:
    """What a file holds; symbols are (qname, kind, signature, docstring, start, end,
    parent, decorators, bases, sha), calls (caller, name, target, line), imports
    (module, name, alias, line)."""

    symbols: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)

    def symbol(self, qname: str, kind: str, signature: str, doc: str | None, start: int, end: int, parent: str | None = None, decorators: list[str] | None = None, bases: list[str] | None = None, sha: str = "") -> None:
        self.symbols.append((qname, kind, signature, doc, start, end, parent, decorators or [], bases or [], sha))


def sha1(text: str | bytes) -> str:
    return hashlib.sha1(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest()


def _stem(rel: str, collapse: str) -> list[str]:
    parts = rel.split("/")
    name = parts.pop()
    stem = name[: name.rindex(".")] if "." in name[1:] else name
    return parts if stem == collapse else [*parts, stem]


def dotted_module(rel: str) -> str:
    """a/b/c.py -> a.b.c; a package's __init__ is the package."""
    return ".".join(_stem(rel, "__init__"))


def slashed_module(rel: str) -> str:
    """a/b/c.ts -> a/b/c; a folder's index is the folder."""
    return "/".join(_stem(rel, "index"))


def qualified(module: str, members: list[str] | tuple[str, ...] = ()) -> str:
    """module:member.path; the module itself has no members."""
    return f"{module}:{'.'.join(members)}"


def require_member(qname: object) -> None:
    """Refuse names that a write could take for a whole module."""
    if not isinstance(qname, str):
        raise TypeError(f"a qualified name is a string, not {type(qname).__name__}")
    module, colon, member = qname.partition(":")
    if not colon or not module.strip() or not member.strip():
        raise ValueError(f"{qname!r} does not name a member: module:Symbol is needed")
