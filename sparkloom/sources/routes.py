"""Routes that sources declare: Django URL tables and Next.js route files."""

from __future__ import annotations

import ast
import re

from sparkloom.sources.names import dotted_module, qualified, slashed_module

# HTTP methods that a Next.js route file exports.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
CALLS = frozenset(("path", "re_path", "url"))


def _imports(tree: ast.Module, module: str) -> dict[str, str]:
    """Local name -> dotted origin, relative levels worked out."""
    known = {}
    package = module.split(".")[:-1]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                known[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = package[: len(package) - node.level + 1] if node.level else []
            origin = ".".join([*base, *(node.module.split(".") if node.module else [])])
            for a in node.names:
                known[a.asname or a.name] = f"{origin}.{a.name}" if origin else a.name
    return known


def _dotted(node: ast.AST) -> list[str]:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    return [node.id, *parts] if isinstance(node, ast.Name) else []


def _handler(node: ast.AST, known: dict[str, str], module: str) -> str | None:
    while isinstance(node, ast.Call):  # View.as_view(), decorator(view)
        if isinstance(node.func, ast.Attribute) and node.func.attr == "as_view":
            node = node.func.value
        else:
            node = node.args[0] if node.args else node.func
            if not isinstance(node, ast.Name | ast.Attribute | ast.Call):
                return None
    parts = _dotted(node)
    if not parts:
        return None
    if parts[0] not in known:
        return qualified(module, parts)
    whole = [*known[parts[0]].split("."), *parts[1:]]
    return qualified(".".join(whole[:-1]), whole[-1:]) if len(whole) > 1 else qualified(whole[0])


def django(rel: str, text: str) -> list[tuple]:
    """(method, path, handler, line, framework) of the first ``urlpatterns`` list."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    module = dotted_module(rel)
    known, found = _imports(tree, module), []
    for node in tree.body:
        value = node.value if isinstance(node, ast.Assign | ast.AnnAssign) else None
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if not any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in targets) or not isinstance(value, ast.List):
            continue
        for item in value.elts:
            if not isinstance(item, ast.Call) or (_dotted(item.func) or [""])[-1] not in CALLS or len(item.args) < 2:
                continue
            path, view = item.args[0], item.args[1]
            if not isinstance(path, ast.Constant) or not isinstance(path.value, str):
                continue
            if isinstance(view, ast.Call) and (_dotted(view.func) or [""])[-1] == "include":
                target = view.args[0] if view.args else None
                name = target.value if isinstance(target, ast.Constant) else ast.unparse(target) if target is not None else ""
                found.append(("ANY", path.value, None, item.lineno, f"django:include={name}"))
            else:
                found.append(("ANY", path.value, _handler(view, known, module), item.lineno, "django"))
        break
    return found


def nextjs(rel: str, text: str) -> list[tuple]:
    """One row for each HTTP method that a route file exports."""
    parts = rel.split("/")
    url, found = "/" + "/".join(parts[1:-1]), []
    for m in re.finditer(r"^export\s+(?:async\s+)?(?:function\s+([A-Z]+)|const\s+([A-Z]+)\s*=)", text, re.M):
        verb = m[1] or m[2]
        if verb in METHODS:
            found.append((verb, url, qualified(slashed_module(rel), [verb]), text.count("\n", 0, m.start()) + 1, "nextjs"))
    return found


def routes_of(rel: str, text: str) -> list[tuple]:
    name = rel.rpartition("/")[2]
    if name == "urls.py":
        return django(rel, text)
    if name.startswith("route.") and rel.startswith("app/"):
        return nextjs(rel, text)
    return []
