"""Command line: one command per operation, JSON out (indented on a terminal)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from sparkloom.plans import index as ix
from sparkloom.plans import multi, read, write
from sparkloom.session import session
from sparkloom.sources import scan


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, scope: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for names, options in args:
            p.add_argument(*names.split(), **options)
        p.add_argument("--root", default=".")
        if scope:
            p.add_argument("--pkg", dest="scope")
        return p

    text, flag = {}, {"action": "store_true"}
    number = lambda n: {"type": int, "default": n}
    search = (("--k", number(5)), ("--kind", text), ("--mode", {"choices": ["lexical", "vector", "hybrid"], "default": "hybrid"}))
    command("search", ("query", text), *search, ("--with-bodies", flag), ("--also", {"action": "append"}), scope=True)
    command("context", ("query", text), *search, scope=True)
    command("expand", ("qname", text), ("--direction", {"choices": ["callees", "callers", "both"], "default": "callees"}), ("--depth", number(1)), scope=True)
    command("outline", ("path", text), ("--with-bodies", flag), scope=True)
    command("source", ("qname", text), ("--with-neighbors", flag), scope=True)
    command("find", ("literal", text), ("--in-path", text), ("--kind", text), ("--with-bodies", flag), ("--with-callers", flag), scope=True)
    command("grep", ("pattern", text), ("--regex", flag), ("--in-path", text), ("-i --case-insensitive", flag), ("--context-lines", number(1)))
    command("map", ("--depth", number(1)), ("--prefix", text), ("--mode", {"default": "lean"}), scope=True)
    command("skeleton", ("--max-chars", number(8000)), ("--render", {"default": "compact"}))
    command("routes", ("--path", text))
    command("index", ("--force", flag))
    command("vendor", ("action", {"choices": ["list", "index", "forget"]}), ("package", {"nargs": "?"}))
    command("roots")
    body = (("--body", text), ("--body-file", text), ("--stdin", flag))
    command("edit", ("qname", text), *body)
    command("insert", ("qname", text), *body, ("--position", {"choices": ["before", "after"], "default": "after"}))
    command("delete", ("qname", text))
    command("edit-sr", ("qname", text), ("search", text), ("replace", text))
    command("edit-batch", *body)
    command("edit-sr-batch", *body)
    command("import-add", ("file", text), ("statement", text))
    command("import-remove", ("file", text), ("statement", text))
    command("create-file", ("file", text), *body)
    command("delete-file", ("file", text))
    command("move-file", ("src", text), ("dst", text))
    command("watch", ("--seconds", {"type": float, "default": 0.5}))
    return top


def given(args: argparse.Namespace) -> str:
    """The text of exactly one of --body, --body-file and --stdin."""
    ways = [args.body is not None, args.body_file is not None, args.stdin]
    if sum(ways) != 1:
        raise SystemExit("exactly one of --body, --body-file and --stdin is needed")
    return args.body if args.body is not None else Path(args.body_file).read_text() if args.body_file else sys.stdin.read()


def run(args: argparse.Namespace) -> dict | str:
    roots = scan.discover_roots(args.root) or [Path(args.root).resolve()]
    if args.command == "roots":
        return {"roots": [str(r) for r in roots], "subprojects": [str(p) for p in scan.subprojects(args.root)]}
    if args.command == "vendor" and args.action != "index":
        return {"packages": ix.indexed_packages(roots[0])} if args.action == "list" else {"forgotten": ix.forget_package(roots[0], args.package)}
    scope, query = getattr(args, "scope", None), getattr(args, "query", None)
    if query and not scope:
        scope, query = scan.query_scope(query, scan.discover_packages(roots[0]))
    if scope and len(roots) > 1:
        raise SystemExit("a package needs one root: give --root")
    spark = session()
    if scope and scope not in ix.indexed_packages(roots[0]):
        ix.refresh_package(spark, roots[0], scope)
    if args.command == "vendor":
        return ix.refresh_package(spark, roots[0], args.package)
    if not scope:
        for root in roots:
            counts = ix.refresh(spark, root, force=getattr(args, "force", False))
        if args.command == "index":
            return counts
    one = len(roots) == 1
    root = roots[0]
    match args.command:
        case "search":
            options = {"kind": args.kind, "mode": args.mode, "with_bodies": args.with_bodies, "also": args.also}
            return read.search_code(spark, query, args.k, root=root, scope=scope, **options) if one else multi.search_code_multi(spark, query, roots, args.k, **options)
        case "context":
            options = {"kind": args.kind, "mode": args.mode, "k_seeds": args.k}
            return read.context(spark, query, root=root, scope=scope, **options) if one else multi.context_multi(spark, query, roots, **options)
        case "expand":
            return read.expand(spark, args.qname, args.direction, args.depth, root, scope) if one else multi.by_name(spark, read.expand, args.qname, roots, args.direction, args.depth)
        case "outline":
            return read.outline(spark, args.path, root, scope, with_bodies=args.with_bodies) if one else multi.by_path(spark, read.outline, args.path, roots, with_bodies=args.with_bodies)
        case "source":
            return read.get_source(spark, args.qname, args.with_neighbors, root, scope) if one else multi.by_name(spark, read.get_source, args.qname, roots, args.with_neighbors)
        case "find":
            options = {"in_path": args.in_path, "kind": args.kind, "with_bodies": args.with_bodies, "with_callers": args.with_callers}
            return read.find_literal(spark, args.literal, root, scope, **options) if one else multi.find_literal_multi(spark, args.literal, roots, **options)
        case "grep":
            options = {"regex": args.regex, "in_path": args.in_path, "case_insensitive": args.case_insensitive, "context_lines": args.context_lines}
            return read.grep_files(spark, args.pattern, root, **options) if one else multi.grep_files_multi(spark, args.pattern, roots, **options)
        case "map":
            options = {"depth": args.depth, "prefix": args.prefix, "mode": args.mode}
            return read.map_repo(spark, root, scope, **options) if one else multi.map_repo_multi(spark, roots, **options)
        case "skeleton":
            return read.session_skeleton(spark, roots, args.render, args.max_chars)
        case "routes":
            return read.lookup_route(spark, args.path, root) if args.path else read.list_routes(spark, root)
        case "edit":
            return multi.by_name(spark, write.edit_symbol, args.qname, roots, given(args)) if not one else write.edit_symbol(spark, args.qname, given(args), root)
        case "insert":
            return multi.by_name(spark, write.insert_symbol, args.qname, roots, given(args), position=args.position) if not one else write.insert_symbol(spark, args.qname, given(args), root, args.position)
        case "delete":
            return multi.by_name(spark, write.delete_symbol, args.qname, roots) if not one else write.delete_symbol(spark, args.qname, root)
        case "edit-sr":
            return write.edit_symbol_search_replace(spark, args.qname, args.search, args.replace, root)
        case "edit-batch":
            return write.edit_symbol_batch(spark, json.loads(given(args)), root)
        case "edit-sr-batch":
            return write.edit_symbol_search_replace_batch(spark, json.loads(given(args)), root)
        case "import-add":
            return write.add_import(spark, args.file, args.statement, root)
        case "import-remove":
            return write.remove_import(spark, args.file, args.statement, root)
        case "create-file":
            return write.create_file(spark, args.file, given(args), root)
        case "delete-file":
            return write.delete_file(spark, args.file, root)
        case "move-file":
            return write.move_file(spark, args.src, args.dst, root)
        case "watch":
            from sparkloom.streaming.refresh import watch_root

            watch_root(spark, root, args.seconds)
            return {"watched": str(root)}
    raise SystemExit(f"unknown command {args.command}")


def main(argv: list[str] | None = None) -> int:
    out = run(parser().parse_args(argv))
    print(out if isinstance(out, str) else json.dumps(out, indent=2 if sys.stdout.isatty() else None, default=str))
    return int(isinstance(out, dict) and "error" in out)


if __name__ == "__main__":
    sys.exit(main())
