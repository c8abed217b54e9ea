"""TypeScript and JavaScript by a scanner: no grammar file is needed.

Comments, strings and templates are blanked first, so braces can be matched and
declarations read at statement starts of each scope. Decorators, overloads and
object-literal methods give no symbols of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from sparkloom.sources.names import Parsed, qualified, sha1, slashed_module

NAME = r"[A-Za-z_$][\w$]*"
LONGEST = 240
FACTORIES = ("cva", "tv")
KEYWORDS = frozenset("if for while switch catch return function new typeof instanceof in of await yield delete void throw else do case super this import export class extends const let var async get set static constructor".split())
STATEMENT = re.compile(
    rf"(?P<lead>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?)(?:(?P<fn>(?:async\s+)?function\b\s*\*?\s*(?P<fname>{NAME})?)|(?P<cls>class\b\s*(?P<cname>(?!extends\b|implements\b){NAME})?)|(?P<simple>(?:const\s+)?(?P<kind>interface|type|enum)\s+(?P<sname>{NAME}))|(?P<var>(?:const|let|var)\s+(?P<vname>{NAME})))"
)
IMPORT = re.compile(rf"^[ \t]*import\s+(?P<what>[^;'\"]*?)\s*from\s*(?P<q>['\"])(?P<module>[^'\"\n]+)(?P=q)", re.M)
MEMBER = re.compile(rf"(?P<mods>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|declare)\s+)*)\*?\s*(?P<name>#?{NAME}|constructor)\s*[?!]?\s*(?P<what>[<(]|[:=;])")
CALL = re.compile(rf"(?<![\w$.])(?P<new>new\s+)?(?P<name>(?:this|super|{NAME})(?:\s*\??\.\s*{NAME})*)\s*(?:<[\w\s,.\[\]|]*>)?\(")
TAG = re.compile(r"<([A-Z][\w$]*(?:\.[\w$]+)*)(?=[\s/>])")


def blank(text: str) -> str:
    """The text with comments, strings and regexes blanked; places and line ends stay.
    Code inside ${} of a template is kept."""
    out, i, n = list(text), 0, len(text)
    templates: list[int] = []  # brace depth at which each open ${} ends
    depth = 0

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def template(a: int) -> int:
        """Blank from inside a template to its end, or to the code of a ${."""
        k = a
        while k < n:
            if text[k] == "\\":
                k += 2
            elif text[k] == "`":
                wipe(a, k)
                return k + 1
            elif text.startswith("${", k):
                wipe(a, k + 1)
                templates.append(depth)
                return k + 1
            else:
                k += 1
        wipe(a, n)
        return n

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            wipe(i, j)
            i = j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            wipe(i, j)
            i = j
        elif c in "'\"":
            j = i + 1
            while j < n and text[j] not in (c, "\n"):
                j += 2 if text[j] == "\\" else 1
            wipe(i + 1, j)
            i = j + 1
        elif c == "`":
            i = template(i + 1)
        elif c == "/" and (m := re.match(r"/(?![*/\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", text[i:])) and re.search(r"(?:^|[=(,:;!&|?{}\[\n]|\breturn)\s*$", "".join(out[max(0, i - 40) : i])):
            wipe(i + 1, i + len(m[0]) - 1)
            i += len(m[0])
        else:
            if c == "{":
                depth += 1
            elif c == "}":
                if templates and depth == templates[-1] + 1:
                    depth -= 1
                    templates.pop()
                    i = template(i + 1)
                    continue
                depth -= 1
            i += 1
    return "".join(out)


PAIRS = {"(": ")", "[": "]", "{": "}"}


def match(code: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``, or the text's end."""
    stack = []
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{":
            stack.append(PAIRS[c])
        elif c in ")]}":
            while stack and stack[-1] != c:
                stack.pop()
            if stack:
                stack.pop()
            if not stack:
                return i
    return len(code) - 1


def problems(text: str) -> tuple[int, tuple[int, int] | None]:
    """Unbalanced brackets and strings: how many, and the first's (line, column)."""
    code, stack, bad = blank(text), [], []
    for i, c in enumerate(code):
        if c in "([{":
            stack.append((PAIRS[c], i))
        elif c in ")]}":
            if stack and stack[-1][0] == c:
                stack.pop()
            else:
                bad.append(i)
    bad = sorted(bad + [i for _, i in stack])
    return len(bad), (text.count("\n", 0, bad[0]) + 1, bad[0] - (text.rfind("\n", 0, bad[0]) + 1)) if bad else None


def introduced_problem(old: str, new: str) -> tuple[int, int] | None:
    """The first problem of ``new`` if it has more than ``old``."""
    return problems(new)[1] if problems(new)[0] > problems(old)[0] else None


def relative_module(module: str, origin: str) -> str:
    """The path that an import of a module names from the file's own."""
    if not module.startswith("."):
        return module
    parts = origin.split("/")[:-1]
    for part in module.split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in (".", ""):
            parts.append(part)
    path = re.sub(r"\.(tsx?|jsx?|mjs|cjs|mts|cts)$", "", "/".join(parts))
    return re.sub(r"/index$", "", path)


class _Scan:
    def __init__(self, rel: str, text: str):
        self.rel, self.text, self.code, self.module, self.out = rel, text, blank(text), slashed_module(rel), Parsed()
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.scopes: list[tuple[int, int, str, str]] = []  # (start, end, qname, class or function)
        self.brought: dict[str, tuple[str, str]] = {}
        self.tops: set[str] = set()
        self.bases: dict[str, list[str]] = {}

    def line(self, at: int) -> int:
        return bisect_right(self.line_starts, at)

    def doc(self, at: int) -> str | None:
        """The JSDoc comment that ends right before a declaration."""
        m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:@[\w$.]+(?:\([^()]*\))?\s*)*$", self.text[max(0, at - 4000) : at], re.S)
        return "\n".join(x for x in (re.sub(r"^\s*\*? ?", "", y).rstrip() for y in m[1].split("\n")) if x).strip() or None if m else None

    def add(self, members: list[str], kind: str, start: int, end: int, head_end: int, parent: str | None, bases: list[str] | None = None) -> str:
        qname = qualified(self.module, members)
        head = " ".join(self.text[start:head_end].split()).rstrip("{=; ").strip()
        head = re.sub(r"^export\s+(default\s+)?", "", head)
        signature = head if len(head) <= LONGEST else head[:LONGEST] + " …"
        self.out.symbol(qname, kind, signature, self.doc(start), self.line(start), self.line(end), parent, [], bases, sha1(self.text[start : end + 1]))
        return qname

    def run(self) -> Parsed:
        lines = self.text.count("\n") + (not self.text.endswith("\n"))
        if not self.text.strip():
            return self.out
        lead = re.match(r"\s*/\*\*((?:(?!\*/).)*)\*/", self.text, re.S)
        doc = "\n".join(x for x in (re.sub(r"^\s*\*? ?", "", y).rstrip() for y in lead[1].split("\n")) if x).strip() if lead else None
        self.out.symbol(qualified(self.module), "module", f"module {self.module}", doc or None, 1, max(1, lines), sha=sha1(self.text))
        self.imports()
        self.tops = {m[g] for m in STATEMENT.finditer(self.code) for g in ("fname", "cname", "sname", "vname") if m[g]}
        self.body(0, len(self.code), [])
        self.calls()
        return self.out

    def imports(self) -> None:
        for m in IMPORT.finditer(self.text):
            if not self.code[m.start() : m.end()].strip().startswith("import"):
                continue
            line, module, what = self.line(m.start() + len(m[0]) - len(m[0].lstrip())), m["module"], re.sub(r"^type\s+", "", m["what"].strip())
            named = re.search(r"\{(.*?)\}", what, re.S)
            rest = (what[: named.start()] + what[named.end() :] if named else what).strip().strip(",").strip()
            for part in (p.strip() for p in rest.split(",") if p.strip()):
                star = re.fullmatch(rf"\*\s*as\s+({NAME})", part)
                name, alias = ("*", star[1]) if star else ("default", part)
                self.out.imports.append((module, name, alias, line))
                self.brought[alias] = (module, name)
            for part in (p.strip() for p in (named[1] if named else "").split(",") if p.strip()):
                name, _, alias = re.sub(r"^type\s+", "", part).partition(" as ")
                self.out.imports.append((module, name.strip(), alias.strip() or None, line))
                self.brought[alias.strip() or name.strip()] = (module, name.strip())

    def statements(self, start: int, end: int):
        """Declarations that start at depth 0 of a span."""
        at = start
        while m := STATEMENT.search(self.code, at, end):
            before = self.code[start : m.start()]
            inside = _depth(before)
            fresh = not re.search(r"[\w$.]$", self.code[: m.start()][-1:])
            if inside or not fresh:
                at = m.end() if not inside else self._after(start, m.start(), end)
                continue
            done = yield m
            at = done if done else m.end()

    def _after(self, start: int, place: int, end: int) -> int:
        """Past the bracket of this span that holds ``place``."""
        stack = []
        for i in range(start, place):
            if self.code[i] in "([{":
                stack.append(i)
            elif self.code[i] in ")]}" and stack:
                stack.pop()
        return match(self.code, stack[0]) + 1 if stack else place + 1

    def body(self, start: int, end: int, members: list[str]) -> None:
        walk = self.statements(start, end)
        m = next(walk, None)
        while m is not None:
            try:
                m = walk.send(self.declare(m, end, members))
            except StopIteration:
                return

    def parent(self, members: list[str]) -> str | None:
        return qualified(self.module, members) if members else None

    def _block(self, at: int, end: int) -> tuple[int, int]:
        """The next body's braces after parameter lists and types; (-1, _) if there is none."""
        i = at
        while i < end:
            c = self.code[i]
            if c in "([":
                i = match(self.code, i)
            elif c == "{":
                # a brace inside a type, such as ": { a: string }", is followed by a body or more
                close = match(self.code, i)
                if re.search(r"[:|&<,]\s*$", self.code[at:i]):
                    i = close
                else:
                    return i, close
            elif c == ";" or c == "\n" and re.search(r"\)\s*(:\s*[^{=]+)?$", self.code[at:i]) and not re.match(r"\s*[{:]", self.code[i:end]):
                return -1, i
            i += 1
        return -1, end

    def declare(self, m: re.Match, end: int, members: list[str]) -> int | None:
        parent, start = self.parent(members), m.start()
        if m["fn"]:
            opening, close = self._block(m.end(), end)
            if opening < 0:
                return close + 1
            name = m["fname"] or "default"
            kind = "component" if self._component(name, opening, close) else "function"
            qname = self.add([*members, name], kind, start, close, opening, parent)
            self.scopes.append((opening, close, qname, "function"))
            self.body(opening + 1, close, [*members, name])
            return close + 1
        if m["cls"]:
            opening = self.code.find("{", m.end(), end)
            if opening < 0:
                return None
            close, name = match(self.code, opening), m["cname"] or "default"
            head = re.sub(r"<[^<>]*>", "", self.code[m.end() : opening])
            bases = [b.strip() for part in re.findall(r"\b(?:extends|implements)\s+((?:(?!\b(?:extends|implements)\b).)*)", head, re.S) for b in part.split(",") if b.strip()]
            qname = self.add([*members, name], "class", start, close, opening, parent, bases)
            self.bases[qname] = bases
            self.scopes.append((opening, close, qname, "class"))
            self.members(opening + 1, close, [*members, name], qname)
            return close + 1
        if m["simple"]:
            kind = m["kind"]
            if kind == "type":
                close = self._value_end(m.end(), end)
                head = close
            else:
                opening = self.code.find("{", m.end(), end)
                if opening < 0:
                    return None
                close, head = match(self.code, opening), opening
            bases = [b.strip() for b in re.sub(r"<[^<>]*>", "", self.code[m.end() : head]).partition("extends")[2].split(",") if b.strip()] if kind == "interface" else None
            self.add([*members, m["sname"]], "class" if kind == "enum" else kind, start, close, head, parent, bases)
            return close + 1
        return self.variable(m, end, members, start)

    def _value_end(self, at: int, end: int) -> int:
        i = at
        while i < end:
            c = self.code[i]
            if c in "([{":
                i = match(self.code, i)
            elif c == ";":
                return i
            elif c == "\n" and re.search(r"[\w$)\]}'\"`>]\s*$", self.code[at:i]) and not re.match(r"\s*[.,?:|&=+*/<>)-]", self.code[i:end]):
                return i - 1
            i += 1
        return end - 1

    def variable(self, m: re.Match, end: int, members: list[str], start: int) -> int | None:
        name, at = m["vname"], m.end()
        close = self._value_end(at, end)
        equals = re.compile(r"(?<![=!<>])=(?![=>])").search(self.code, at, close + 1)
        if not equals:
            return close + 1
        note, value = self.code[at : equals.start()].strip().startswith(":"), equals.end()
        text = self.code[value : close + 1].strip()
        parent = self.parent(members)
        arrow = re.match(rf"(?:async\s*)?(?:<[^>]*>\s*)?(?:\(|{NAME}\s*=>)", text)
        is_function = text.startswith(("function", "async function"))
        if arrow and not is_function:
            opening = self.code.index("(", value) if text.lstrip("async ").startswith(("(", "<")) and "(" in text else value
            after = match(self.code, opening) + 1 if self.code[opening] == "(" else value
            is_function = "=>" in self.code[after : after + 200].split("{", 1)[0] or re.match(rf"(?:async\s*)?{NAME}\s*=>", text) is not None
        if is_function:
            arrow_at = self.code.find("=>", value, close + 1)
            opening = self.code.find("{", arrow_at if arrow_at >= 0 else value, close + 1)
            body = (opening, match(self.code, opening)) if opening >= 0 and (arrow_at < 0 or not self.code[arrow_at + 2 : opening].strip()) else (arrow_at + 2, close)
            kind = "component" if self._component(name, *body) else "function"
            qname = self.add([*members, name], kind, start, close, body[0], parent)
            self.scopes.append((body[0], body[1], qname, "function"))
            self.body(body[0] + 1, body[1], [*members, name])
        elif not members:
            called = re.match(rf"({NAME}(?:\.{NAME})*)\s*(?:<[^()]*>)?\(", text)
            literal = re.match(r"^(['\"`\d\[{-]|true\b|false\b|null\b)", text)
            if called and called[1] in FACTORIES or name.isupper() or note and literal:
                self.add([*members, name], "constant", start, close, close + 1, parent)
            elif called and name[:1].isupper():
                self.add([*members, name], "component", start, close, value, parent)
        return close + 1

    def members(self, start: int, end: int, members: list[str], owner: str) -> None:
        at = start
        while m := MEMBER.search(self.code, at, end):
            if _depth(self.code[start : m.start()]):
                at = self._after(start, m.start(), end)
                continue
            name, begin = m["name"], m.start("mods") if m["mods"] else m.start("name")
            if m["what"] in "(<" and name not in KEYWORDS - {"constructor", "get", "set", "static", "async", "of"}:
                opening, close = self._block(m.end() - 1, end)
                if opening >= 0:
                    qname = self.add([*members, name], "method", begin, close, opening, owner)
                    self.scopes.append((opening, close, qname, "function"))
                    self.body(opening + 1, close, [*members, name])
                at = max(close + 1, m.end())
                continue
            close = self._value_end(m.end() - 1, end)
            equals = re.compile(r"(?<![=!<>])=(?![=>])").search(self.code, m.end() - 1, close + 1)
            value = self.code[equals.end() : close + 1].strip() if equals else ""
            if re.match(rf"(?:async\s*)?(?:\([^()]*\)|{NAME})\s*(?::[^=]+)?=>", value) or value.startswith("function"):
                qname = self.add([*members, name], "method", begin, close, equals.end(), owner)
                self.scopes.append((equals.end(), close, qname, "function"))
            elif equals and ("static" in m["mods"] or name.isupper()):
                self.add([*members, name], "constant", begin, close, close + 1, owner)
            at = close + 1

    def _component(self, name: str, start: int, end: int) -> bool:
        return name[:1].isupper() and re.search(r"<[A-Za-z][\w.]*[\s/>]|<>", self.code[start:end]) is not None

    def calls(self) -> None:
        functions = sorted(s for s in self.scopes if s[3] == "function")
        found = []
        for m in CALL.finditer(self.code):
            name = re.sub(r"\s*\??\.\s*", ".", m["name"])
            if name.partition(".")[0] in KEYWORDS - {"this", "super"} or re.search(r"\bfunction\s*\*?\s*$", self.code[max(0, m.start() - 12) : m.start()]):
                continue
            found.append((m.start("name"), name))
        found += [(m.start(1), f"<{m[1]}>") for m in TAG.finditer(self.code)]
        for at, name in sorted(found):
            own = [s for s in functions if s[0] <= at <= s[1]]
            if own:
                self.out.calls.append((max(own)[2], name, self.target(name.strip("<>"), at), self.line(at)))

    def target(self, name: str, at: int) -> str | None:
        head, *rest = name.split(".")
        if head in ("this", "super"):
            owner = max((s for s in self.scopes if s[3] == "class" and s[0] <= at <= s[1]), default=None)
            if not owner or len(rest) != 1:
                return None
            if head == "this":
                return f"{owner[2]}.{rest[0]}"
            base = next(iter(self.bases.get(owner[2], [])), None)
            found = self.target(base, at) if base else None
            return f"{found}.{rest[0]}" if found else None
        if head in self.brought:
            module, real = self.brought[head]
            path = relative_module(module, self.module if not re.search(r"(^|/)index\.\w+$", self.rel) else self.module + "/index")
            first = [] if real == "*" else [head if real == "default" else real]
            return qualified(path, [*first, *rest])
        return qualified(self.module, [head, *rest]) if head in self.tops else None


def _depth(code: str) -> int:
    depth = 0
    for c in code:
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
    return depth


def parse(rel: str, text: str) -> Parsed:
    """Symbols, calls and imports of a module."""
    return _Scan(rel, text).run()
