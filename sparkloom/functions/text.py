"""Scalar text functions, as columns and as plain functions for one query string.

Columns stay inside code generation; the plain twins serve query analysis on the
driver, where there is one string.
"""

from __future__ import annotations

import json
import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that mark prose queries.
PROSE_WORDS = frozenset(
    "how what why where when which who whose does do did is are was were be been being the a an and or of for to in on at from with by about after before between into through via over under that this these those".split()
)
# Words of qualified names that say nothing about a symbol.
PLAIN_NAME_WORDS = frozenset("src lib app apps test tests components component utils util helpers helper index main core common".split())
# Query words that ask for a route, and marks of routing decorators.
ROUTE_WORDS = frozenset("api endpoint view route handler webhook url request controller".split())
ROUTE_MARKS = ("api_view", "@action(", "viewset", "require_http_methods", "require_get", "require_post", ".route(", "@app.get(", "@app.post(", "@app.put(", "@app.delete(", "@app.patch(", "@router.get(", "@router.post(", "@router.put(", "@router.delete(", "@router.patch(", "@get(", "@post(", "@put(", "@delete(", "@patch(", "@controller(")
# Phrases of audit queries, and words around what they ask for.
AUDIT = re.compile(r"\b(list every|every place|every call|every use|audit|find all|all the|where (?:are|is|do)|enumerate)\b", re.I)
AUDIT_FILLERS = frozenset(
    "site sites usage usages use uses used place places call calls called caller callers occurrence occurrences instance instances code codebase repo project module modules function functions method methods class classes model models field fields".split()
)
# Languages without executable code.
DOC_LANGUAGES = ("markdown", "html", "text", "json", "yaml", "toml", "env")

# Fixed value: the parts of an identifier.
NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = ".,;:!?\"'`()[]{}"


# ---- one string -------------------------------------------------------------


def query_words(query: str) -> list[str]:
    """Lower-case word tokens; an underscore is part of a word."""
    return re.findall(r"\w+", query.lower())


def match_terms(query: str) -> list[list[str]]:
    """The phrases that a query asks for, any of which may match: a word with
    underscores is a phrase of its parts. No words: nothing matches."""
    phrases = [[p for p in re.split(r"[\W_]+", w) if p] for w in query_words(query)]
    return [p for p in phrases if p]


def is_identifier(word: str) -> bool:
    """Whether a word looks like a name in source code."""
    if any(mark in word for mark in "._:/") or (word.isupper() and len(word) > 1):
        return bool(word)
    return re.search("[a-z][A-Z]", word) is not None


def query_class(query: str) -> str:
    """identifier, natural or mixed: decides how rankings are weighed."""
    raw, words = query.split(), query_words(query)
    if 0 < len(raw) <= 2 and any(map(is_identifier, raw)):
        return "identifier"
    prose = sum(w in PROSE_WORDS for w in words)
    long_enough = len(words) >= 5 and prose >= 1 or len(words) >= 4 and prose >= 2
    return "natural" if raw and long_enough else "mixed"


def class_weights(kind: str) -> tuple[float, float]:
    """(lexical, vector) weights of a query class."""
    return {"natural": (0.5, 2.5), "identifier": (1.5, 0.8)}.get(kind, (1.0, 1.5))


def exact_name(query: str | None) -> str | None:
    """The lower-case name if the query is a single name."""
    words = (query or "").split()
    if len(words) == 1 and (is_identifier(words[0]) or re.fullmatch(r"[A-Za-z_]\w+", words[0], re.A)):
        return words[0].lower()
    return None


def simple_name(qname: str) -> str:
    """The last member of a qualified name, lower-cased."""
    return qname.partition(":")[2 if ":" in qname else 0].rpartition(".")[2].lower()


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def name_parts(text: str) -> list[str]:
    """Camel-case and digit parts of a name, lower-cased."""
    return [m.group().lower() for chunk in re.findall("[A-Za-z0-9]+", text) for m in NAME_PART.finditer(chunk)]


def identifier_words(name: str) -> list[str]:
    """Words of a name: split at marks, underscores and camel-case borders."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name))
    return [w.lower() for w in re.split(r"[\W_]+", spaced) if w]


def symbol_words(text: str, query: bool = False) -> set[str]:
    """Telling name parts: singular, of three letters or more, no plain words."""
    parts = {singular(p) for p in name_parts(text)}
    return {p for p in parts if len(p) > 2 and p not in PLAIN_NAME_WORDS and not (query and p in PROSE_WORDS)}


def path_hints(query: str) -> list[str]:
    """Words of a query that look like paths."""
    found = []
    for word in (w.strip(PUNCTUATION) for w in query.split()):
        parts = [p for p in word.split("/") if p]
        if "/" in word and "://" not in word and parts and all(re.fullmatch(r"[A-Za-z0-9._-]+", p) for p in parts) and max(map(len, parts)) > 2:
            found.append(word.strip("/"))
    return found


def asks_for_route(query: str | None) -> bool:
    return not ROUTE_WORDS.isdisjoint(query_words(query or ""))


def audit_literal(query: str) -> str | None:
    """The one name that an audit query asks for, if there is just one."""
    if not AUDIT.search(query or ""):
        return None
    words = [w for w in (w.strip(PUNCTUATION) for w in AUDIT.sub(" ", query).split()) if w and is_identifier(w)]
    dotted = [w for w in words if "." in w]
    named = dotted or [w for w in words if w.lower() not in AUDIT_FILLERS]
    return named[0] if len(named) == 1 else None


def doc_summary(doc: str | None) -> str | None:
    """The first line of a doc string."""
    return ((doc or "").strip().splitlines() or [None])[0]


def rough_tokens(payload: object) -> int:
    """About how many language-model tokens a payload takes as JSON."""
    return len(json.dumps(payload, default=str)) // 4


def line_range(text: str) -> tuple[int, int]:
    first, _, last = text.partition("-")
    return int(first), int(last)


# ---- columns ----------------------------------------------------------------

#: Lines as str.splitlines sees them.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def words(text: Column, pattern: str = r"[^\p{L}\p{N}]+") -> Column:
    """Lower-case word tokens in order."""
    return F.filter(F.split(F.lower(text), pattern), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines of a text; a break at the very end opens no further line."""
    cut = F.split(text, LINE_BREAK)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def identifier_words_col(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def singular_col(word: Column) -> Column:
    return F.when((F.length(word) > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when((F.length(word) > 3) & word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)


def symbol_words_col(text: Column, stop: frozenset[str] = PLAIN_NAME_WORDS) -> Column:
    chunks = F.regexp_replace(text, "[^A-Za-z0-9]+", " ")
    parts = F.regexp_extract_all(chunks, F.lit("([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1))
    single = F.transform(parts, lambda p: singular_col(F.lower(p)))
    return F.array_distinct(F.filter(single, lambda p: (F.length(p) > 2) & ~p.isin(sorted(stop))))


def simple_name_col(qname: Column) -> Column:
    tail = F.when(F.instr(qname, ":") > 0, F.regexp_replace(qname, r"(?s)^[^:]*:", "")).otherwise(qname)
    return F.lower(F.element_at(F.split(tail, r"\."), -1))


def query_class_col(text: Column) -> Column:
    """The class of each of many queries."""
    raw = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    prose = F.size(F.filter(tokens, lambda w: w.isin(sorted(PROSE_WORDS))))
    named = F.exists(raw, lambda w: w.rlike("[._:/]|[a-z][A-Z]") | ((F.length(w) > 1) & w.rlike("[A-Z]") & (F.upper(w) == w)))
    n = F.size(tokens)
    return F.when((F.size(raw) <= 2) & named, "identifier").when(((n >= 5) & (prose >= 1)) | ((n >= 4) & (prose >= 2)), "natural").otherwise("mixed")


def looks_like_test_col(qname: Column, file: Column) -> Column:
    return file.contains("/tests/") | file.contains("/test/") | file.endswith("/tests.py") | qname.contains("tests:") | qname.contains(":Test") | qname.endswith(".tests")


def has_route_mark_col(decorators: Column) -> Column:
    low = F.lower(F.coalesce(decorators, F.lit("")))
    found = F.lit(False)
    for mark in ROUTE_MARKS:
        found = found | low.contains(mark)
    return found


def next_action_col(kind: Column, doc: Column) -> Column:
    return F.when(kind.isin("class", "module"), "outline").when(F.length(doc) > 40, "expand").otherwise("read_body")


def embedding_text_col(qname: Column, signature: Column, doc: Column) -> Column:
    parts = [F.translate(qname, ".:", "  "), F.left(signature, F.lit(300)), F.when(doc != "", F.left(doc, F.lit(512)))]
    return F.concat_ws(" · ", *parts)


# What is no prose in a template or page, in the order it goes, and entities in the order they are decoded.
NO_PROSE = (r"(?s)\{[%{#].*?[#}%]\}", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>|<[^>]+>", r"\s+")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
#: The most characters of a summary, and its longest head: up to a space in its second half, else all of it.
SUMMARY = 480
SUMMARY_HEAD = rf"(?s)^(?:.{{{SUMMARY // 2 + 1},{SUMMARY - 1}}}(?= )|.{{{SUMMARY}}})"


def prose(markup: str) -> str:
    """Readable text of a template or page."""
    joined = functools.reduce(lambda text, rule: re.sub(rule, " ", text), NO_PROSE, markup)
    return functools.reduce(lambda text, pair: text.replace(*pair), ENTITIES, joined).strip()


def prose_summary(markup: str) -> str | None:
    """The readable text, or its head and an ellipsis."""
    text = prose(markup)
    return text[: len(re.match(SUMMARY_HEAD, text)[0])].rstrip() + "…" if len(text) > SUMMARY else text or None


def prose_summary_col(html: Column) -> Column:
    """``prose_summary`` of a column; empty where there is no text."""
    joined = functools.reduce(lambda text, rule: F.regexp_replace(text, rule, " "), NO_PROSE, html)
    text = F.trim(functools.reduce(lambda text, pair: F.replace(text, *map(F.lit, pair)), ENTITIES, joined))
    head = F.rtrim(F.regexp_extract(text, SUMMARY_HEAD, 0))
    return F.when(F.length(text) <= SUMMARY, text).otherwise(F.concat(head, F.lit("…")))
