"""Parsers by language. A new one is a module with ``extensions`` and ``parse(rel,
text)`` and an entry here; ``register`` adds one at run time."""

from __future__ import annotations

from types import ModuleType

from sparkloom.sources.names import Parsed
from sparkloom.sources.parsers import data, markup, python, script, shell


class _Part:
    def __init__(self, extensions: tuple[str, ...], parse):
        self.extensions, self.parse = extensions, parse


LANGUAGES: dict[str, ModuleType | _Part] = {
    "python": _Part((".py", ".pyi"), python.parse),
    "typescript": _Part((".ts", ".tsx", ".mts", ".cts", ".jsx", ".js", ".mjs", ".cjs"), script.parse),
    "shell": _Part((".sh", ".bash"), shell.parse),
    "markdown": _Part((".md", ".markdown"), markup.parse_markdown),
    "html": _Part((".html", ".htm", ".j2", ".jinja", ".jinja2", ".liquid", ".njk", ".twig", ".hbs", ".handlebars", ".mustache"), markup.parse_html),
    "text": _Part((".txt",), markup.parse_text),
    "toml": _Part((".toml",), data.parse_toml),
    "json": _Part((".json",), data.parse_json),
    "yaml": _Part((".yaml", ".yml"), data.parse_yaml),
    "env": _Part((".env",), data.parse_env),
}


def register(language: str, extensions: tuple[str, ...], parse) -> None:
    LANGUAGES[language] = _Part(extensions, parse)


def language_of(rel: str) -> str | None:
    """By suffix; a file whose whole name is a dot and a suffix counts as well."""
    name = rel.rpartition("/")[2]
    suffix = name[name.rindex(".") :] if "." in name else ""
    return next((lang for lang, part in LANGUAGES.items() if suffix in part.extensions), None) if suffix else None


def parse_file(rel: str, content: bytes) -> tuple[str | None, Parsed]:
    """(language, what the file holds). Undecodable bytes are replaced."""
    language = language_of(rel)
    if language is None:
        return None, Parsed()
    return language, LANGUAGES[language].parse(rel, content.decode("utf-8", "replace"))
