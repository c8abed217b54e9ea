"""Settings of the source scan, from the [walker] table of a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

CONFIG_NAME = "sparkloom.toml"


@dataclass(frozen=True)
class ScanConfig:
    extra_skip_dirs: tuple[str, ...] = ()
    extra_skip_suffixes: tuple[str, ...] = ()
    extra_include: tuple[str, ...] = ()
    extra_exclude: tuple[str, ...] = ()
    skip_vendor_bundles: bool = True
    skip_vendor_packages: bool = True
    respect_gitignore: bool = True
    max_file_size: int = 250 * 1024
    languages: frozenset[str] | None = None


def load_config(root: str | Path) -> ScanConfig:
    """The root's settings, or the defaults. Unknown keys are let be; a known key of
    a wrong type, no languages at all, or a size below 1 is a ValueError."""
    path = Path(root) / CONFIG_NAME
    if not path.exists():
        return ScanConfig()
    table = tomllib.loads(path.read_text()).get("walker", {})
    if not isinstance(table, dict):
        raise ValueError(f"{path}: [walker] is not a table")
    made = {}
    for f in fields(ScanConfig):
        if f.name not in table:
            continue
        value, want = table[f.name], f.default
        if isinstance(want, bool):
            fine = isinstance(value, bool)
        elif isinstance(want, int):
            fine = isinstance(value, int) and not isinstance(value, bool) and value > 0
        else:
            fine = isinstance(value, list) and all(isinstance(x, str) for x in value) and (f.name != "languages" or bool(value))
        if not fine:
            raise ValueError(f"{path}: [walker].{f.name} has a wrong value: {value!r}")
        made[f.name] = (frozenset(value) if f.name == "languages" else tuple(value)) if isinstance(value, list) else value
    return ScanConfig(**made)
