"""Catalog files: which tables there are, where they lie and of what columns they consist."""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, field
from pathlib import Path

from .types import type_of_name

try:
    import yaml
except ImportError:  # JSON files and dicts still work
    yaml = None

KINDS = {"file-connector": "file", "http-connector": "http", "mysql-connector": "mysql"}


@dataclass(frozen=True)
class TableEntry:
    """One entry of a catalog file; its name parts may hold the wildcards * and ?."""

    kind: str  # file, http, mysql, test or frame
    catalog: str
    schema: str
    table: str
    columns: tuple[tuple[str, str], ...] = ()
    options: dict = field(default_factory=dict, hash=False)

    @property
    def name(self) -> tuple[str, str, str]:
        return self.catalog, self.schema, self.table

    def matches(self, name: tuple[str, str, str]) -> bool:
        return all(fnmatch.fnmatchcase(n.lower(), p.lower()) for n, p in zip(name, self.name))

    @property
    def wild(self) -> bool:
        return any(c in part for part in self.name for c in "*?")


@dataclass(frozen=True)
class Settings:
    catalog: str = "test"
    schema: str = "test"
    parallel_number: int | None = None
    tables: tuple[TableEntry, ...] = ()


def _entry(kind: str, key: str, raw: dict) -> TableEntry:
    names, types = raw.get("column-names") or [], raw.get("column-types") or []
    if len(names) != len(types):
        raise ValueError(f"{key}: {len(names)} column names and {len(types)} column types")
    for t in types:
        type_of_name(t)
    parts = key.split(".")
    if len(parts) != 3:
        raise ValueError(f"{key}: a table key has three parts")
    known = {"catalog", "schema", "table", "column-names", "column-types"}
    return TableEntry(kind, *parts, tuple(zip(names, (t.upper() for t in types))), {k: v for k, v in raw.items() if k not in known})


def load(source: str | Path | dict) -> Settings:
    """Settings from a YAML or JSON file, or from a dict of the same shape."""
    if isinstance(source, dict):
        raw = source
    else:
        text = Path(source).read_text(encoding="utf-8")
        if str(source).endswith(".json"):
            raw = json.loads(text)
        elif yaml is None:
            raise RuntimeError("reading YAML needs PyYAML; use a JSON file")
        else:
            raw = yaml.safe_load(text) or {}
    runtime = raw.get("runtime") or {}
    tables = [_entry(kind, key, entry or {}) for section, kind in KINDS.items() for key, entry in (raw.get(section) or {}).items()]
    return Settings(runtime.get("catalog") or "test", runtime.get("schema") or "test", runtime.get("parallel-number"), tuple(tables))
