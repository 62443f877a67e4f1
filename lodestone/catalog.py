"""The registry of tables by three-part names, and the statements that list it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .config import Settings, TableEntry
from .sources import SOURCES, files, mysql, synthetic
from .sql.lexer import SqlError
from .types import name_of_type


def like_pattern(pattern: str, escape: str | None = None) -> re.Pattern:
    """A LIKE pattern as a regular expression."""
    out, chars = "", iter(pattern)
    for c in chars:
        if escape and c == escape:
            out += re.escape(next(chars, ""))
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
    return re.compile(out, re.DOTALL)


class Catalog:
    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        settings = settings or Settings()
        self.spark, self.entries = spark, [*settings.tables, *synthetic.ENTRIES]
        self.catalog, self.schema = settings.catalog, settings.schema

    def add(self, name: str, frame) -> None:
        """A table from a DataFrame, or from a function of the session that makes one."""
        self.entries.insert(0, TableEntry("frame", *self.full(tuple(name.split("."))), (), {"frame": frame}))

    def add_entry(self, entry: TableEntry) -> None:
        self.entries.insert(0, entry)

    def use(self, catalog: str | None, schema: str) -> None:
        catalog = catalog or self.catalog
        if not any(e.catalog.lower() == catalog.lower() and e.matches((catalog, schema, e.table)) for e in self.entries):
            raise SqlError(f"there is no schema {catalog}.{schema}")
        self.catalog, self.schema = catalog, schema

    def full(self, parts: tuple[str, ...]) -> tuple[str, str, str]:
        if len(parts) > 3:
            raise SqlError(f"{'.'.join(parts)}: a table has at most three name parts")
        return (self.catalog, self.schema)[: 3 - len(parts)] + parts

    def entry(self, parts: tuple[str, ...]) -> tuple[TableEntry, tuple[str, str, str]]:
        name = self.full(parts)
        exact = [e for e in self.entries if not e.wild and e.matches(name)]
        found = exact or [e for e in self.entries if e.matches(name)]
        if not found:
            raise SqlError(f"there is no table {'.'.join(name)}")
        return found[0], name

    def read(self, parts: tuple[str, ...], requests: dict[str, str]) -> tuple[DataFrame, tuple[str, ...]]:
        entry, name = self.entry(parts)
        return SOURCES[entry.kind].read(self.spark, entry, name, requests), name

    # listings

    def names(self, catalog: str) -> list[tuple[str, str, str]]:
        """The tables of a catalog; a MySQL server is asked only if it is in it."""
        out: dict[tuple[str, str, str], None] = {}
        for e in self.entries:
            if e.catalog.lower() != catalog.lower():
                continue
            if e.kind == "mysql" and e.wild:
                tables = mysql.discover(self.spark, e).select("table_schema", "table_name").distinct().collect()
                out.update({(e.catalog, s, t): None for s, t in tables if e.matches((e.catalog, s, t))})
            else:
                out[e.name] = None
        return list(out)

    def _listed(self, column: str, values, like: str | None, escape: str | None) -> DataFrame:
        form = like_pattern(like, escape) if like is not None else None
        rows = [(v,) for v in sorted(set(values)) if form is None or form.fullmatch(v)]
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(column, T.StringType())]))

    def show_catalogs(self, like: str | None = None, escape: str | None = None) -> DataFrame:
        return self._listed("catalog", [e.catalog for e in self.entries], like, escape)

    def show_schemas(self, catalog: str | None = None, like: str | None = None, escape: str | None = None) -> DataFrame:
        return self._listed("schema", [s for _, s, _ in self.names(catalog or self.catalog)], like, escape)

    def show_tables(self, name: tuple[str, ...] = (), like: str | None = None, escape: str | None = None) -> DataFrame:
        catalog, schema = (self.catalog, self.schema)[: 2 - len(name)] + name[-2:]
        chosen = [t for _, s, t in self.names(catalog) if s.lower() == schema.lower()]
        return self._listed("table", chosen, like, escape)

    def columns(self, parts: tuple[str, ...]) -> list[tuple[str, str]]:
        entry, name = self.entry(parts)
        if entry.columns:
            return list(entry.columns)
        return [(f.name, name_of_type(f.dataType)) for f in SOURCES[entry.kind].read(self.spark, entry, name, {}).schema.fields]

    def show_columns(self, parts: tuple[str, ...]) -> DataFrame:
        return self.spark.createDataFrame(self.columns(parts), "NAME string, TYPE string")

    def show_partitions(self, parts: tuple[str, ...]) -> DataFrame:
        entry, name = self.entry(parts)
        if entry.kind == "file":
            return files.partitions(self.spark, entry, name)
        return self.spark.range(0).select()

    def show_create(self, parts: tuple[str, ...], what: str) -> DataFrame:
        if what == "VIEW":
            raise SqlError(f"{'.'.join(self.full(parts))} isn't a view")
        entry, name = self.entry(parts)
        columns = ",\n".join(f"  {c} {t}" for c, t in self.columns(parts))
        text = f"CREATE TABLE {'.'.join(name)} (\n{columns}\n) WITH (connector = '{entry.kind}')"
        return self.spark.createDataFrame([(text,)], "create_table string")
