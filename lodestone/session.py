"""The engine: one statement in, one DataFrame out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog
from .config import Settings, load
from .plans.queries import QueryCompiler
from .plans.scope import scope_of
from .sources import SOURCES
from .sql.lexer import SqlError, partition_hint
from .sql.parser import parse
from .sql.tree import Insert, Query, Show, Use
from .types import as_text, type_of_name


class Engine:
    """Compiles statements of the dialect over a catalog.

    `config` is a catalog file, a dict of the same shape or Settings. Queries are lazy; INSERT runs at once.
    """

    def __init__(self, spark: SparkSession, config: str | Path | dict | Settings | None = None) -> None:
        settings = config if isinstance(config, Settings) else load(config) if config is not None else Settings()
        self.spark, self.catalog = spark, Catalog(spark, settings)

    def session(self) -> Engine:
        """An engine over the same tables whose USE doesn't change this one's default schema."""
        other = Engine(self.spark, Settings(self.catalog.catalog, self.catalog.schema))
        other.catalog.entries = self.catalog.entries
        return other

    def register(self, name: str, frame) -> None:
        """Adds a table: a DataFrame, or a function of the session."""
        self.catalog.add(name, frame)

    def sql(self, text: str) -> DataFrame:
        tree, hint = parse(text), partition_hint(text)
        match tree:
            case Query():
                return self._compiler(hint).frame(tree)
            case Insert():
                return self._insert(tree, hint)
            case Use():
                self.catalog.use(tree.catalog, tree.schema)
                return self.spark.createDataFrame([(self.catalog.catalog, self.catalog.schema)], "catalog string, schema string")
            case Show():
                return self._show(tree)
        raise SqlError("unknown statement")

    def _compiler(self, hint: int | None = None) -> QueryCompiler:
        return QueryCompiler(self.spark, self.catalog.read, hint)

    def _show(self, show: Show) -> DataFrame:
        match show.what:
            case "CATALOGS":
                return self.catalog.show_catalogs(show.like, show.escape)
            case "SCHEMAS":
                return self.catalog.show_schemas(show.name[0] if show.name else None, show.like, show.escape)
            case "TABLES":
                return self.catalog.show_tables(show.name, show.like, show.escape)
            case "COLUMNS":
                return self.catalog.show_columns(show.name)
            case "CREATE TABLE" | "CREATE VIEW":
                return self.catalog.show_create(show.name, show.what.split()[1])
        found = self.catalog.show_partitions(show.name)
        if not found.columns:
            return found
        scope, compiler = scope_of(found), self._compiler()
        df = scope.df
        if show.where is not None:
            df = df.filter(compiler.compiler(scope).condition(show.where))
        if show.order:
            df = compiler.sorted(df, show.order, compiler.compiler(scope))
        df = df if show.limit is None else df.limit(show.limit)
        return df.toDF(*(f.name for f in scope.fields))

    def _insert(self, insert: Insert, hint: int | None) -> DataFrame:
        """Appends the query's rows; returns their number. Columns that aren't named are null."""
        entry, name = self.catalog.entry(insert.table)
        source = SOURCES[entry.kind]
        if not hasattr(source, "append"):
            raise SqlError(f"{'.'.join(name)} can't be written: {entry.kind} tables are read-only")
        columns = self.catalog.columns(insert.table)
        wanted = list(insert.columns) or [c for c, _ in columns]
        known = {c.lower() for c, _ in columns}
        for c in wanted:
            if c.lower() not in known:
                raise SqlError(f"{'.'.join(name)} has no column {c}")
        scope = self._compiler(hint).query(insert.query)
        if len(scope.fields) != len(wanted):
            raise SqlError(f"{len(wanted)} columns are inserted into from {len(scope.fields)}")
        given = {c.lower(): f for c, f in zip(wanted, scope.fields)}
        out = []
        for c, t in columns:
            kind = type_of_name(t)
            field = given.get(c.lower())
            if field is None:
                out.append(F.lit(None).cast(kind).alias(c))
            elif isinstance(kind, T.StringType) and not isinstance(field.kind, T.NullType):
                out.append(as_text(field.column, field.kind).alias(c))
            else:
                out.append(field.column.try_cast(kind).alias(c))
        seen = Observation()
        n = source.append(scope.df.select(*out).observe(seen, F.count(F.lit(1)).alias("n")), entry)
        return self.spark.createDataFrame([(int((seen.get.get("n") if n is None else n) or 0),)], "affected long")
