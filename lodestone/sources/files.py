"""CSV, Parquet and ORC folders.

CSV has no header; every cell is read as text and cast leniently (config `strict: true`: what doesn't parse is null),
so one bad cell never fails a query. Only files directly in the folders are read, or, of tables with `partitions`
(names of columns), those in key=value folders below, in any format. Partitions are pruned by plain comparisons of
their columns. Parquet and ORC keep predicate pushdown; columns are cast only where the catalog's type differs from
the file's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TableEntry
from ..types import lenient, type_of_name


def _paths(entry: TableEntry) -> list[str]:
    paths = entry.options.get("paths") or []
    return [paths] if isinstance(paths, str) else list(paths)


def _keys(entry: TableEntry) -> list[str]:
    """The partition columns."""
    return list(entry.options.get("partitions") or [])


def _format(entry: TableEntry) -> str:
    kind = str(entry.options.get("file-type") or "csv").lower()
    if kind not in ("csv", "parquet", "orc"):
        raise ValueError(f"{'.'.join(entry.name)}: unknown file type {kind!r}")
    return kind


def read(spark: SparkSession, entry: TableEntry, name: tuple[str, str, str], requests: dict[str, str]) -> DataFrame:
    kind, strict = _format(entry), bool(entry.options.get("strict"))
    if kind == "csv":
        keys = {k.lower() for k in _keys(entry)}
        cells = [(c, T.StringType()) for c, _ in entry.columns if c.lower() not in keys]
        named = [(c, type_of_name(t)) for c, t in entry.columns if c.lower() in keys]  # folders' names, read in their type
        schema = T.StructType([T.StructField(c, t) for c, t in cells + named])
        raw = spark.read.schema(schema).option("header", False).option("quote", '"').option("escape", '"').option("multiLine", bool(entry.options.get("multiline"))).csv(_paths(entry))
        return raw.select(*(F.col(f"`{c}`") if c.lower() in keys else lenient(F.col(f"`{c}`"), type_of_name(t), strict).alias(c) for c, t in entry.columns))
    raw = getattr(spark.read, kind)(*_paths(entry))
    if not entry.columns:
        return raw
    kinds = {f.name.lower(): f.dataType for f in raw.schema.fields}
    out = []
    for c, t in entry.columns:
        want = type_of_name(t)
        have = kinds.get(c.lower())
        if have is None:
            raise ValueError(f"{'.'.join(name)}: the files have no column {c}")
        same = have == want or isinstance(have, T.TimestampNTZType) and isinstance(want, T.TimestampType)
        out.append(F.col(f"`{c}`").alias(c) if same else F.col(f"`{c}`").try_cast(want).alias(c))
    return raw.select(*out)


def append(df: DataFrame, entry: TableEntry) -> None:
    """New files in the first folder; CSV writes null as an empty cell."""
    writer = df.write.mode("append")
    kind, path = _format(entry), _paths(entry)[0]
    if _keys(entry):
        writer = writer.partitionBy(*_keys(entry))
    if kind == "csv":
        writer.option("header", False).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    else:
        getattr(writer, kind)(path)


def partitions(spark: SparkSession, entry: TableEntry, name: tuple[str, str, str]) -> DataFrame:
    """The values of the partition columns; no columns for a table without any."""
    keys = _keys(entry)
    if not keys:
        return spark.range(0).select()
    return read(spark, entry, name, {}).select(*keys).distinct()
