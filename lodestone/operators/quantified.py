"""NOT IN, and comparisons with ALL or ANY of a subquery, in three-valued logic.

For orderings the subquery is reduced to its least, greatest and numbers of values, so it is read once and nothing but
that row is broadcast. NOT IN (and `<> ALL`) is an anti join on equal keys, which may shuffle, beside one aggregated
row that tells whether the subquery is empty or holds a null; a null-aware anti join would broadcast all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import as_text


def not_in(item: Column, rows: DataFrame) -> Column:
    """`item NOT IN (rows)`, for `item` and the one column of `rows` in the same type."""
    value = F.col(rows.columns[0])
    row = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(value).alias("known")).alias("s")).scalar()
    n, known = row.getField("n"), row.getField("known")
    unmatched = F.when(n == 0, F.lit(True)).when(item.isNull() | (n > known), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return ~rows.filter(value == item.outer()).exists() & unmatched


def quantified(op: str, item, which: str, rows: DataFrame, compare, typed) -> Column:
    """`item op which (rows)`; `compare` compares two of `typed`."""
    name, kind = rows.columns[0], rows.schema[0].dataType
    if isinstance(item.kind, T.StringType) and not isinstance(kind, T.StringType):
        rows, kind = rows.select(as_text(F.col(name), kind).alias(name)), T.StringType()
    elif isinstance(kind, T.StringType) and not isinstance(item.kind, T.StringType):
        item = typed(as_text(item.column, item.kind), kind)
    if op == "=" and which == "ANY":
        return item.column.isin(rows)
    if op == "<>" and which == "ALL":
        return not_in(item.column, rows)
    value = F.col(name)
    row = rows.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"), F.count(value).alias("known")).alias("s")).scalar()
    low, high, n, known = (row.getField(f) for f in ("low", "high", "n", "known"))
    any_null = n > known

    def holds(against: Column) -> Column:
        return compare(op, item, typed(against, kind))

    if which == "ALL":
        every = {"=": holds(low) & holds(high), "<": holds(low), "<=": holds(low), ">": holds(high), ">=": holds(high)}[op]
        return F.when(n == 0, F.lit(True)).when(every.eqNullSafe(F.lit(False)), F.lit(False)).when(any_null, F.lit(None).cast("boolean")).otherwise(every)
    some = {"<>": holds(low) | holds(high), "<": holds(high), "<=": holds(high), ">": holds(low), ">=": holds(low)}[op]
    return F.when(n == 0, F.lit(False)).when(some.eqNullSafe(F.lit(True)), F.lit(True)).when(any_null, F.lit(None).cast("boolean")).otherwise(some)
