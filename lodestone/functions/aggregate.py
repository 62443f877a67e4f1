"""Aggregate functions: name -> builder of a Column from (argument, its type, distinct), and SUM of strings in an order.

A SUM of strings is one value as long as its whole group, so the group's strings are held by one task: a value can't be
split. Spark fails a value over 2 GB; other aggregates combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _count(x: Column, kind: T.DataType, distinct: bool) -> Column:
    return F.count_distinct(x) if distinct else F.count(x)


def _sum(x: Column, kind: T.DataType, distinct: bool) -> Column:
    """Strings are concatenated, in their own order so that results don't depend on partitions; booleans count."""
    if isinstance(kind, T.StringType):
        values = F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
        return F.when(F.count(x) > 0, F.array_join(values, ""))
    if isinstance(kind, T.BooleanType):
        x = x.cast("int")
    return F.sum_distinct(x) if distinct else F.sum(x)


def ordered_sum(x: Column, keys: list[Column], descending: bool, distinct: bool) -> Column:
    """SUM of strings in the order of `keys`, all of them ascending or all descending; nulls are least."""
    rows = F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys)), x.alias("x"))
    rows = F.when(x.isNotNull(), rows)
    values = F.sort_array(F.collect_set(rows) if distinct else F.collect_list(rows), not descending)
    return F.when(F.count(x) > 0, F.array_join(F.transform(values, lambda r: r.getField("x")), ""))


def _avg(x: Column, kind: T.DataType, distinct: bool) -> Column:
    x = x.cast("double")
    return F.sum_distinct(x) / F.nullif(F.count_distinct(x), F.lit(0)) if distinct else F.avg(x)


AGGREGATES: dict[str, Callable[[Column, T.DataType, bool], Column]] = {
    "COUNT": _count,
    "SUM": _sum,
    "AVG": _avg,
    "MIN": lambda x, kind, distinct: F.min(x),
    "MAX": lambda x, kind, distinct: F.max(x),
}
