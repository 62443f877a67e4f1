"""Tables given as functions of the session, or DataFrames, by a program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import TableEntry


def read(spark: SparkSession, entry: TableEntry, name: tuple[str, str, str], requests: dict[str, str]) -> DataFrame:
    made = entry.options["frame"]
    return made if isinstance(made, DataFrame) else made(spark)
