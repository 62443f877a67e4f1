"""The built-in table test.test.csv: 200 rows, two equal halves of 100, with fixed times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TableEntry

TIME = "2024-01-02 03:04:05"
COLUMNS = (("data_source", "STRING"), ("event_date", "DATE"), ("network_id", "INT64"), ("process_date", "TIMESTAMP"), ("var1", "INT64"), ("var2", "FLOAT64"), ("var3", "STRING"))
ENTRIES = tuple(TableEntry("test", "test", "test", kind, COLUMNS) for kind in ("csv", "parquet", "orc"))


def read(spark: SparkSession, entry: TableEntry, name: tuple[str, str, str], requests: dict[str, str]) -> DataFrame:
    i = F.col("id") % 100
    return spark.range(0, 200, 1, 2).select(
        F.concat(F.lit("data_source"), i.cast("string")).alias("data_source"), F.to_date(F.lit(TIME)).alias("event_date"), i.alias("network_id"),
        F.to_timestamp(F.lit(TIME)).alias("process_date"), i.alias("var1"), i.cast("double").alias("var2"), F.lit("var3").alias("var3"),
    )
