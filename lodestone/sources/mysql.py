"""MySQL through JDBC: projections and filters are pushed down by Spark; schemas are discovered, not declared.

Options of an entry: host, port, user, password, and, to read in parallel, partition-column with lower-bound,
upper-bound and num-partitions. The driver's jar must be on Spark's class path. `url` and `driver` name another JDBC
server whose tables are schema.table; names are quoted by its own rule.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..config import TableEntry

BATCH = 10_000


def url(entry: TableEntry) -> str:
    return entry.options.get("url") or f"jdbc:mysql://{entry.options.get('host') or '127.0.0.1'}:{entry.options.get('port') or 3306}/"


def options(entry: TableEntry, table: str) -> dict[str, str]:
    given = entry.options
    out = {"url": url(entry), "dbtable": table, "user": str(given.get("user") or ""), "password": str(given.get("password") or ""), "pushDownPredicate": "true", "fetchsize": str(BATCH)}
    if given.get("driver"):
        out["driver"] = str(given["driver"])
    if given.get("partition-column"):
        out |= {"partitionColumn": given["partition-column"], "lowerBound": str(given["lower-bound"]), "upperBound": str(given["upper-bound"]), "numPartitions": str(given.get("num-partitions") or 8)}
    return out


def _quoted(entry: TableEntry, *parts: str) -> str:
    mark = "`" if url(entry).startswith("jdbc:mysql") else '"'
    return ".".join(mark + p.replace(mark, mark * 2) + mark for p in parts)


def read(spark: SparkSession, entry: TableEntry, name: tuple[str, str, str], requests: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options(entry, _quoted(entry, name[1], name[2]))).load()


def append(df: DataFrame, entry: TableEntry) -> int:
    """Multi-row inserts of `BATCH` rows; returns the number of rows, which Spark doesn't observe in JDBC writes."""
    extra = {"batchsize": str(BATCH), "rewriteBatchedStatements": "true"}
    df = df.persist(StorageLevel.DISK_ONLY)
    n = df.count()
    df.write.format("jdbc").mode("append").options(**options(entry, _quoted(entry, entry.schema, entry.table)) | extra).save()
    df.unpersist()
    return n


def discover(spark: SparkSession, entry: TableEntry) -> DataFrame:
    """table_schema, table_name, column_name, data_type of the server's tables."""
    query = "(SELECT table_schema, table_name, column_name, data_type FROM information_schema.columns) AS c"
    return spark.read.format("jdbc").options(**options(entry, query)).load()
