"""Shared pieces: the cluster's shared folder, written intermediate tables, distributed ranks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of a text: a run without ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where all runs on one machine, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return _with_scheme(spark, folder)
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return _with_scheme(spark, known.get())
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, own, True)
    context.setCheckpointDir("file://" + own)
    return "file://" + own


def _with_scheme(spark: SparkSession, folder: str) -> str:
    """`folder` as a URI that tasks can open too, with the cluster's default file system where it names none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder that nothing else uses."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application's operators have written to the shared folder.

    Call it when their results have been read or saved: lazy results read those tables.
    """
    _delete(spark, run_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written_to = path
    if _scopes():
        _scopes()[-1].tables.append(found)
    return found


_LOCAL = threading.local()


def _scopes() -> list[scratch]:
    """The open scopes of this thread, innermost last."""
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


class scratch:
    """A scope whose written tables are deleted at its end, but for those it keeps, which pass to the scope around it.

    Only for tables that nothing lazy reads any more: what is returned must be written, and kept.
    """

    def __enter__(self) -> scratch:
        self.tables: list[DataFrame] = []
        _scopes().append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not table]
        if len(_scopes()) > 1:
            _scopes()[-2].tables.append(table)
        return table

    def __exit__(self, *error) -> None:
        _scopes().pop()
        for table in self.tables:
            _delete(table.sparkSession, table._written_to)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


_HELD: dict[tuple, object] = {}


def _give_back() -> None:
    """Returns freed memory to the system, which C allocators else keep for the worker's life."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def held(key: tuple, make: Callable[[], object]):
    """What `make` makes for `key`, kept by a Python worker until another key is asked for.

    Workers are used by one operator after another; so each holds the tables and caches of one only.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD[key] = make()
    return _HELD[key]


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """(row, doc): a written copy of `df`, each row as one struct beside a number that no other row has.

    Whatever columns `df` has, and whatever its ids repeat, rows can be told apart by the number and come back as
    they were by `doc.*`; readers of single fields read only those.
    """
    return written(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")), "rows")


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """`df` with its 0-based position in the order of the columns `order`, as long column `name`.

    Rows are sorted in range partitions; each partition's rows before it come from a prefix sum over the
    partitions' sizes, of which there are as many as partitions, so no task sees more than a partition.
    """
    low = (1 << 33) - 1
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "rank",
    ).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(sizes), "_part")  # a row for each partition
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(low)))
        .drop("_part", "_at", "_before")
    )


#: A key is hot if more than one in so many rows has it, so there are at most so many hot keys.
HOT_SHARE = 10_000


def skew_join(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join of `big` with `small`, which has a row for each key and its count in `big` as `_n`.

    Hot keys, at most `HOT_SHARE`, are joined by broadcast, so their rows stay where they are; others by a shuffle.
    `big` is read twice, so it should be a written table.
    """
    total = big.count()
    small = written(small, "keyed")
    hot = F.col("_n") > max(1, total // HOT_SHARE)
    many = F.broadcast(small.filter(hot))
    return big.join(many, key).unionByName(big.join(F.broadcast(many.select(key)), key, "left_anti").join(small.filter(~hot), key))
