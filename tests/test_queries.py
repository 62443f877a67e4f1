"""Every registered query of the engine against DuckDB, and the plans of some."""

import math
from pathlib import Path

import pytest

import __spark_entry__
from lodestone import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = df.collect()
    oracle = queries.ORACLES.get(name)
    if oracle is None:
        assert name in queries.ROWS_ONLY and found
        return
    want = duck.sql(oracle)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(spark, name):
    return queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Columns are pruned and filters pushed down; aggregates combine before they shuffle; top-k needs no full sort."""
    found = plan(spark, "filter_compare_bool")
    assert "GreaterThan(l_quantity,30.0)" in found.partition("PushedFilters: ")[2] and "l_shipdate" not in found
    assert plan(spark, "agg_group").count("HashAggregate") == 2
    assert "TakeOrderedAndProject" in plan(spark, "sort_limit_topk")
    assert "LeftSemi" in plan(spark, "in_subquery") and "LeftAnti" in plan(spark, "not_in_subquery")
    assert "Cartesian" not in plan(spark, "join_comma") and "NestedLoop" not in plan(spark, "join_comma")
    for name in queries.STATEMENTS:
        assert "Python" not in plan(spark, name)


def test_not_in_neither_broadcasts_all_nor_multiplies(spark):
    """NOT IN and <> ALL are joins on equal keys, which shuffle where neither side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("not_in_subquery", "quantified_any_all", "not_in_nulls"):
            found = plan(spark, name)
            assert "NestedLoop" not in found and "BroadcastHashJoin" not in found and "SortMergeJoin" in found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitioned_csv_is_pruned(spark):
    assert "PartitionFilters: [isnotnull(region" in plan(spark, "csv_partitioned").replace("PartitionFilters: [region", "PartitionFilters: [isnotnull(region")


def test_jdbc_filters_are_pushed_down_and_reads_are_partitioned(spark):
    df = queries.QUERIES["jdbc_roundtrip"](spark, DATA)
    found = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(balance,5000.0)" in found or "*GreaterThan" in found
    assert "numPartitions=4" in found


#: on executors of their own: rows of a query; of a table of many types; after an insert that fails; without the password
ON_A_CLUSTER = """
import json, sys
from pyspark.sql import SparkSession, functions as F
from lodestone import derby, queries
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").getOrCreate()
df = queries.QUERIES["jdbc_roundtrip"](spark, sys.argv[1])
out = {"columns": df.columns, "rows": [list(r) for r in df.collect()]}
options = derby.database(spark, 'CREATE TABLE "APP"."t" ("id" BIGINT, "name" VARCHAR(20), "x" DOUBLE, "d" DATE, "t" TIMESTAMP, "m" DECIMAL(20, 3), "b" BOOLEAN, "y" BLOB, "c" CLOB)')
options["dbtable"] = '"APP"."t"'
read = lambda: spark.read.format("jdbc").options(**options, partitionColumn="id", lowerBound="0", upperBound="5000", numPartitions="4", fetchsize="300").load()
write = lambda df: df.write.format("jdbc").mode("append").options(**options, batchsize="700").save()
many = spark.range(0, 5000, 1, 4).selectExpr("id", "'nä' || id as name", "if(id % 3 = 0, null, id / 7) as x", "date'2020-01-31' + int(id % 9) as d", "timestamp'2020-03-29 02:30:00.123456' + make_interval(0, 0, 0, 0, 0, 0, id) as t", "cast(id / 8 as decimal(20, 3)) as m", "id % 2 = 0 as b", "cast('z' || id as binary) as y", "'clob' || id as c")
write(many)
out["lost"], out["count"] = many.exceptAll(read()).count(), read().count()
for attempt in (lambda: write(spark.range(3).selectExpr("id", "repeat('x', if(id = 2, 500, 5)) as name").coalesce(1)), lambda: options.update(password="wrong") or read()):
    kept = dict(options)
    try:
        attempt()
    except Exception as error:
        out.setdefault("errors", []).append(str(error)[:900])
    options.update(kept)
out["then"] = read().count()
print("FOUND" + json.dumps(out))
spark.stop()
"""


def test_jdbc_reaches_executors_of_other_processes(duck, tmp_path):
    import importlib.util
    import json
    import os
    import subprocess
    import sys

    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for path in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if path.name != "work":
            (home / path.name).symlink_to(path)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    for inherited in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED"):
        env.pop(inherited, None)
    ran = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, DATA], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "FOUND" in ran.stdout, ran.stderr[-3000:]
    found = json.loads(ran.stdout.rpartition("FOUND")[2])
    expected = duck.sql(__spark_entry__.oracle_sql()["jdbc_roundtrip"])
    assert rows(found["columns"], found["rows"]) == rows(expected.columns, expected.fetchall()) and found["rows"]
    assert (found["lost"], found["count"], found["then"]) == (0, 5000, 5000)
    assert "truncation" in found["errors"][0] and "wrong password" in found["errors"][1]
