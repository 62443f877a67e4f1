"""The registered queries of the engine: statements of the dialect over TESTDATA, and DuckDB SQL for the same results."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import cache
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from .config import Settings, TableEntry
from .derby import database
from .server import serve
from .session import Engine
from .sql.lexer import SqlError

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine(spark: SparkSession, sf_dir: str, extra: tuple[TableEntry, ...] = ()) -> Engine:
    """The test tables as file.tpch.*, read as Parquet."""
    entries = tuple(TableEntry("file", "file", "tpch", t, (), {"file-type": "parquet", "paths": [f"{sf_dir}/{t}.parquet"]}) for t in TABLES)
    return Engine(spark, Settings("file", "tpch", None, (*extra, *entries)))


#: name: (statement, DuckDB SQL; None: the statement itself)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "revenue": (
        "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1.0 - l_discount)) as revenue, avg(l_discount) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus",
        None,
    ),
    "scan_project": ("select o_orderkey, o_totalprice from orders", None),
    "star_alias_star": ("select a.*, c_name from orders a join customer c on a.o_custkey = c.c_custkey where c.c_nationkey = 3", None),
    "default_names": ("select n_name, n_nationkey + n_regionkey, 5, 'x', lower(n_name) from nation", "select n_name, n_nationkey + n_regionkey as n_nationkey_n_regionkey, CAST(5 AS BIGINT) as COL_5, 'x' as COL_x, lower(n_name) as COL_lower from nation"),
    "select_distinct": ("select distinct l_returnflag, l_linestatus from lineitem", None),
    "select_all": ("select all n_regionkey from nation", None),
    "no_from": ("select 1 as one, 'a' || 'b' as ab", "select CAST(1 AS BIGINT) as one, 'ab' as ab"),
    "ordinal_column": ("select 1_ as second from nation", "select n_name as second from nation"),
    "filter_compare_bool": ("select l_orderkey, l_linenumber from lineitem where l_quantity > 30 and not (l_discount = 0.05 or l_tax <> 0.02)", None),
    "filter_between_in": ("select l_orderkey, l_linenumber from lineitem where l_quantity between 5 and 10 and l_linenumber in (1, 3) and l_quantity not between 7 and 8", None),
    "filter_in_expr": ("select n_name from nation where n_nationkey in (n_regionkey + 1, 4) or n_name not in ('CHINA', n_name)", None),
    "filter_like": ("select p_partkey from part where p_name like '%widget' or p_name like '_e%'", None),
    "filter_like_escape": ("select event_id from events where event_type not like '%$_%' escape '$'", None),
    "filter_like_number": ("select p_partkey from part where p_size like '1%'", "select p_partkey from part where CAST(p_size AS VARCHAR) like '1%'"),
    "filter_null_distinct": (
        "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000 where o_orderkey is null or o_orderkey is distinct from 7 and c_custkey is not distinct from c_custkey and c_name is not null",
        None,
    ),
    "filter_true": ("select r_name from region where true and not false", None),
    "string_number_compare": ("select n_nationkey from nation where n_nationkey = '3' or n_regionkey < '10'", "select n_nationkey from nation where CAST(n_nationkey AS VARCHAR) = '3' or CAST(n_regionkey AS VARCHAR) < '10'"),
    "in_subquery": ("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')", None),
    "not_in_subquery": ("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)", None),
    "not_in_nulls": (
        "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000 where o_orderkey not in (select o_orderkey from orders where o_totalprice > 450000) or not (c_nationkey in (select n_nationkey from nation where n_nationkey > 3) or c_custkey in (select o_custkey from orders))",
        None,
    ),
    "in_subquery_and": ("select o_orderkey from orders where o_totalprice > 100000 and (o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') or o_orderkey < 100)", None),
    "quantified_any_all": (
        "select p_partkey, p_retailprice from part where p_retailprice >= all (select p_retailprice from part where p_size < 10) or p_partkey = any (select n_nationkey from nation) or p_size < some (select n_regionkey from nation where n_nationkey > 20) or p_partkey <> all (select l_partkey from lineitem)",
        None,
    ),
    "arith_int_div_mod": (
        "select l_orderkey, l_linenumber, l_partkey / l_linenumber as d, l_partkey % 3 as m, l_partkey / (l_linenumber - l_linenumber) as z, -l_partkey / 7 as nd, -l_partkey % 7 as nm from lineitem",
        "select l_orderkey, l_linenumber, CAST(l_partkey // l_linenumber AS BIGINT) as d, CAST(l_partkey % 3 AS BIGINT) as m, CAST(NULL AS BIGINT) as z, CAST(-(l_partkey // 7) AS BIGINT) as nd, CAST(-l_partkey % 7 AS BIGINT) as nm from lineitem",
    ),
    "arith_double": (
        "select l_orderkey, l_linenumber, round((l_extendedprice * (1.0 - l_discount) / l_quantity + l_tax - 0.5) * 1000.0) as v, l_quantity / 0.0 as z from lineitem",
        "select l_orderkey, l_linenumber, round((l_extendedprice * (1.0::double - l_discount) / l_quantity + l_tax - 0.5::double) * 1000.0::double) as v, CAST(NULL AS DOUBLE) as z from lineitem",
    ),
    "string_concat_ops": ("select n_nationkey, n_name || '-' || n_name as a, n_name + '!' as b, concat(n_name, 'x') as c from nation", "select n_nationkey, n_name || '-' || n_name as a, n_name || '!' as b, n_name || 'x' as c from nation"),
    "unary_case": ("select l_orderkey, l_linenumber, case when l_quantity > 25 then 'hi' when l_quantity > 10 then 'mid' else 'lo' end as k, case when l_tax > 0.05 then 1.5 end as n, -l_linenumber as m, +l_quantity as p from lineitem", "select l_orderkey, l_linenumber, case when l_quantity > 25 then 'hi' when l_quantity > 10 then 'mid' else 'lo' end as k, case when l_tax > 0.05 then 1.5::double end as n, -l_linenumber as m, +l_quantity as p from lineitem"),
    "timestamp_literal": ("select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1997-01-01'", "select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1997-01-01 00:00:00'"),
    "null_literal": ("select n_nationkey, null as nothing, n_nationkey + null as sum_null from nation where null is null", "select n_nationkey, CAST(NULL AS INTEGER) as nothing, CAST(NULL AS INTEGER) as sum_null from nation"),
    "join_inner": ("select c_name, o_orderkey from customer join orders on c_custkey = o_custkey", None),
    "join_theta": ("select n_name, r_name from nation inner join region on n_regionkey < r_regionkey", None),
    "join_left": ("select c_custkey, o_orderkey from customer left outer join orders on c_custkey = o_custkey and o_totalprice > 400000", None),
    "join_right": ("select c_custkey, o_orderkey from orders right join customer on c_custkey = o_custkey and o_totalprice > 400000", None),
    "join_full": ("select s_suppkey, c_custkey from supplier full outer join customer on s_suppkey = c_custkey and s_acctbal > 0.0", None),
    "join_using": (
        "select * from (select n_nationkey as k, n_name from nation) a full join (select c_nationkey as k, c_custkey from customer where c_custkey < 20) b using (k)",
        None,
    ),
    "join_using_whole": (
        "select * from (select n_nationkey as k, n_name from nation) a full join (select c_nationkey as k, c_custkey from customer) b using (k)",
        None,
    ),
    "join_comma": ("select n_name, r_name from nation, region where n_regionkey = r_regionkey", None),
    "join_self": ("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "join_multi": (
        "select r_name, n_name, sum(o_totalprice) as total from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey group by r_name, n_name",
        None,
    ),
    "join_qualified": ("select file.tpch.nation.n_name, tpch.region.r_name from file.tpch.nation join tpch.region on nation.n_regionkey = file.tpch.region.r_regionkey", "select n_name, r_name from nation join region on n_regionkey = r_regionkey"),
    "agg_group": ("select l_returnflag, count(1) as n, sum(l_quantity) as q, min(l_shipdate) as lo, max(l_shipdate) as hi, avg(l_quantity) as a from lineitem group by l_returnflag", None),
    "agg_global": ("select count(*) as n, sum(l_linenumber) as s, avg(l_quantity) as a, min(l_tax) as lo, max(l_comment_) as hi from (select l_linenumber, l_quantity, l_tax, l_returnflag as l_comment_ from lineitem) t", "select count(*) as n, CAST(sum(l_linenumber) AS BIGINT) as s, avg(l_quantity) as a, min(l_tax) as lo, max(l_returnflag) as hi from lineitem"),
    "agg_empty": ("select count(*) as n, sum(n_nationkey) as s from nation where n_nationkey < 0", "select count(*) as n, CAST(sum(n_nationkey) AS BIGINT) as s from nation where n_nationkey < 0"),
    "agg_having": ("select o_custkey, count(1) as n from orders group by o_custkey having count(1) > 12 and sum(o_totalprice) / count(1) > 100000", None),
    "agg_expr": ("select l_linenumber % 2 as odd, sum(l_quantity) * 2.0 - count(1) as v from lineitem group by l_linenumber % 2", "select CAST(l_linenumber % 2 AS BIGINT) as odd, sum(l_quantity) * 2.0::double - count(1) as v from lineitem group by 1"),
    "agg_distinct_grouped": ("select l_returnflag, count(distinct l_suppkey) as s, sum(distinct l_linenumber) as t, avg(distinct l_quantity) as a from lineitem group by l_returnflag", "select l_returnflag, count(distinct l_suppkey) as s, CAST(sum(distinct l_linenumber) AS BIGINT) as t, avg(distinct l_quantity) as a from lineitem group by l_returnflag"),
    "agg_ungrouped_first": ("select n_nationkey, n_name, count(1) as n from nation join customer on n_nationkey = c_nationkey group by n_nationkey", "select n_nationkey, n_name, count(1) as n from nation join customer on n_nationkey = c_nationkey group by n_nationkey, n_name"),
    "agg_scalar_over_agg": ("select l_linestatus, abs(sum(0.0 - l_quantity)) as s, round(avg(l_quantity) * 1000.0) as a from lineitem group by l_linestatus", None),
    "agg_group_only": ("select c_mktsegment from customer group by c_mktsegment", None),
    "agg_constant_group": ("select count(1) as n from nation group by 1", "select count(1) as n from nation"),
    "agg_string_sum_ordered": (
        "select n_regionkey, sum(n_name order by n_nationkey desc) as names, count(n_name order by n_name) as n from nation group by distinct n_regionkey",
        "select n_regionkey, string_agg(n_name, '' order by n_nationkey desc) as names, count(n_name) as n from nation group by n_regionkey",
    ),
    "agg_string_sum": ("select n_regionkey, sum(n_name) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, '' order by n_name) as names from nation group by n_regionkey"),
    "sort_limit_topk": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20", None),
    "sort_nulls": (
        "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000 order by o_orderkey desc nulls first, c_custkey limit 50",
        None,
    ),
    "sort_default_nulls": (
        "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000 order by o_orderkey, c_custkey limit 50",
        "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000 order by o_orderkey nulls first, c_custkey limit 50",
    ),
    "sort_constant": ("select n_nationkey from nation order by 1 limit all", "select n_nationkey from nation"),
    "union_all": ("select n_regionkey as k from nation union all select r_regionkey from region", None),
    "union_distinct": ("select n_regionkey as k from nation union select r_regionkey from region", None),
    "union_types": ("select n_nationkey as k from nation union all select s_acctbal from supplier", None),
    "intersect": ("select n_nationkey as k from nation intersect select r_regionkey from region", None),
    "intersect_all": ("select n_regionkey as k from nation intersect all select n_nationkey % 5 from nation", "select n_regionkey as k from nation intersect all select CAST(n_nationkey % 5 AS BIGINT) from nation"),
    "except": ("select n_nationkey as k from nation except select r_regionkey from region", None),
    "except_all": ("select n_regionkey as k from nation except all select r_regionkey from region", None),
    "setop_precedence": ("select n_regionkey as k from nation union all select r_regionkey from region intersect select n_nationkey from nation where n_nationkey < 3 order by k limit 1000", None),
    "fn_math_basic": (
        "select l_orderkey, l_linenumber, abs(0.0 - l_quantity) as a, sqrt(l_quantity) as b, pow(l_quantity, 2) as c, ceil(l_discount * 10.0) as d, floor(l_discount * 10.0) as e, round(l_quantity / 4.0) as f, ceiling(l_tax) as g from lineitem",
        "select l_orderkey, l_linenumber, abs(0.0::double - l_quantity) as a, sqrt(l_quantity) as b, pow(l_quantity, 2) as c, ceil(l_discount * 10.0::double) as d, floor(l_discount * 10.0::double) as e, round(l_quantity / 4.0::double) as f, ceil(l_tax) as g from lineitem",
    ),
    "fn_math_log": (
        "select l_orderkey, l_linenumber, round(log(l_quantity, 3.0) * 1000000.0) as a, round(log10(l_quantity) * 1000000.0) as b, round(log2(l_quantity) * 1000000.0) as c, round(ln(l_quantity) * 1000000.0) as d from lineitem",
        "select l_orderkey, l_linenumber, round(ln(l_quantity) / ln(3.0) * 1000000.0) as a, round(log10(l_quantity) * 1000000.0) as b, round(log2(l_quantity) * 1000000.0) as c, round(ln(l_quantity) * 1000000.0) as d from lineitem",
    ),
    "fn_math_trig": (
        "select l_orderkey, l_linenumber, round(sin(l_tax) * 1000000.0) as a, round(cos(l_tax) * 1000000.0) as b, round(tan(l_tax) * 1000000.0) as c, round(asin(l_tax) * 1000000.0) as d, round(acos(l_tax) * 1000000.0) as e, round(atan(l_tax) * 1000000.0) as f from lineitem",
        None,
    ),
    "fn_math_hyper": (
        "select l_orderkey, l_linenumber, round(sinh(l_tax) * 1000000.0) as a, round(cosh(l_tax) * 1000000.0) as b, round(tanh(l_tax) * 1000000.0) as c, round(asinh(l_tax) * 1000000.0) as d, round(acosh(l_quantity) * 1000000.0) as e, round(atanh(l_tax) * 1000000.0) as f from lineitem",
        None,
    ),
    "fn_const": ("select r_regionkey, round(e() * 1000000.0) as e, round(pi() * 1000000.0) as pi from region", "select r_regionkey, round(exp(1) * 1000000.0) as e, round(pi() * 1000000.0) as pi from region"),
    "fn_string": (
        "select n_nationkey, length(n_name) as a, lower(n_name) as b, upper(n_name) as c, reverse(n_name) as d, substr(n_name, 0, 3) as e, substr(n_name, 2, 100) as f, replace(n_name, 'A', '-') as g from nation",
        "select n_nationkey, CAST(strlen(n_name) AS BIGINT) as a, lower(n_name) as b, upper(n_name) as c, reverse(n_name) as d, substring(n_name, 1, 3) as e, substring(n_name, 3) as f, replace(n_name, 'A', '-') as g from nation",
    ),
    "fn_time": (
        "select event_id, year(ts) as y, month(ts) as mo, day(ts) as d, hour(ts) as h, minute(ts) as mi, second(ts) as s from events",
        "select event_id, CAST(year(ts) AS INTEGER) as y, CAST(month(ts) AS INTEGER) as mo, CAST(day(ts) AS INTEGER) as d, CAST(hour(ts) AS INTEGER) as h, CAST(minute(ts) AS INTEGER) as mi, CAST(second(ts) AS INTEGER) as s from events",
    ),
    "derived_table": ("select seg, total from (select c_mktsegment as seg, sum(c_acctbal) as total from customer group by c_mktsegment) t where total > 0.0", None),
    "parenthesised_relation": ("select z.n_name from (nation n join region r on n.n_regionkey = r.r_regionkey) z where z.r_name = 'ASIA'", "select n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'"),
    "hint_partition": ("/*+partition_number=3*/ select n_regionkey, count(1) as n from nation group by n_regionkey", None),
    "rand_now_checks": (
        "select n_nationkey, rand() >= 0.0 and rand() < 1.0 as r, random() < 1.0 as q, now() > timestamp '2020-01-01' as t from nation",
        "select n_nationkey, true as r, true as q, true as t from nation",
    ),
    "group_by_all": ("select c_nationkey, count(1) as n from customer group by all c_nationkey", "select c_nationkey, count(1) as n from customer group by c_nationkey"),
    "case_insensitive": ("SeLeCt N_NAME as n_name FROM Nation left JOIN region ON N_REGIONKEY = R_REGIONKEY ORDER BY n_name asc LIMIT 5", None),
}

#: Statements checked by rows alone: their results depend on the clock and chance.
ROWS_ONLY: dict[str, str] = {
    "rand_now": "select n_nationkey, rand() as r, random() as q, now() as t from nation",
}

#: Statements about the catalog, and DuckDB SQL for what they list.
LISTINGS: dict[str, tuple[str, str]] = {
    "show_catalogs": ("show catalogs like '%i%'", "select 'file' as catalog"),
    "show_schemas": ("show schemas from file", "select 'tpch' as schema"),
    "show_tables": ("show tables from file.tpch like '%n%'", "select * from (values ('nation'), ('region'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('benchmark'), ('conversations')) t(\"table\")"),
    "show_columns": (
        "show columns from lineitem",
        "select * from (values ('l_orderkey', 'INT64'), ('l_partkey', 'INT64'), ('l_suppkey', 'INT64'), ('l_linenumber', 'INT32'), ('l_quantity', 'FLOAT64'), ('l_extendedprice', 'FLOAT64'), ('l_discount', 'FLOAT64'), ('l_tax', 'FLOAT64'), ('l_returnflag', 'STRING'), ('l_linestatus', 'STRING'), ('l_shipdate', 'TIMESTAMP')) t(NAME, TYPE)",
    ),
    "describe": (
        "describe file.tpch.orders",
        "select * from (values ('o_orderkey', 'INT64'), ('o_custkey', 'INT64'), ('o_orderstatus', 'STRING'), ('o_totalprice', 'FLOAT64'), ('o_orderdate', 'TIMESTAMP'), ('o_orderpriority', 'STRING')) t(NAME, TYPE)",
    ),
    "show_create_table": (
        "show create table nation",
        "select 'CREATE TABLE file.tpch.nation (' || chr(10) || '  n_nationkey INT32,' || chr(10) || '  n_name STRING,' || chr(10) || '  n_regionkey INT32' || chr(10) || ') WITH (connector = ''file'')' as create_table",
    ),
    "use_schema": ("use file.tpch", "select 'file' as catalog, 'tpch' as schema"),
}

ROUND_TRIP = "select n_nationkey as k, n_name as name, n_regionkey as r from nation union all select r_regionkey, 'a,\"quoted\"' || r_name, null from region"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a local one where all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"lodestone-{name}-")


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT into a CSV table, twice from queries, then read back."""
    folder = _folder(spark, "csv")
    table = TableEntry("file", "file", "info", "copy", (("k", "INT64"), ("name", "STRING"), ("r", "INT32")), {"file-type": "csv", "paths": [folder]})
    e = engine(spark, sf_dir, (table,))
    first = e.sql(f"insert into file.info.copy {ROUND_TRIP}").first()["affected"]
    second = e.sql("insert into file.info.copy (name, k) select name, k + 1000 from file.info.copy where r = 2").first()["affected"]
    return e.sql(f"select k, name, r, {first} as first, {second} as second from file.info.copy")


def _partitioned(kind: str, listing: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """INSERT into a table with a partition column, then read some of its partitions, or list them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = (("k", "INT64"), ("region", "INT32"), ("name", "STRING"))
        table = TableEntry("file", "file", "info", "parts", columns, {"file-type": kind, "partitions": ["region"], "paths": [_folder(spark, kind)]})
        e = engine(spark, sf_dir, (table,))
        e.sql("insert into file.info.parts (name, k, region) select c_name, c_custkey, c_nationkey % 5 from customer")
        return e.sql(listing or "select name, region, k from file.info.parts where region in (1, 3) and k > 10")

    return run


def _wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for all tables whose names begin alike; another, of a whole name, goes before it."""
    wild = TableEntry("file", "file", "wild", "or*", (), {"file-type": "parquet", "paths": [f"{sf_dir}/orders.parquet"]})
    exact = TableEntry("file", "file", "wild", "origins", (), {"file-type": "parquet", "paths": [f"{sf_dir}/nation.parquet"]})
    return engine(spark, sf_dir, (wild, exact)).sql("select o.o_orderkey, n.n_name from file.wild.orders_of_any_year o join file.wild.origins n on o.o_custkey % 25 = n.n_nationkey")


class _Keys(BaseHTTPRequestHandler):
    """Answers GET with 40 keys, and POST, form or JSON, with those that it asks for."""

    def do_GET(self) -> None:
        query = parse_qs(self.path.partition("?")[2])
        self._answer(json.loads(query["ids"][0]) if "ids" in query else range(40))

    def do_POST(self) -> None:
        self._answer(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["ids"])

    def _answer(self, ids) -> None:
        body = json.dumps({"node": {"nodes": [{"key": f"k{i}", "value": i * i} for i in ids]}}).encode()
        self.send_response(200)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args) -> None:
        pass


@cache
def _stub() -> str:
    """The address of a server of this process, for the HTTP source's queries."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Keys)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


HTTP = TableEntry("http", "http", "etcd", "*", (("key", "STRING"), ("value", "INT64"), ("_http", "STRING"), ("_", "STRING")), {"filter-column": "_http", "result-column": "_", "slices": 4})


def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = json.dumps({"url": _stub(), "uri": "v2/keys", "dataPath": "node.nodes"})
    return engine(spark, sf_dir, (HTTP,)).sql(f"select n_name, key, value + n_regionkey as v from http.etcd.keys join nation on 'k' || n_nationkey = key where _http = '{asked}' and value > 3")


def _http_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request cut at an array of its body, and one cut at an array of its query string."""
    body = {"url": _stub(), "method": "POST", "dataPath": "node.nodes", "partitionBy": "ids", "contentType": "application/json", "body": {"ids": list(range(30))}}
    query = {"url": _stub(), "uri": "v2/keys?ids=" + json.dumps(list(range(50, 60))).replace(" ", ""), "dataPath": "node.nodes", "partitionBy": "ids"}
    select = "select key, value from http.etcd.{} where _http = '{}'"
    return engine(spark, sf_dir, (HTTP,)).sql(" union all ".join(select.format(t, json.dumps(q)) for t, q in (("a", body), ("b", query))))


def _refused_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT into tables that can't be written."""
    e, out = engine(spark, sf_dir, (HTTP,)), []
    for table in ("http.etcd.keys", "test.test.csv"):
        try:
            e.sql(f"insert into {table} select 1")
            out.append((table, False))
        except SqlError:
            out.append((table, True))
    return spark.createDataFrame(out, "name string, refused boolean")


def _client_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as clients of the endpoint get them, in each form."""
    import pyarrow as pa

    server = serve(engine(spark, sf_dir))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def asked(accept: str) -> bytes:
        request = Request(f"http://127.0.0.1:{server.server_port}/query", b"select r_regionkey, r_name, r_name from region", {"Accept": accept})
        with urlopen(request) as answer:
            return answer.read()

    try:
        found = [("json", *r.values()) for r in json.loads(asked("application/json"))]
        found += [("text", int(line.split(",")[0]), *line.split(",")[1:]) for line in asked("text/plain").decode().splitlines()[1:]]
        found += [("arrow", *r.values()) for r in pa.ipc.open_stream(asked("application/octet-stream")).read_all().to_pylist()]
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame(found, "form string, r_regionkey int, r_name string, again string")


def _jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-row inserts into a JDBC table, then a read in parallel partitions with pushed-down filters."""
    server = database(spark, 'CREATE TABLE "APP"."cust" ("id" BIGINT, "name" VARCHAR(100), "balance" DOUBLE)')
    table = TableEntry("mysql", "mysql", "APP", "cust", (), server | {"partition-column": "id", "lower-bound": 0, "upper-bound": 1000, "num-partitions": 4})
    e = engine(spark, sf_dir, (table,))
    n = e.sql('insert into mysql."APP".cust (balance, id, name) select c_acctbal, c_custkey, c_name from customer').first()["affected"]
    return e.sql(f'select c.id, c.name, o.o_orderkey, {n} as inserted from mysql."APP".cust c join orders o on c.id = o.o_custkey where c.balance > 5000.0 and c.id between 10 and 900')


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql("select data_source, network_id, var1 + network_id as twice, var2, var3, year(process_date) as y from test.test.csv")


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _statement(sql) for name, (sql, _) in STATEMENTS.items()},
    **{name: _statement(sql) for name, sql in ROWS_ONLY.items()},
    **{name: _statement(sql) for name, (sql, _) in LISTINGS.items()},
    "csv_partitioned": _partitioned("csv"),
    "orc_partitioned": _partitioned("orc"),
    "show_partitions": _partitioned("parquet", "show partitions from file.info.parts where region > 0 order by region desc limit 3"),
    "wildcard_table": _wildcard,
    "http_table": _http,
    "http_sliced": _http_sliced,
    "refused_inserts": _refused_inserts,
    "client_forms": _client_forms,
    "jdbc_roundtrip": _jdbc,
    "csv_roundtrip_insert": _csv_round_trip,
    "synthetic_table": _synthetic,
}

ORACLES: dict[str, str] = {
    **{name: (sql if oracle is None else oracle) for name, (sql, oracle) in STATEMENTS.items()},
    **{name: oracle for name, (_, oracle) in LISTINGS.items()},
    **{name: "select c_name as name, CAST(c_nationkey % 5 AS INTEGER) as region, c_custkey as k from customer where c_nationkey % 5 in (1, 3) and c_custkey > 10" for name in ("csv_partitioned", "orc_partitioned")},
    "show_partitions": "select CAST(r AS INTEGER) as region from (select distinct c_nationkey % 5 as r from customer where c_nationkey % 5 > 0 order by r desc limit 3)",
    "wildcard_table": "select o_orderkey, n_name from orders join nation on o_custkey % 25 = n_nationkey",
    "http_table": "select n_name, 'k' || n_nationkey as key, CAST(n_nationkey * n_nationkey + n_regionkey AS BIGINT) as v from nation where n_nationkey * n_nationkey > 3 and n_nationkey < 40",
    "http_sliced": "select 'k' || i as key, CAST(i * i AS BIGINT) as value from range(60) t(i) where i < 30 or i >= 50",
    "refused_inserts": "select * from (values ('http.etcd.keys', true), ('test.test.csv', true)) t(name, refused)",
    "client_forms": "select form, r_regionkey, r_name, r_name as again from region, (values ('json'), ('text'), ('arrow')) t(form)",
    "jdbc_roundtrip": "select c_custkey as id, c_name as name, o_orderkey, (select count(*) from customer) as inserted from customer join orders on c_custkey = o_custkey where c_acctbal > 5000 and c_custkey between 10 and 900",
    "csv_roundtrip_insert": """
        with t as (
            select CAST(n_nationkey AS BIGINT) as k, n_name as name, CAST(n_regionkey AS INTEGER) as r from nation
            union all select r_regionkey, 'a,"quoted"' || r_name, 0 from region)
        select k, name, r, CAST((select count(*) from t) AS BIGINT) as first, CAST((select count(*) from t where r = 2) AS BIGINT) as second
        from (select * from t union all select k + 1000, name, 0 from t where r = 2)""",
    "synthetic_table": "select 'data_source' || i as data_source, CAST(i AS BIGINT) as network_id, CAST(2 * i AS BIGINT) as twice, CAST(i AS DOUBLE) as var2, 'var3' as var3, CAST(2024 AS INTEGER) as y from range(100) t(i), range(2)",
}
