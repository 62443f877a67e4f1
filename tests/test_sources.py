"""Sources, sinks, the catalog and the endpoint."""

import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.request import Request, urlopen

import pytest

from lodestone import config, types
from lodestone.catalog import like_pattern
from lodestone.session import Engine
from lodestone.server import serve
from lodestone.sources import http_json, mysql
from lodestone.sql.lexer import SqlError


def settings(tmp_path, port=0, **extra):
    return {
        "runtime": {"catalog": "file", "schema": "info"},
        "file-connector": {"file.info.student": {"file-type": "csv", "column-names": ["id", "name", "age", "ok", "at"], "column-types": ["INT64", "STRING", "INT32", "BOOL", "TIMESTAMP"], "paths": [f"{tmp_path}/student"], **extra}},
        "http-connector": {"http.etcd.*": {"filter-column": "_http", "result-column": "_", "slices": 3, "column-names": ["key", "value", "_http", "_"], "column-types": ["STRING", "STRING", "STRING", "STRING"]}},
        "mysql-connector": {"mysql.shop.*": {"host": "db", "port": 3307, "user": "u", "password": "p", "partition-column": "id", "lower-bound": 1, "upper-bound": 9}},
    }


@pytest.fixture
def engine(spark, tmp_path):
    folder = tmp_path / "student"
    folder.mkdir()
    (folder / "a.csv").write_text('1,"Ann, ""A""",30,yes,2024-01-02 03:04:05\n2,,x,,junk\n')
    (folder / "b.csv").write_text("3,Bo,41,true,2024-01-02\n")
    (folder / "deep").mkdir()
    (folder / "deep" / "c.csv").write_text("9,No,1,,\n")
    return Engine(spark, settings(tmp_path))


def test_csv_casts_are_lenient(engine):
    rows = sorted(tuple(r) for r in engine.sql("select * from student").collect())
    zero = datetime.datetime(1970, 1, 1)
    assert rows == [(1, 'Ann, "A"', 30, True, datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, "", 0, False, zero), (3, "Bo", 41, True, datetime.datetime(2024, 1, 2))]


def test_csv_strict(spark, tmp_path, engine):
    strict = Engine(spark, settings(tmp_path, strict=True))
    assert tuple(strict.sql("select name, age, at from student where id = 2").first()) == (None, None, None)


def test_insert_into_itself_and_some_columns(engine):
    assert engine.sql("insert into file.info.student select id + 10, name, age, ok, at from student where id like '%3'").first().affected == 1
    assert engine.sql("insert into student (name, id) select 'it''s', 7").first().affected == 1
    got = {r.id: (r.name, r.age) for r in engine.sql("select id, name, age from student").collect()}
    assert got[13] == ("Bo", 41) and got[7] == ("it's", 0) and len(got) == 5
    for bad in ("insert into student select 1", "insert into student (nope) select 1", "insert into http.etcd.k select 1"):
        with pytest.raises(SqlError):
            engine.sql(bad)


@pytest.mark.parametrize("kind", ["parquet", "orc"])
def test_columnar_files_with_partitions(spark, tmp_path, kind):
    path = f"{tmp_path}/{kind}"
    getattr(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, dt int").write.partitionBy("dt"), kind)(path)
    e = Engine(spark, {"runtime": {"catalog": "file", "schema": "x"}, "file-connector": {"file.x.p": {"file-type": kind, "partitions": ["dt"], "column-names": ["id", "name", "dt"], "column-types": ["INT64", "STRING", "INT32"], "paths": [path]}}})
    assert [tuple(r) for r in e.sql("select name from p where dt = 2 and id > 0").collect()] == [("b",)]
    plan = e.sql("select name from p where dt = 2 and id > 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,0)]" in plan
    assert e.sql("insert into p select 3, 'c', 2").first().affected == 1
    assert [tuple(r) for r in e.sql("show partitions from p order by dt desc limit 1").collect()] == [(2,)]
    assert e.sql("show partitions from p where dt < 2").count() == 1


def test_unsupported_file_type(spark, tmp_path):
    e = Engine(spark, {"file-connector": {"file.x.p": {"file-type": "avro", "paths": ["/x"]}}})
    with pytest.raises(ValueError):
        e.sql("select 1 from file.x.p")


class Stub(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        Stub.seen.append(body)
        self.answer({"data": [{"key": f"k{i}", "value": {"n": i}} for i in json.loads(body)["ids"]]})

    def do_GET(self):
        Stub.seen.append(self.path)
        if self.path.startswith("/text"):
            self.send_response(200)
            self.send_header("Content-Type", "text/plain")
            self.end_headers()
            self.wfile.write(b"no json")
        else:
            self.answer({"node": {"nodes": [{"key": "k1", "value": "v1"}, {"key": "k2"}, 5]}, "path": self.path})

    def answer(self, value):
        self.send_response(200)
        self.send_header("Content-Type", "application/json")
        self.end_headers()
        self.wfile.write(json.dumps(value).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def stub():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_table(engine, stub):
    asked = json.dumps({"url": stub, "uri": "v2/keys", "dataPath": "node.nodes"})
    rows = engine.sql(f"select key, value, _http from http.etcd.keys where _http = '{asked}' and key like 'k%'").collect()
    assert sorted((r.key, r.value) for r in rows) == [("k1", "v1"), ("k2", None)] and rows[0]["_http"] == asked
    joined = engine.sql(f"select s.name, h.key from student s join http.etcd.any h on 'k' || s.id = h.key where h._http = '{asked}'")
    assert sorted(tuple(r) for r in joined.collect()) == [("", "k2"), ('Ann, "A"', "k1")]
    assert engine.sql(f"select key from http.etcd.keys where _http = '{json.dumps({'url': stub, 'uri': 'text'})}'").count() == 0
    with pytest.raises(ValueError):
        engine.sql("select key from http.etcd.keys")


def test_http_requests_are_sliced_whole(engine, stub):
    asked = json.dumps({"url": stub, "method": "POST", "dataPath": "data", "partitionBy": "ids", "contentType": "application/json", "body": json.dumps({"ids": list(range(7))}).replace('"', "'")}).replace("'", '\\"')
    Stub.seen.clear()
    rows = engine.sql(f"select key, value from http.etcd.keys where _http = '{asked}'").collect()
    assert sorted(r.key for r in rows) == [f"k{i}" for i in range(7)]
    assert len(Stub.seen) == 3
    form = http_json.requests_of(json.dumps({"url": "u", "uri": "q?ids=[1,2,3]&x=y", "partitionBy": "ids"}), 2)
    assert [r["uri"] for r in form] == ["q?ids=%5B1%5D&x=y", "q?ids=%5B2%2C+3%5D&x=y"]
    assert http_json.objects('{"a": {"b": 1}}', "a.b.c") == [] and http_json.objects('{"a": 1}', None) == [{"a": 1}]


def test_mysql_options(tmp_path):
    (entry,) = [e for e in config.load(settings(tmp_path)).tables if e.kind == "mysql"]
    found = mysql.options(entry, "`shop`.`user`")
    assert found["url"] == "jdbc:mysql://db:3307/" and found["numPartitions"] == "8" and found["pushDownPredicate"] == "true"


def test_mysql_tables_are_discovered(spark, engine, monkeypatch):
    found = spark.createDataFrame([("shop", "user", "id", "bigint"), ("shop", "order", "id", "bigint"), ("other", "x", "y", "int")], "table_schema string, table_name string, column_name string, data_type string")
    monkeypatch.setattr(mysql, "discover", lambda *args: found)
    assert [r.table for r in engine.sql("show tables from mysql.shop").collect()] == ["order", "user"]
    monkeypatch.setattr(mysql, "read", lambda spark, entry, name, requests: spark.range(3).toDF("id"))
    assert engine.sql("select count(1) as n from mysql.shop.user").first().n == 3


def test_catalog_statements(engine):
    show = lambda sql: [tuple(r) for r in engine.sql(sql).collect()]
    assert show("show catalogs") == [("file",), ("http",), ("mysql",), ("test",)]
    assert show("show catalogs like 'f%'") == [("file",)]
    assert show("show schemas from test") == [("test",)]
    assert show("show tables") == [("student",)] and show("show tables from test.test like 'c_v'") == [("csv",)]
    assert show("desc student")[:2] == [("id", "INT64"), ("name", "STRING")]
    assert show("show columns from test.test.csv")[1] == ("event_date", "DATE")
    assert "name STRING" in show("show create table student")[0][0]
    assert show("show partitions from student") == []
    assert show("use test.test") == [("test", "test")] and show("select count(*), count(distinct data_source), sum(var1) from csv") == [(200, 100, 9900)]
    for bad in ("use nowhere.x", "show create view student", "select 1 from a.b.c.d", "select 1 from nothing"):
        with pytest.raises(SqlError):
            engine.sql(bad)


def test_csv_with_partitions(spark, tmp_path):
    e = Engine(spark, {"file-connector": {"file.x.p": {"file-type": "csv", "partitions": ["dt"], "column-names": ["id", "dt", "name"], "column-types": ["INT64", "INT32", "STRING"], "paths": [f"{tmp_path}/csv"]}}})
    assert e.sql("insert into file.x.p select 1, 5, 'a,b'").first().affected == 1
    assert e.sql("insert into file.x.p (name, id, dt) select 'c', 2, 6").first().affected == 1
    assert sorted(p.name for p in (tmp_path / "csv").iterdir() if p.is_dir()) == ["dt=5", "dt=6"]
    assert [tuple(r) for r in e.sql("select * from file.x.p order by id").collect()] == [(1, 5, "a,b"), (2, 6, "c")]
    assert [tuple(r) for r in e.sql("select id from file.x.p where dt = 6").collect()] == [(2,)]
    assert [r.dt for r in e.sql("show partitions from file.x.p order by dt").collect()] == [5, 6]


def test_config(tmp_path):
    with pytest.raises(ValueError):
        config.load({"file-connector": {"a.b.c": {"column-names": ["x"], "column-types": []}}})
    with pytest.raises(ValueError):
        config.load({"file-connector": {"a.b.c": {"column-names": ["x"], "column-types": ["NOPE"]}}})
    (tmp_path / "c.json").write_text(json.dumps(settings(tmp_path)))
    assert config.load(tmp_path / "c.json") == config.load(settings(tmp_path))
    wild = config.TableEntry("file", "a", "b", "t*")
    assert wild.matches(("A", "b", "t12")) and not wild.matches(("a", "b", "u"))
    assert like_pattern("a$%_", "$").fullmatch("a%x") and not like_pattern("a").fullmatch("b")
    assert types.name_of_type(types.type_of_name("float64")) == "FLOAT64"


def test_endpoint(engine):
    server = serve(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(sql, accept):
        with urlopen(Request(f"http://127.0.0.1:{server.server_port}/query", sql.encode(), {"Accept": accept})) as r:
            return r.read()

    sql = "select id, name from student where id > 1 order by id"
    assert json.loads(ask(sql, "application/json")) == [{"id": 2, "name": ""}, {"id": 3, "name": "Bo"}]
    assert ask(sql, "text/plain").decode().split("\n")[1:3] == ["2,", "3,Bo"]
    import pyarrow as pa

    assert pa.ipc.open_stream(ask(sql, "application/octet-stream")).read_all().num_rows == 2
    with pytest.raises(Exception, match="400"):
        ask("select", "text/plain")
    server.shutdown()


def test_endpoint_sessions_names_and_broken_answers(engine):
    server = serve(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(sql, accept="application/json"):
        with urlopen(Request(f"http://127.0.0.1:{server.server_port}/query", sql.encode(), {"Accept": accept})) as r:
            return r.read()

    assert json.loads(ask("use test.test")) == [{"catalog": "test", "schema": "test"}]
    assert len(json.loads(ask("select id from student"))) == 3  # another client's default schema is as it was
    two = "select a.id, b.id, a.name as id_2 from student a join student b on a.id = b.id where a.id = 3"
    assert json.loads(ask(two)) == [{"id": 3, "id_3": 3, "id_2": "Bo"}]
    import pyarrow as pa

    found = pa.ipc.open_stream(ask("select at, id from student where id <> 2 order by id", "application/octet-stream")).read_all()
    assert [t.strftime("%Y-%m-%d %H:%M:%S") for t in found.column("at").to_pylist()] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00"]
    assert pa.ipc.open_stream(ask("select id from student where id > 99", "application/octet-stream")).read_all().num_rows == 0
    server.shutdown()
