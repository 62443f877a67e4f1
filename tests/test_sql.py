"""Lexer, parser and expression semantics on a small table of awkward values."""

import math

import pytest

from lodestone.config import Settings
from lodestone.session import Engine
from lodestone.sql.lexer import SqlError, partition_hint, tokens
from lodestone.sql.parser import parse, parse_expression
from lodestone.sql.tree import Binary, Compare, Join, Literal, Logical, Name, Not, Query, SetOperation, Unary

ROWS = [
    (1, 7, 2.5, "a%b", True, "2024-02-29 23:59:58"), (2, 0, 0.0, "", False, "1969-12-31 00:00:01"), (3, -7, -2.5, "a_b'c", None, None), (4, None, None, None, None, None),
    (5, 7, 20.0, "20", True, "2024-02-29 23:59:58"), (5, 7, 20.0, "20", True, "2024-02-29 23:59:58"), (6, 3, float("nan"), "é\\x", False, "2000-01-01 00:00:00"),
]


@pytest.fixture(scope="module")
def engine(spark):
    from pyspark.sql import functions as F

    found = Engine(spark, Settings("m", "s"))
    df = spark.createDataFrame(ROWS, "id long, i int, d double, s string, b boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    found.register("t", df)
    found.register("one", spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string"))
    found.register("none", spark.createDataFrame([], "k long, v string"))
    return found


def values(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def one(engine, expression, where="id = 1"):
    (row,) = values(engine, f"select {expression} from t where {where}")
    return row[0]


def test_tokens_and_hint():
    assert [t.kind for t in tokens("a1 \"q\"\"x\" 1 1.5 .5 1e3 0_ 'it''s' <> -- c\n/* d */ ||")] == ["word", "quoted", "int", "decimal", "decimal", "decimal", "ordinal", "string", "op", "op", "end"]
    assert tokens("'it''s'")[0].text == "it's"
    assert partition_hint("/*+partition_number=3*/ select 1") == 3 and partition_hint("select 1") is None
    with pytest.raises(SqlError):
        tokens("a ; ^")


def test_precedence():
    assert parse_expression("1 + 2 * -3 || 'x'") == Binary("||", Binary("+", Literal(1, "int", "1"), Binary("*", Literal(2, "int", "2"), Unary("-", Literal(3, "int", "3")))), Literal("x", "string", "x"))
    e = parse_expression("not a = 1 and b or c")
    assert isinstance(e, Logical) and e.op == "OR" and isinstance(e.left.left, Not) and isinstance(e.left.left.item, Compare)
    q = parse("select 1 union select 2 intersect select 3")
    assert isinstance(q, Query) and q.term.op == "UNION" and isinstance(q.term.right, SetOperation)
    assert isinstance(parse("select 1 from a, b join c on x = y").term.relation, Join)
    assert parse_expression('"Order".x') == Name(("Order", "x"))


@pytest.mark.parametrize("bad", ["select", "select 1 from", "select a b c from t", "select case end", "select 1 limit x", "select 1 where a not 3", "select a < b < c", "show nothing", "insert into t", "select 'open"])
def test_errors(bad):
    with pytest.raises(SqlError):
        parse(bad)


@pytest.mark.parametrize(
    "expression,expected",
    [
        ("i / 2", 3), ("-i / 2", -3), ("i / 0", None), ("i % 0", None), ("-i % 4", -3), ("d / 0.0", None), ("i + d", 9.5), ("1 / 2", 0), ("1.0 / 2", 0.5),
        ("'a' + 'b'", "ab"), ("'a' || i", "a7"), ("s + 'z'", "a%bz"), ("b + b", 2), ("'a' || null", None), ("+i", 7),
        ("substr('hello', 1, 3)", "el"), ("substr('hello', 3, 99)", "lo"), ("substr('hello', 4, 2)", ""), ("length('é')", 2), ("reverse('ab')", "ba"), ("concat('a', 'b')", "ab"), ("replace('aXbX', 'X', '-')", "a-b-"),
        ("log(8.0, 2.0)", 3.0), ("ln(0.0)", -math.inf), ("log10(1000)", 3.0), ("log2(8)", 3.0), ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("abs(-3)", 3), ("pow(2, 3)", 8.0), ("pi()", math.pi), ("e()", math.e),
        ("year(ts)", 2024), ("month(ts)", 2), ("day(ts)", 29), ("hour(ts)", 23), ("minute(ts)", 59), ("second(ts)", 58), ("year(ts + 2)", 2024), ("day(ts + 2)", 1), ("ts - ts", 0),
        ("case when i > 5 then 'x' end", "x"), ("case when i > 9 then 1 when b then 2 else 3 end", 2), ("case when i > 9 then 1 end", None), ("upper(lower('Ab'))", "AB"),
        ("i between 7 and 8", True), ("i not between 1 and 6", True), ("i in (1, 7)", True), ("i in ('7')", True), ("i not in (1, null)", None), ("i = null", None), ("null is null", True), ("i is distinct from null", True), ("null is not distinct from null", True),
        ("s like 'a\\%b'", False), ("s like 'a!%b' escape '!'", True), ("s like '_%_'", True), ("i like '7'", True), ("s not like 'b%'", True), ("null like 'x'", None),
        ("timestamp '2024-02-29 23:59:58' = ts", True), ("timestamp '2024-02-29T23:59:58Z' = ts", True), ("timestamp 'Thu, 29 Feb 2024 23:59:58 UTC' = ts", True), ("timestamp 'Thu Feb 29 23:59:58 UTC 2024' = ts", True), ("true and not false or b", True),
    ],
)
def test_expressions(engine, expression, expected):
    got = one(engine, expression)
    assert got == pytest.approx(expected) if isinstance(expected, float) and math.isfinite(expected) else got == expected


def test_strings_against_numbers(engine):
    assert values(engine, "select distinct id from t where d = s") == [(5,)]  # 20.0 reads "20"
    assert values(engine, "select id from t where id = '3'") == [(3,)]
    assert math.isnan(one(engine, "ln(-1.0)"))
    assert one(engine, "s || s", "id = 6") == "é\\xé\\x" and one(engine, "s like 'é\\x'", "id = 6")


def test_default_names(engine):
    assert engine.sql("select i, t.i, 5, 'x', abs(i), i + d, not b, -i, case when b then 1 end, sum(i) from t group by i").columns == ["i", "i", "COL_5", "COL_x", "COL_abs", "i_d", "NOT_b", "-i", "CASE", "COL_sum"]


def test_aggregates(engine):
    assert values(engine, "select count(*), count(i), count(distinct i), sum(i), avg(i), min(s), max(s), sum(distinct i) from t") == [(7, 6, 4, 17, 17 / 6, "", "é\\x", 3)]
    assert values(engine, "select count(i), sum(i), avg(d) from t where id = 4") == [(0, None, None)]
    assert values(engine, "select count(1) from t where id > 99") == [(1 - 1,)]
    assert values(engine, "select sum(s) from t") == [("2020a%ba_b'cé\\x",)]
    assert sorted(values(engine, "select i, count(distinct s), count(distinct id) from t where i is not null group by i")) == [(-7, 1, 1), (0, 1, 1), (3, 1, 1), (7, 2, 2)]
    assert sorted(values(engine, "select i + 1, sum(id) * 2 from t group by i + 1 having count(*) > 1")) == [(8, 22)]
    assert values(engine, "select abs(sum(i)) + 1 from t where i < 0") == [(8,)]
    assert values(engine, "select count(1) from t group by 1") == [(7,)]
    assert sorted(values(engine, "select i from t group by i"), key=repr) == [(-7,), (0,), (3,), (7,), (None,)]
    assert values(engine, "select i, s from t where id = 5 group by i") == [(7, "20")]
    assert values(engine, "select i as k, count(*) as n from t group by i order by n desc, k limit 1") == [(7, 3)]
    for bad in ("select sum(sum(i)) from t", "select i from t where sum(i) > 1", "select sum(*) from t", "select max(i, d) from t"):
        with pytest.raises(SqlError):
            engine.sql(bad)


def test_sorting(engine):
    assert [r[0] for r in values(engine, "select distinct i from t order by i")] == [None, -7, 0, 3, 7]
    assert [r[0] for r in values(engine, "select distinct i from t order by i desc")] == [7, 3, 0, -7, None]
    assert [r[0] for r in values(engine, "select distinct i from t order by i desc nulls first limit 2")] == [None, 7]
    assert [r[0] for r in values(engine, "select distinct i from t order by i nulls last limit all")] == [-7, 0, 3, 7, None]
    assert [r[0] for r in values(engine, "select s from t order by id desc, 1 limit 1")] == ["é\\x"]
    assert values(engine, "select id as z from t order by id + 0 desc limit 1") == [(6,)]
    assert values(engine, "(select 2 as x union all select 1) order by x limit 1") == [(1,)]


def test_set_operations(engine):
    assert sorted(values(engine, "select 1 union select 1 union all select 1")) == [(1,), (1,)]
    assert values(engine, "select id from t intersect all select 5 except select 6") == [(5,)]
    assert sorted(values(engine, "select id from t except all select 5")) == [(1,), (2,), (3,), (4,), (5,), (6,)]
    with pytest.raises(SqlError):
        engine.sql("select 1 union select 1, 2")


def test_joins(engine):
    assert sorted(values(engine, "select a.k, b.k from one a join one b on a.k = b.k")) == [(1, 1), (2, 2)]
    assert len(values(engine, "select * from one a, one b")) == 9
    assert engine.sql("select b.* from t a join one b on a.id = b.k").columns == ["k", "v"]
    assert engine.sql("select * from one a right join (select 2 as k, 'w' as w) b using (k)").columns == ["k", "v", "w"]
    assert sorted(values(engine, "select k, a.v, b.v from one a full join (select 9 as k, 'w' as v) b using (k)"), key=repr) == [(1, "x", None), (2, "y", None), (9, None, "w"), (None, "z", None)]
    assert len(values(engine, "select * from one a left join none b on a.k = b.k where b.k is null")) == 3
    with pytest.raises(SqlError):
        engine.sql("select k from one a join one b on a.k = b.k")
    assert values(engine, "select * from (one a join none n on a.k <> n.k) z") == []


def test_subqueries(engine):
    assert sorted(values(engine, "select id from t where id in (select k from one)")) == [(1,), (2,)]
    assert values(engine, "select id from t where id not in (select k from one)") == []  # a null is among them
    assert len(values(engine, "select id from t where id not in (select k from none)")) == 7
    assert sorted(values(engine, "select id from t where id in (select k from one) or i = 3")) == [(1,), (2,), (6,)]


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("which", ["all", "any"])
@pytest.mark.parametrize("rows", [[], [1], [1, 2], [2, None], [None], [2, 2]])
def test_quantified(engine, op, which, rows):
    import operator

    run = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    query = " union all ".join(f"select {'null' if r is None else r} as x" for r in rows) or "select k from none"
    if rows == [None]:
        query = "select k from one where v = 'z'"
    names, want = {1: "x", 2: "y", None: "z"}, {True: set(), False: set(), None: set()}
    for x, name in names.items():
        results = [None if x is None or r is None else run(x, r) for r in rows]
        decisive = which != "all"
        want[decisive if decisive in results else None if None in results else not decisive].add(name)
    assert {v for (v,) in values(engine, f"select v from one where k {op} {which} ({query})")} == want[True]
    assert {v for (v,) in values(engine, f"select v from one where not k {op} {which} ({query})")} == want[False]


def test_hint_changes_nothing(engine):
    plain, hinted = engine.sql("select i, count(*) as n from t group by i"), engine.sql("/*+partition_number=3*/ select i, count(*) as n from t group by i")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, hinted.collect()))


def test_names(engine):
    assert one(engine, "m.s.t.id") == 1 and one(engine, "s.T.ID") == 1 and one(engine, "0_") == 1
    for bad in ("nothing", "x.id", "nofunction(1)", "abs(1, 2)", "substr('a', -1, 2)"):
        with pytest.raises(SqlError):
            engine.sql(f"select {bad} from t")


@pytest.mark.parametrize("where,want", [
    ("i not in (select k from one where k is not null)", [0, -7, 3, 7, 7, 7]),
    ("i not in (select k from one)", []),
    ("i not in (select k from none)", [0, -7, None, 3, 7, 7, 7]),
    ("not (i in (select k from none))", [0, -7, None, 3, 7, 7, 7]),
    ("not (i in (select k from one) or id = 1)", []),
    ("not (i in (select k + 2 from one where k < 3) and id > 0)", [0, -7, 7, 7, 7]),
    ("i <> all (select k from one where k is not null)", [0, -7, 3, 7, 7, 7]),
    ("i not in (select k from one where k = 1) or i is null", [0, -7, None, 3, 7, 7, 7]),
    ("(i not in (select k from one)) is null", [0, -7, None, 3, 7, 7, 7]),
    ("s not in (select k from one where k = 1)", [7, 0, -7, 7, 7, 3]),
])
def test_not_in_with_nulls(engine, where, want):
    key = lambda v: (v is None, v or 0)
    assert sorted((r[0] for r in values(engine, f"select i from t where {where}")), key=key) == sorted(want, key=key)


def test_ordered_sum_of_strings(engine):
    assert values(engine, "select sum(v order by k desc) as a, sum(v order by k) as b, sum(k order by v) as c from one") == [("yxz", "zxy", 3)]
    for bad in ("sum(v order by k, v desc)", "sum(distinct v order by k)", "sum(v order by k nulls last)"):
        with pytest.raises(SqlError):
            engine.sql(f"select {bad} from one")
