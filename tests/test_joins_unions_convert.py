from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from weir.config import parse_config
from weir.errors import BindError, DataError, SqlError
from weir.operators.convert import convert, match_columns
from weir.operators.joins import check_dimension, lookup_join
from weir.operators.unions import check_same_schema, union_all
from weir.plans.pipeline import Pipeline, run_batch_sql
from weir.plans.sqlfront import parse
from weir.queries import config_text

JOIN = "INSERT INTO o SELECT l.k AS k, l.id AS a, r.id AS b FROM l JOIN r ON l.k = r.k AND {0}.t BETWEEN {1}.t {2} AND {1}.t {3}"


def bind(sql, key, inputs, **options):
    return Pipeline.build(parse_config(config_text("o", key, inputs, **options)), sql)


def test_interval_join_in_and_out_of_the_hour(spark):
    l = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "id long, k long, t long")  # noqa: E741
    r = spark.createDataFrame([(10, 1, 1_800_000), (11, 1, 7_200_000), (12, 1, 3_600_000), (13, None, 0), (14, 1, None)], "id long, k long, t long")
    p = bind(JOIN.format("r", "l", "", "+ INTERVAL '1' HOUR"), "k", {"l": "t", "r": "t"})
    assert sorted(map(tuple, p.run_batch({"l": l, "r": r}).collect())) == [(1, 1, 10), (1, 1, 12)]


def test_interval_join_equals_nested_loops(spark):
    rng = random.Random(3)
    make = lambda n, base: [(base + i, rng.randrange(4), rng.randrange(-400, 400)) for i in range(n)]
    a, b = make(60, 0), make(60, 1000)
    l, r = (spark.createDataFrame(x, "id long, k long, t long") for x in (a, b))  # noqa: E741
    for base, low, high in (("l", "- INTERVAL '50' MILLISECOND", "+ INTERVAL '20' MILLISECOND"), ("r", "+ INTERVAL '10' MILLISECOND", "+ INTERVAL '11' MILLISECOND"), ("l", "", ""), ("r", "- INTERVAL '90' MILLISECOND", "- INTERVAL '30' MILLISECOND")):
        p = bind(JOIN.format("r" if base == "l" else "l", base, low, high), "k", {"l": "t", "r": "t"})
        j = p.statement.interval
        want = sorted((x[1], x[0], y[0]) for x in a for y in b if x[1] == y[1] and j.lower_ms <= (y[2] - x[2] if base == "l" else x[2] - y[2]) <= j.upper_ms)
        assert sorted(map(tuple, p.run_batch({"l": l, "r": r}).collect())) == want


def test_interval_join_binding():
    sql = JOIN.format("r", "l", "", "+ INTERVAL '1' HOUR")
    with pytest.raises(BindError, match="watermark"):
        bind(sql, "k", {"l": "t", "r": None})
    with pytest.raises(BindError, match="watermark"):
        bind(sql, "k", {"l": "t", "r": "u"})
    with pytest.raises(BindError, match="key"):
        bind(sql, "id", {"l": "t", "r": "t"})


FACTS = [(1, 7), (2, 8), (3, None)]
DIM = [(7, "Ana", "AR"), (9, "Bo", "SE")]


@pytest.fixture
def lookup(spark):
    facts = spark.createDataFrame(FACTS, "id long, cid long")
    dim = spark.createDataFrame(DIM, "cid long, name string, country string")

    def run(kind, where="", items="f.id, d.name AS customer", facts=facts, dim=dim, **options):
        s = parse(f"INSERT INTO o SELECT {items} FROM facts f {kind} JOIN dim d ON f.cid = d.cid{where}").lookup
        return sorted(map(tuple, lookup_join(facts, dim, s, dimension="dim", **options).collect()))

    return run


def test_lookup_inner_and_left(lookup):
    assert lookup("INNER") == [(1, "Ana")]
    assert lookup("LEFT") == [(1, "Ana"), (2, None), (3, None)]
    assert lookup("LEFT", " WHERE d.country = 'AR'") == [(1, "Ana")]


def test_lookup_names(spark):
    s = parse("INSERT INTO o SELECT f.id, d.name, d.country FROM facts f JOIN dim d ON f.cid = d.cid").lookup
    facts = spark.createDataFrame([(1, 7, "x")], "id long, cid long, name string")
    dim = spark.createDataFrame(DIM, "cid long, name string, country string")
    assert lookup_join(facts, dim, s, dimension="dim").columns == ["id", "d_name", "country"]


def test_dimension_rules(spark, lookup):
    twice = spark.createDataFrame([(7, "a", "x"), (7, "b", "x")], "cid long, name string, country string")
    with pytest.raises(DataError, match="2 rows"):
        lookup("INNER", dim=twice)
    with pytest.raises(DataError, match="null"):
        lookup("INNER", dim=spark.createDataFrame([(None, "a", "x")], "cid long, name string, country string"))
    with pytest.raises(DataError, match="budget"):
        lookup("INNER", budget=1)
    with pytest.raises(BindError, match="different types"):
        lookup("INNER", dim=spark.createDataFrame([("7", "a", "x")], "cid string, name string, country string"))
    with pytest.raises(BindError, match="a long, an int or a text"):
        lookup("INNER", dim=spark.createDataFrame([(7.0, "a", "x")], "cid double, name string, country string"))
    check_dimension(spark.createDataFrame([], "cid long"), "cid")
    assert lookup("LEFT", dim=spark.createDataFrame([], "cid long, name string, country string")) == [(1, None), (2, None), (3, None)]


def test_large_dimension_is_not_broadcast(spark):
    s = parse("INSERT INTO o SELECT f.id, d.name FROM facts f JOIN dim d ON f.cid = d.cid").lookup
    facts, dim = spark.createDataFrame(FACTS, "id long, cid long"), spark.createDataFrame(DIM, "cid long, name string, country string")
    plan = lambda n: lookup_join(facts, dim, s, dimension="dim", broadcast_bytes=n)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1 << 40) and "strategy=broadcast" not in plan(0)


def test_lookup_binding():
    sql = "INSERT INTO o SELECT f.id, d.name FROM facts f {} JOIN dim d ON f.cid = d.cid"
    with pytest.raises(BindError, match="BETWEEN"):
        bind(sql.format(""), "id", {"facts": None, "dim": None})
    bind(sql.format("LEFT"), "id", {"facts": None}, dimension=("dim", "cid"))
    with pytest.raises(BindError, match="key"):
        bind(sql.format(""), "id", {"facts": None}, dimension=("dim", "other"))
    with pytest.raises(BindError, match="right"):
        bind(sql.format("LEFT"), "id", {"dim": None}, dimension=("facts", "cid"))


def test_union_schemas(spark):
    a, b = spark.sql("SELECT 1L AS id, 2L AS n"), spark.sql("SELECT 3L AS id, 4L AS n")
    assert union_all({"a": a, "b": b}).count() == 2
    for other, why in (("SELECT 3L AS id", "columns"), ("SELECT 3L AS x, 4L AS n", "is 'x'"), ("SELECT 3L AS id, 4 AS n", "int"), ("SELECT 3L AS id, CASE WHEN rand() < 2 THEN 4L END AS n", "null")):
        with pytest.raises(BindError, match=why):
            check_same_schema({"a": a, "b": spark.sql(other)})


def test_convert(spark):
    df = spark.sql("SELECT 7 AS id, '12' AS n, true AS flag, 1.5D AS x, 9 AS unused UNION ALL SELECT NULL, NULL, NULL, NULL, 1")
    target = T.StructType([T.StructField("x", T.StringType()), T.StructField("order_id", T.LongType(), False), T.StructField("n", T.LongType()), T.StructField("flag", T.LongType())])
    out = convert(df, target, {"order_id": "id"})
    assert [f.simpleString() for f in out.schema] == ["x:string", "order_id:bigint", "n:bigint", "flag:bigint"]
    assert sorted(map(tuple, out.collect()), key=str) == [("1.5", 7, 12, 1), (None, None, None, None)]
    bad = spark.sql("SELECT 1 AS id, 'x' AS n, true AS flag, 1D AS x")
    with pytest.raises(Exception, match="CAST"):
        convert(bad, target, {"order_id": "id"}).collect()
    assert convert(bad, target, {"order_id": "id"}, strict=False).first()["n"] is None
    with pytest.raises(BindError):
        convert(df, target)


def test_match_columns():
    s = T.StructType([T.StructField("ID", T.LongType()), T.StructField("total", T.LongType())])
    t = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.LongType())])
    assert match_columns(s, t, {"amount": ("total",)}) == {"id": "ID", "amount": "total"}
    with pytest.raises(BindError):
        match_columns(s, t)


def test_binding_names():
    with pytest.raises(BindError, match="output is"):
        bind("INSERT INTO other SELECT id FROM a", "id", {"a": None})
    with pytest.raises(BindError, match="neither"):
        bind("INSERT INTO o SELECT id FROM b", "id", {"a": None})
    with pytest.raises(BindError, match="does not read"):
        bind("INSERT INTO o SELECT id FROM a", "id", {"a": None, "b": None})
    with pytest.raises(SqlError, match="GROUP BY"):
        bind("INSERT INTO o SELECT id, count(*) AS n FROM a GROUP BY id", "id", {"a": None})
    window = "INSERT INTO o SELECT id, COUNT(*) AS n FROM a GROUP BY id, TUMBLE(t, INTERVAL '1' SECOND)"
    with pytest.raises(BindError, match="no watermark"):
        bind(window, "id", {"a": None})
    with pytest.raises(BindError, match="watermark's column"):
        bind(window, "id", {"a": "u"})
    with pytest.raises(BindError, match="does not have the key"):
        bind(window, "other", {"a": "t"})


def test_general_sql(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 10L), (1, 20L), (2, 5L) AS t(k, t)")
    out = run_batch_sql("SELECT k, COUNT(*) AS n FROM x GROUP BY k, SESSION(t, INTERVAL '10' MILLISECOND)", {"x": df})
    assert sorted(map(tuple, out.collect())) == [(1, 10, 10, 1), (1, 20, 20, 1), (2, 5, 5, 1)]
    assert run_batch_sql("SELECT max(t) AS m FROM x", {"x": df}).first()["m"] == 20
