"""Every registered query against its SQL in DuckDB, and the engine's plans."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weir import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(str(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    if name in queries.ORACLES:
        r = duck.sql(queries.ORACLES[name])
        assert got == table(r.columns, r.fetchall())
    else:
        assert got[1]


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_strict_sessions_equal_a_loop(spark, sf_dir):
    rows = queries.events(spark, sf_dir).select("user_id", F.pmod("event_id", F.lit(4)).alias("e"), F.expr("floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts) / 1000)").alias("t")).collect()
    lag, gap, mark, kept = 864_000_000, 21_600_000, None, []
    for e in range(4):
        batch = [(r["user_id"], r["t"]) for r in rows if r["e"] == e]
        kept += [x for x in batch if mark is None or x[1] >= mark]
        mark = max(t for _, t in kept) - lag
    want = []
    for u in {u for u, _ in kept}:
        groups = []
        for t in sorted(t for v, t in kept if v == u):
            if groups and t - groups[-1][-1] < gap:
                groups[-1].append(t)
            else:
                groups.append([t])
        want += [(u, g[0], g[-1], len(g)) for g in groups if g[-1] + gap <= mark]
    got = [tuple(r) for r in queries.QUERIES["strict_session_epochs"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    plan = physical(queries.QUERIES["etl_filter_project"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,F))]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert "Exchange" not in plan


def test_windows_shuffle_partial_results_once(spark, sf_dir):
    plan = physical(queries.QUERIES["tumble_1h_agg"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan
    assert "Python" not in plan


def test_interval_join_has_the_time_in_its_equality(spark, sf_dir):
    plan = physical(queries.QUERIES["interval_join_1h"](spark, sf_dir))
    assert "__lbin" in plan and "__rbin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_lookup_does_not_shuffle_the_stream(spark, sf_dir):
    plan = physical(queries.QUERIES["lookup_inner"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
