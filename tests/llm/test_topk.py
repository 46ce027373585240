from __future__ import annotations

import math
import random

import duckdb
import pytest

from weir.llm import topk
from weir.llm.queries import ORACLES, op5_exact_top_k


def brute(rows, asked, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in rows:
        if (i, [math.floor(256 * x) for x in v] if v is not None and all(x is not None and math.isfinite(x) for x in v) else None) in ok and asked(i):
            queries[i] = min(queries.get(i, list(v)), list(v))
    out = []
    for i, v in queries.items():
        q = [math.floor(256 * x) for x in v]
        scored = sorted((-min(max(sum(a * b for a, b in zip(q, w, strict=True)), -(2**63)), 2**63 - 1), j) for j, w in ok if j != i and len(w) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, asked="vec_id % 5 = 0", k=3, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, extra string") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in topk.search(df.repartition(4), df.where(asked), k, **options).collect())


def test_whole_table_equals_its_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in op5_exact_top_k(spark, sf_dir).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.sql(ORACLES["op5_exact_top_k"]).fetchall()) and got


def test_repeated_queries_are_asked_once_in_sql_too(spark, tmp_path):
    rows = [(0, [1.0, 0.5]), (0, [0.5, 1.0]), (0, [0.5, 1.0]), (50, [1.0, 1.0]), *((i, [i / 7, 1 - i / 9]) for i in range(1, 12))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(tuple(r) for r in op5_exact_top_k(spark, str(tmp_path)).collect()) == sorted(con.sql(ORACLES["op5_exact_top_k"]).fetchall())


def test_random_with_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(7, rows[7][1]), (200, rows[7][1]), (10, [0.1] * 4)]
    for block in (50_000, 3):
        assert run(spark, rows, block=block) == brute(rows, lambda i: i % 5 == 0, 3)


def test_small_tiles(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.random() - 0.5 for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(spark, rows, k=60) == brute(rows, lambda i: i % 5 == 0, 60)
    best = topk._Best(*(lambda ids, m: (ids, m))(__import__("numpy").array([0, 5]), __import__("numpy").floor(256 * __import__("numpy").array([rows[0][1], rows[5][1]]))), 3)
    np = __import__("numpy")
    for k in range(0, 60, 7):
        part = rows[k : k + 7]
        best.add(np.array([i for i, _ in part]), np.floor(256 * np.array([v for _, v in part])))
    got = sorted((int(best.ids[q]), int(c), int(s)) for q, c, s in zip(best.q, best.c, best.s, strict=True))
    assert got == sorted((i, j, s) for i, _, j, s in brute(rows, lambda i: i in (0, 5), 3))
    assert df.count() == 60


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [2.0, 1.0]), (None, [9.0, 9.0]), (10, [1.0]), (15, []), (20, []), (25, None)]
    assert run(spark, rows) == [(0, 1, 5, 256 * 256 * 4), (5, 1, 0, 256 * 256 * 4), (15, 1, 20, 0), (20, 1, 15, 0)]


def test_large_components_are_exact(spark):
    rows = [(0, [1e7 + 0.5, -3e7, 1e-9]), (1, [2e7, 1e7, 5.0]), (2, [1e6, -1e6, 7.0]), (5, [123456789.0, 987654321.0, 1.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 3)
    huge = run(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])], k=2)
    assert huge == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_fewer_than_k_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])], k=5) == [(0, 1, 1, 131072)]
    assert run(spark, [(0, [1.0])], k=5) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.search(empty, empty).collect() == []
    assert topk.search(empty, empty).columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("name", ["query_id", "score", "rank"])
def test_clashing_columns(spark, name):
    df = spark.createDataFrame([(0, [1.0], "x"), (5, [2.0], "y")], f"vec_id long, embedding array<double>, {name} string")
    assert topk.search(df, df).count() == 2
