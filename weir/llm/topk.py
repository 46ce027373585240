"""Exact top-k search by tiled matrix products.

Queries come in blocks of bounded size. A block is broadcast, every task streams
its shard of the vectors past it in tiles, multiplies tile and block as matrices
and keeps the best k of each query so far, so a task's memory is one tile and
k rows a query. The tasks' lists are merged as a tree: within groups of tasks,
then across the groups.

The whole-number products are taken in floating point only where every sum is
known to be exact, else with unbounded integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, arrow_map, materialize, scratch

TILE, QUERIES_AT_ONCE, GROUPS = 2048, 1024, 16


def _whole(matrix: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(matrix.astype(np.float64) * scale)


def _by_width(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector. Only whole, finite vectors were let in."""
    off, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    width = np.diff(off)
    out = []
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        out.append((rows, flat[(off[rows][:, None] + np.arange(w)).reshape(-1)].reshape(-1, w) if w else np.zeros((len(rows), 0))))
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, limited to the range of a long."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The best k of each query of a group of queries so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.q, self.c, self.s = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # a query's k-th best score, once it has k

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        score = _products(self.matrix, matrix)
        own = self.ids[:, None] == ids[None, :]
        least = self.least
        if len(ids) > self.k + 1:  # the k-th best of the tile itself; one place more for the query's own row
            other = np.where(own, np.iinfo(np.int64).min, score)
            least = np.maximum(least, np.partition(other, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, c = np.nonzero((score >= least[:, None]) & ~own)
        q, s, c = np.concatenate([self.q, q]), np.concatenate([self.s, score[q, c]]), np.concatenate([self.c, ids[c]])
        order = np.lexsort((c, -s, q))
        q, s, c = q[order], s[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.q, self.s, self.c = q[keep], s[keep], c[keep]
        full = rank == self.k - 1
        self.least[q[full]] = s[full]


def _search(block, k: int, scale: float):
    def run(batches: Batches) -> Batches:
        groups: dict[int, list[_Best]] = {}
        for ids, matrix in block.value:
            whole = _whole(matrix, scale)
            groups[matrix.shape[1]] = [_Best(ids[i : i + QUERIES_AT_ONCE], whole[i : i + QUERIES_AT_ONCE], k) for i in range(0, len(ids), QUERIES_AT_ONCE)]
        for batch in batches:
            own = batch.column(0).to_numpy()
            for rows, matrix in _by_width(batch.column(1)):
                whole = _whole(matrix, scale)
                for i in range(0, len(rows), TILE):
                    for best in groups.get(matrix.shape[1], ()):
                        best.add(own[rows[i : i + TILE]], whole[i : i + TILE])
        for best in (b for g in groups.values() for b in g):
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.q]), pa.array(best.c), pa.array(best.s)], names=["query_id", "vec_id", "score"])

    return run


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, *, scale: float = 256.0, block: int = 50_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: for each query the k best rows of ``vectors`` by inner product.

    Components count as floor(scale * x). Ties go to the smaller id. A row with the
    query's own id is no answer to it. Vectors that are null or hold null or
    non-finite components take no part, on either side, nor do null ids; vectors
    of another length than the query's are no answers to it. A query id that
    comes several times is asked once, with its smallest vector; a repeated row
    of ``vectors`` is as many answers. Products beyond the range of a long are
    held at its ends. Empty tables give empty results. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    asked = materialize(clean(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    shards, n = clean(vectors), asked.count()
    out = scratch(spark, "top_lists")
    schema = "query_id long, vec_id long, score long, rank int"
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        # about ``block`` vectors: 26 MB of doubles for 64 components
        rows = asked.where(F.pmod(F.xxhash64("id", F.lit(b"top")), F.lit(blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast(_grouped(rows))
        lists = arrow_map(shards, _search(sent, k, scale), "query_id long, vec_id long, score long")
        lists = _best(lists.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))), k, "query_id", "group")
        _best(lists, k, "query_id").select("query_id", "vec_id", "score", "rank").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _grouped(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    ids, width = rows["id"].to_numpy(np.int64), rows["v"].map(len).to_numpy(np.int64)
    return [(ids[width == w], np.array(rows["v"][width == w].tolist(), np.float64).reshape(int((width == w).sum()), w)) for w in np.unique(width).tolist()]


def _best(lists: DataFrame, k: int, *by: str) -> DataFrame:
    """One level of the tree. Spark also cuts each task's rows to k a key before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return lists.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
