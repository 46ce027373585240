"""Connected components over link tables, without a driver-side graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n indices is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link table; equal roots mean connected.

    Randomised contraction: each round every node hooks to the neighbour (or
    itself) of smallest hash, links are mapped to the hooks and those inside one
    hook go. The nodes left shrink by a constant factor a round, whatever the
    shape of the graph, and a star of any size takes one round. Each round's
    tables are written to the shared folder. Minima and distincts combine before
    the shuffle; the joins are plain equi-joins, whose large partitions AQE can
    split, so a node with a third of all links is no single task's work.
    """
    edges = materialize(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges_0"
    )
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        t = len(hooks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        toss = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min(toss("v")).alias("best"))
        hook = materialize(best.select(F.col("u").alias("node"), F.least(F.col("best"), toss("u"))["n"].alias("rep")), f"hooks_{t}")
        left = hook.select(F.col("node").alias("u"), F.col("rep").alias("ru"))
        right = hook.select(F.col("node").alias("v"), F.col("rep").alias("rv"))
        mapped = edges.join(left, "u").select("ru", "v").join(right, "v").where("ru <> rv")
        edges = materialize(
            mapped.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), f"edges_{t + 1}"
        )
        hooks.append(hook)
    if not hooks:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = hooks[-1].select("node", F.col("rep").alias("root"))
    for hook in reversed(hooks[:-1]):
        up = roots.select(F.col("node").alias("rep"), F.col("root"))
        roots = hook.join(up, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    return materialize(roots, "roots")
