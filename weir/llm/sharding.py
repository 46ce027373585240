"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A shard owns ``vnodes`` points on a ring of ``cells`` cells. A row starts in the
cell that the hash of its id names and belongs to the first virtual node
clockwise. No shard takes more than its capacity: the rows over it continue
clockwise to the next virtual node whose shard has room. With ``slack=0`` the
capacities add up to the number of rows, so every shard is filled to its
capacity and row counts differ by at most one (law ``rows``). With some slack
fewer rows move when the number of shards changes.

The plan is made from counts. ``cells * splits`` counts reach the driver, however
many rows there are; rows stay on the executors and are only ranked inside their
cell's split. Texts are read once and never shuffled: a row is reduced to id,
size and checksum first, and equal ones are counted before the shuffle, so one
repeated row with a third of the table is one row of the window; it is given back
in ranges that several tasks write.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, numbered, unused


def ring(n_shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int]]:
    """(cell, hash, shard) of all virtual nodes, clockwise. A new shard adds its own only."""
    points = []
    for shard in range(n_shards):
        for replica in range(vnodes):
            h = xxhash.xxh64_intdigest(f"{shard}/{replica}", seed=1)
            points.append((h * cells >> 64, h, shard))
    return sorted(points)


def capacities(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold; without slack they add up to ``n_rows``."""
    if slack > 0:
        return [math.ceil((1 + slack) * n_rows / n_shards)] * n_shards
    base, more = divmod(n_rows, n_shards)
    return [base + (s < more) for s in range(n_shards)]


def place(counts: list[int], n_shards: int, vnodes: int, slack: float = 0.0) -> list[list[tuple[int, int]]]:
    """For each cell the (shard, rows) it sends out, in order.

    All cells first offer their rows to their own virtual node; what a full shard
    turns away is offered to the next node clockwise, and so on. The result is a
    function of the counts alone.
    """
    cells = len(counts)
    points = ring(n_shards, vnodes, cells)
    at = [p[0] for p in points]
    room = capacities(sum(counts), n_shards, slack)
    left = {c: n for c, n in enumerate(counts) if n}
    here = {c: bisect.bisect_left(at, c) for c in left}
    out: list[list[tuple[int, int]]] = [[] for _ in range(cells)]
    while left:
        for c in list(left):
            i = here[c]
            while not room[points[i % len(points)][2]]:
                i += 1
            shard = points[i % len(points)][2]
            n = min(room[shard], left[c])
            room[shard] -= n
            out[c].append((shard, n))
            left[c] -= n
            here[c] = i + 1
            if not left[c]:
                del left[c]
    return out


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    slack: float = 0.0,
    vnodes: int = 64,
    cells: int = 4096,
    splits: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Give every row a shard and a slot in it.

    Returns ``<id_col>, size, text_crc32, shard, slot``: size is the text's UTF-8
    bytes plus 16, slots of a shard run from 0 without gaps.

    Null texts count as empty (size 16, checksum 0). Null ids start in the cell
    that size and checksum name. Rows repeated whole are interchangeable: each gets
    a slot of its own. Empty tables give empty results. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("crc"),
    )
    rows = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("many"))
    bits = cells.bit_length() - 1
    if 1 << bits != cells:
        raise ValueError("cells must be a power of two")
    spot = F.when(F.col("id").isNull(), F.xxhash64("size", "crc")).otherwise(F.xxhash64("id"))
    part = (
        F.shiftrightunsigned(spot, 64 - bits) * splits + F.pmod(F.xxhash64("id", "size", "crc", F.lit(7)), F.lit(splits))
    ).cast("int")
    rows = materialize(rows.withColumn("part", part), "shard_rows")

    found = rows.groupBy("part").agg(F.sum("many").alias("n")).toPandas()  # cells * splits rows at most
    per_part = [0] * (cells * splits)
    for p, n in zip(found["part"].tolist(), found["n"].tolist(), strict=True):
        per_part[p] = n
    counts = [sum(per_part[c * splits : (c + 1) * splits]) for c in range(cells)]
    slots, plan = [0] * n_shards, []
    for c, sends in enumerate(place(counts, n_shards, vnodes, slack)):
        p, begin = c * splits, 0  # the split being dealt out and what has gone of it
        for to, n in sends:
            while n:
                while begin == per_part[p]:
                    p, begin = p + 1, 0
                k = min(n, per_part[p] - begin)
                plan.append((p, begin, begin + k, to, slots[to] - begin))
                slots[to] += k
                begin += k
                n -= k
    table = pd.DataFrame(plan, columns=["part", "lo", "hi", "shard", "shift"])
    plan_df = spark.createDataFrame(table, "part int, lo long, hi long, shard int, shift long")

    order = Window.partitionBy("part").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("end", F.sum("many").over(order)).withColumn("begin", F.col("end") - F.col("many"))
    # at most cells * splits + n_shards * vnodes rows of 40 bytes, whatever the input
    plan_df = F.broadcast(plan_df.withColumnRenamed("part", "to_part"))
    placed = ranked.join(plan_df, (F.col("part") == F.col("to_part")) & (F.col("begin") < F.col("hi")) & (F.col("end") > F.col("lo")))
    first = F.greatest("begin", "lo")
    placed = placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (first + F.col("shift")).alias("first_slot"), (F.least("end", "hi") - first).alias("many")
    )
    (out,) = unused(placed.columns, "at")
    return numbered(placed, "many", out).select(id_col, "size", "text_crc32", "shard", (F.col("first_slot") + F.col(out)).alias("slot"))
