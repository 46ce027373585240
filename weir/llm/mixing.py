"""Mixing sources to target weights by entropy balancing.

Every document starts with the rate 1 and may have 0 to ``most`` copies. Among
all rates whose expected words meet each source's target, the ones nearest to the
start (in entropy, bounded at ``most``) are exponential tilts,
most / (1 + (most - 1) exp(-lambda * size / mean size)), with one lambda a
source. The lambdas solve a convex dual, by Newton's method with a bracket around
each root; an iteration is one aggregation on the executors.

Rates depend on source and size only, so the iterations work on the counts of
(source, size), a table that stops growing when all sizes occur. Rounding goes
through the sizes of a source from long to short and carries over what a size's
whole copies could not meet, so a source misses its target by about half of its
shortest document. Which documents of a size get one copy more is decided by the
hash of their id. For that ranking every (source, size) is dealt into parts by the
leading bits of that hash, more of them the more rows there are, and equal rows
are one row with a count. All sums are exact (whole numbers or decimals) and the
lambdas are rounded, so reruns agree whatever the order of the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, numbered, unused, word_count

PART_ROWS = 1_000_000  # rows of a part, about, if one (source, size) has them all
MOST_SENT = 50_000


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2) -> list[float]:
    """Words for each source, in order: by weight, but ``most`` times its own at most.

    The weights repeat over the sources. What is over a source's bound goes to the
    others by weight, until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in sorted(free) if left * weight[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            free.remove(i)
        left -= sum(out[i] for i in over)
    return out


def _rate(lam, z, most: float):
    return most / (1 + (most - 1) * F.exp(-F.greatest(F.least(lam * z, F.lit(700.0)), F.lit(-700.0))))


def _by_source(df: DataFrame, sources: int) -> DataFrame:
    """A table with a row a source, for a join: broadcast up to ``MOST_SENT`` sources with names of 8 MB in all."""
    small = sources <= MOST_SENT and (df.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0] <= 8_000_000)
    return F.broadcast(df) if small else df.hint("merge")


def tilts(cells: DataFrame, goal: pd.DataFrame, most: float = 2, tolerance: float = 1e-9, rounds: int = 60) -> pd.DataFrame:
    """``lam`` for each source of ``goal`` (key, mean, size, target): the roots of the dual's gradient.

    ``cells`` has (key, size, n). A target of ``most`` times the source's size has
    no finite root; its lambda is infinite (all rates are ``most``).
    """
    spark = cells.sparkSession
    goal = goal.copy()
    goal["lam"], goal["lo"], goal["hi"] = 0.0, -np.inf, np.inf
    full = goal["target"] >= most * goal["size"] * (1 - 1e-12)
    goal.loc[full, "lam"] = np.inf
    done = full | (goal["size"] == 0)
    for _ in range(rounds):
        open_ = goal[~done]
        if open_.empty:
            break
        now = _by_source(spark.createDataFrame(open_[["key", "mean", "lam"]]), len(open_))
        z = F.col("size") / F.col("mean")
        q = _rate(F.col("lam"), z, most)
        words = F.col("n") * F.col("size")
        sums = cells.join(now, "key").groupBy("key").agg(
            F.sum((words * q).cast("decimal(38,6)")).cast("double").alias("got"),
            F.sum((words * z * q * (1 - q / most)).cast("decimal(38,6)")).cast("double").alias("slope"),
        ).toPandas().set_index("key")  # a row a source
        for i, row in open_.iterrows():
            got, slope = sums.loc[row["key"], "got"], sums.loc[row["key"], "slope"]
            miss = got - row["target"]
            if abs(miss) <= tolerance * row["target"]:
                done[i] = True
                continue
            lo, hi = (row["lo"], row["lam"]) if miss > 0 else (row["lam"], row["hi"])
            new = row["lam"] - miss / slope if slope > 0 else np.nan
            if not lo < new < hi:
                new = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else row["lam"] + math.copysign(1 + abs(row["lam"]), -miss)
            goal.loc[i, ["lam", "lo", "hi"]] = new, lo, hi
    goal["lam"] = [float(f"{x:.12g}") for x in goal["lam"]]
    return goal


def _round(most: int):
    """Whole copies for the cells of one source; ``extra`` documents of a cell get one more than ``base``."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False).reset_index(drop=True)
        base, extra, owed = [], [], 0.0
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            owed += size * n * rate
            copies = min(max(round(owed / size), 0), most * n) if size else n
            owed -= copies * size
            base.append(copies // n)
            extra.append(copies % n)
        return cells.assign(base=base, extra=extra)[["key", "size", "base", "extra"]]

    return run


def _before(rows: DataFrame, cell: list[str], n_rows: int) -> DataFrame:
    """``rows`` (with ``hash``, ``tie`` and ``many``) and ``before``: how many rows of the cell stand before them in the order of the hash."""
    bits = max(6, (n_rows // PART_ROWS).bit_length())
    parted = rows.withColumn("part", F.shiftrightunsigned("hash", 64 - bits))
    parts = materialize(parted.groupBy(*cell, "part").agg(F.sum("many").alias("in_part")), "parts")
    ahead = F.sum("in_part").over(Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).select(*(F.col(c).alias(f"{c}_of") for c in [*cell, "part"]), "ahead")
    inside = F.sum("many").over(Window.partitionBy(*cell, "part").orderBy("hash", "tie").rowsBetween(Window.unboundedPreceding, -1))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in [*cell, "part"]]
    joined = parted.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts.hint("merge"), same)
    return joined.select(*rows.columns, (F.col("ahead") + F.col("inside")).alias("before"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``<id_col>, source, size, source_size, target, rate, copies`` for every row.

    Sources are ordered by code point, the null source (one of its own) last. The
    size is the number of words, 0 for null. Documents without words have their
    rate and one copy, and take no words. Repeated rows share their cell's copies; ties of the hash
    go by id;
    null ids are kept. A source without words has the target 0. Empty tables give
    empty results. Other columns are ignored. The totals of the sources, a row a
    source, are held on the driver.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), word_count(F.col(text_col).cast("string")).alias("size"))
    rows = materialize(rows.groupBy("id", "key", "size").agg(F.count("*").alias("many")), "mix_rows")
    cells = materialize(rows.groupBy("key", "size").agg(F.sum("many").alias("n")), "mix_cells")
    goal = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("rows")).toPandas()
    goal = goal.sort_values("key", key=lambda k: k.map(lambda x: (x == "n", x.encode("utf-8")))).reset_index(drop=True)
    goal["target"] = targets([int(x) for x in goal["size"]], weights, share, most)
    goal["mean"] = (goal["size"] / goal["rows"].clip(lower=1)).astype(float).clip(lower=1e-9)
    schema = "key string, mean double, source_size long, target double, lam double"
    solved = tilts(cells, goal, most) if len(goal) else goal.assign(lam=0.0)
    known = spark.createDataFrame(solved.rename(columns={"size": "source_size"})[["key", "mean", "source_size", "target", "lam"]].astype({"source_size": "int64"}), schema)

    z = F.col("size") / F.col("mean")
    rate = F.when((F.col("lam") == float("inf")) | (F.col("source_size") == 0), F.lit(float(most))).otherwise(_rate(F.col("lam"), z, most))
    rated = cells.join(_by_source(known, len(goal)), "key").withColumn("rate", rate)
    copies = rated.select("key", "size", "n", "rate").groupBy("key").applyInPandas(_round(most), "key string, size long, base long, extra long")
    copies = materialize(copies, "mix_copies")
    # tables of cells grow until all sizes occur: no broadcast, however small they are
    plan = rated.select("key", "size", "source_size", "target", "rate").join(copies.hint("merge"), ["key", "size"])
    ranked = _before(rows.select("*", F.xxhash64("id", F.lit(3)).alias("hash"), F.col("id").alias("tie")), ["key", "size"], int(goal["rows"].sum()))
    ranked = ranked.join(plan.hint("merge"), ["key", "size"])
    more = F.greatest(F.least(F.col("extra") - F.col("before"), F.col("many")), F.lit(0).cast("long"))
    both = F.array(F.struct((F.col("base") + 1).alias("copies"), more.alias("rows")), F.struct(F.col("base").alias("copies"), (F.col("many") - more).alias("rows")))
    dealt = ranked.select(
        F.col("id").alias(id_col),
        F.when(F.col("key") != "n", F.expr("substring(key, 2)")).alias("source"),
        "size", "source_size", "target", "rate", F.explode(both).alias("dealt"),
    )
    row, at = unused(dealt.columns, "row_count", "row_number")
    dealt = dealt.withColumn(row, F.col("dealt.rows"))
    return numbered(dealt, row, at).select(id_col, "source", "size", "source_size", "target", "rate", F.col("dealt.copies").alias("copies"))


def repeat(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` (of the same table) says.

    Rows of equal id, source and size get the copies that ``mixed`` gives to these,
    in the order of the hash of their contents, so every source has its words. Null
    ids and sources are values like any other. Null and empty texts, of no words,
    come once. Rows repeated whole come as often as all of them should. Empty tables
    give empty results. All columns are kept, whatever their names and types. The
    counts grow with the rows, so they are not broadcast, however few they are.
    """
    cols = docs.columns
    key = ["rid", "rsource", "rsize"]
    groups = mixed.select(F.col(id_col).alias("rid"), F.col("source").alias("rsource"), F.col("size").alias("rsize"), "copies")
    groups = materialize(groups.groupBy(*key).agg(F.count("*").alias("n"), F.sum("copies").alias("total")), "copies")
    ids = materialize(groups.groupBy("rid", "rsource").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "copies_of_ids")
    row, rid, rsource, n, total, at = unused(cols, "row", "rid", "rsource", "n", "total", "at")
    own = lambda df: df.select(F.col("rid").alias(rid), F.col("rsource").alias(rsource), F.col("n").alias(n), F.col("total").alias(total)).hint("merge")
    same = F.col(id_col).eqNullSafe(F.col(rid)) & F.col(source_col).cast("string").eqNullSafe(F.col(rsource))
    single = docs.join(own(ids.where("n = 1")), same)
    result = numbered(single, total, at).select(*cols)
    several = ids.where("n > 1")
    if several.isEmpty():
        return result
    # ids that several rows of a source carry: by size and contents; equal rows are one with a count
    again = docs.join(own(several), same, "left_semi")
    again = again.select(
        F.col(id_col).alias("rid"), F.col(source_col).cast("string").alias("rsource"), word_count(F.col(text_col).cast("string")).alias("rsize"),
        F.sha2(F.to_json(F.struct(*cols)), 256).alias("tie"), F.struct(*cols).alias("row"),
    )
    contents = materialize(again.groupBy(*key, "tie").agg(F.count("*").alias("many"), F.first("row").alias("row")), "repeated_contents")
    narrow = contents.select(*key, "tie", "many", F.xxhash64("tie").alias("hash"))
    ranked = _before(narrow, key, int(contents.agg(F.sum("many")).first()[0]))
    match = lambda other, columns: [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in columns]  # noqa: E731, ARG005
    of = lambda df, columns: df.select(*(F.col(c).alias(f"{c}_of" if c in columns else c) for c in df.columns)).hint("merge")
    ranked = ranked.join(of(groups, key), match(groups, key))
    more = F.greatest(F.least(F.col("total") % F.col("n") - F.col("before"), F.col("many")), F.lit(0).cast("long"))
    counts = ranked.select(*key, "tie", (F.col("many") * F.floor(F.col("total") / F.col("n")).cast("long") + more).alias("times"))
    dealt = contents.join(of(counts, [*key, "tie"]), match(counts, [*key, "tie"])).select("row", "times")
    return result.unionByName(numbered(dealt, "times", "at", 10_000).select("row.*").select(*cols))
