"""The two joins of pipelines: of two streams within an interval, and with a dimension."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError, DataError
from ..plans.shapes import IntervalJoinShape, LookupShape
from .windows import time_ms


def interval_join(left: DataFrame, right: DataFrame, shape: IntervalJoinShape, *, binned: bool = True) -> DataFrame:
    """Pairs of equal keys whose times are within the bounds, both inclusive; null keys and times match nothing.

    An equality of keys alone would pair all rows of a hot key before the times are
    looked at. Time is cut into bins as wide as the bounds are apart, the base's
    rows go into the two bins (at most) that their bounds reach, and the bin joins
    the key in the equality: the work is in proportion to the pairs close in time,
    and a hot key is spread over its bins. ``binned=False`` leaves the bins away,
    as joins of two streams need (their state is bounded by the watermarks).
    """
    for df, side in ((left, "left"), (right, "right")):
        for c in {getattr(shape, f"{side}_key"), getattr(shape, f"{side}_time"), *(x.column for x in shape.columns if x.side == side)}:
            if c not in df.columns:
                raise BindError(f"'{getattr(shape, side)}' has no column '{c}'")
    kinds = left.schema[shape.left_key].dataType, right.schema[shape.right_key].dataType
    if kinds[0] != kinds[1]:
        raise BindError(f"the join's keys are {kinds[0].simpleString()} and {kinds[1].simpleString()}")
    lt, rt = time_ms(left, shape.left_time), time_ms(right, shape.right_time)
    a = left.withColumn("__lt", lt).alias(shape.left_alias)
    b = right.withColumn("__rt", rt).alias(shape.right_alias)
    if binned:
        # a base row's bounds are at most ``width`` apart, so they reach two bins
        width = shape.upper_ms - shape.lower_ms + 1
        bin_of = lambda t: t - F.pmod(t, F.lit(width))  # noqa: E731  named by where it begins
        reach = lambda t: F.explode(F.array_distinct(F.array(bin_of(t + shape.lower_ms), bin_of(t + shape.upper_ms))))
        if shape.base_is_left:
            a = left.withColumn("__lt", lt).where(F.col("__lt").isNotNull()).withColumn("__lbin", reach(F.col("__lt"))).alias(shape.left_alias)
            b = right.withColumn("__rt", rt).withColumn("__rbin", bin_of(F.col("__rt"))).alias(shape.right_alias)
        else:
            a = left.withColumn("__lt", lt).withColumn("__lbin", bin_of(F.col("__lt"))).alias(shape.left_alias)
            b = right.withColumn("__rt", rt).where(F.col("__rt").isNotNull()).withColumn("__rbin", reach(F.col("__rt"))).alias(shape.right_alias)
    base, other = (F.col("__lt"), F.col("__rt")) if shape.base_is_left else (F.col("__rt"), F.col("__lt"))
    on = F.col(f"`{shape.left_alias}`.`{shape.left_key}`") == F.col(f"`{shape.right_alias}`.`{shape.right_key}`")
    on = on & (other >= base + shape.lower_ms) & (other <= base + shape.upper_ms)
    if binned:
        on = on & (F.col("__lbin") == F.col("__rbin"))
    joined = a.join(b, on, "inner")
    if shape.where:
        joined = joined.where(shape.where)
    alias = {"left": shape.left_alias, "right": shape.right_alias}
    return joined.select(*[F.col(f"`{alias[c.side]}`.`{c.column}`").alias(c.alias) for c in shape.columns])


def check_dimension(dimension: DataFrame, key: str, name: str = "dimension") -> None:
    """Raise unless the key is unique and never null."""
    if key not in dimension.columns:
        raise BindError(f"'{name}' has no column '{key}'")
    bad = dimension.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).collect()
    if bad:
        what = "a null" if bad[0][0] is None else f"{bad[0][1]} rows for the key {bad[0][0]!r}"
        raise DataError(f"the dimension '{name}' has {what}")


def measured_bytes(df: DataFrame) -> int:
    """About what the rows take in memory: eight bytes a value, and the texts."""
    width = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16 if isinstance(f.dataType, T.StringType) else F.lit(8) for f in df.schema]
    total = F.lit(0).cast("long")
    for w in width:
        total = total + w
    return int(df.agg(F.sum(total).alias("b")).first()["b"] or 0)


def lookup_join(
    left: DataFrame, right: DataFrame, shape: LookupShape, *, dimension: str, budget: int | None = None, checked: bool = False, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """Rows of the stream (the side that is not ``dimension``) with those of the dimension of equal key.

    INNER leaves rows without a match out, LEFT keeps them with nulls; a null key
    never matches. ``budget`` is the memory that the dimension may take; over it an
    error is raised. A dimension of up to ``broadcast_bytes`` is sent to every
    executor, so the stream is not shuffled; a larger one is joined by a shuffle.
    """
    name, df, key = (shape.right, right, shape.right_key) if dimension == shape.right else (shape.left, left, shape.left_key)
    if name != dimension:
        raise BindError(f"'{dimension}' is not a table of the lookup")
    if shape.kind == "left" and dimension == shape.left:
        raise BindError("LEFT JOIN keeps the stream: the dimension stands on the right")
    stream, stream_key = (left, shape.left_key) if dimension == shape.right else (right, shape.right_key)
    for frame, c in ((stream, stream_key), (df, key)):
        if c not in frame.columns:
            raise BindError(f"the lookup's key '{c}' is missing")
        if not isinstance(frame.schema[c].dataType, T.LongType | T.IntegerType | T.StringType):
            raise BindError(f"the lookup's key '{c}' is {frame.schema[c].dataType.simpleString()}; a long, an int or a text is needed")
    if stream.schema[stream_key].dataType != df.schema[key].dataType:
        raise BindError("the keys of the lookup have different types")
    if not checked:
        check_dimension(df, key, name)
    size = measured_bytes(df)  # Catalyst's figure is that of the compressed files, often far below
    if budget is not None and size > budget:
        raise DataError(f"the dimension '{name}' takes about {size} bytes; the budget is {budget}")
    dim_alias, stream_alias = (shape.right_alias, shape.left_alias) if dimension == shape.right else (shape.left_alias, shape.right_alias)
    small = F.broadcast(df) if size <= broadcast_bytes else df
    a, b = stream.alias(stream_alias), small.alias(dim_alias)
    on = F.col(f"`{stream_alias}`.`{stream_key}`") == F.col(f"`{dim_alias}`.`{key}`")
    joined = a.join(b, on, shape.kind)
    if shape.where:
        joined = joined.where(shape.where)
    return joined.selectExpr(*[_named(i, dim_alias, stream.columns) for i in shape.items])


def _named(item: str, alias: str, taken: list[str]) -> str:
    """A dimension's column without an alias takes ``alias_column`` where the stream has its name too."""
    m = re.fullmatch(rf"\s*`?{re.escape(alias)}`?\s*\.\s*`?(\w+)`?\s*", item)
    return f"{item} AS `{alias}_{m[1]}`" if m and m[1] in taken else item
