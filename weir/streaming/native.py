"""Plans for Structured Streaming's own state: its watermark, its windows, its join of two streams.

Fast, with the clock of Spark: the latest time over all partitions minus the lag,
moved between micro-batches, and late rows kept as long as their window is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BindError
from ..operators.windows import HIGH, LOW, TIME, _partials, finish, prepare, time_ms
from ..plans.shapes import IntervalJoinShape, WindowShape


def stream_windows(stream: DataFrame, shape: WindowShape, lag_ms: int) -> DataFrame:
    """TUMBLE and HOP in append mode; sessions end at their last event, which Spark's don't, and need the strict clock."""
    if shape.kind == "session":
        raise BindError("sessions run under the strict clock")
    rows = prepare(stream, shape).withColumn("__ts", F.timestamp_millis(TIME)).withWatermark("__ts", f"{lag_ms} milliseconds")
    size = f"{shape.size_ms} milliseconds"
    w = F.window("__ts", size, f"{shape.slide_ms} milliseconds") if shape.slide_ms else F.window("__ts", size)
    parts = rows.groupBy(*shape.group_columns, w.alias("__w")).agg(*_partials(shape))
    parts = parts.withColumn(LOW, F.unix_millis("__w.start")).withColumn(HIGH, F.unix_millis("__w.end")).drop("__w")
    return finish(parts, shape)


def stream_interval_join(left: DataFrame, right: DataFrame, shape: IntervalJoinShape, left_lag_ms: int, right_lag_ms: int) -> DataFrame:
    """The join with both watermarks; Spark derives from the bounds when a row's state goes."""
    a = left.withColumn("__lts", F.timestamp_millis(time_ms(left, shape.left_time))).withWatermark("__lts", f"{left_lag_ms} milliseconds")
    b = right.withColumn("__rts", F.timestamp_millis(time_ms(right, shape.right_time))).withWatermark("__rts", f"{right_lag_ms} milliseconds")
    base, other = ("__lts", "__rts") if shape.base_is_left else ("__rts", "__lts")
    on = F.col(f"`{shape.left_alias}`.`{shape.left_key}`") == F.col(f"`{shape.right_alias}`.`{shape.right_key}`")
    bound = lambda ms: f"interval '{abs(ms)}' milliseconds"
    low = F.expr(f"{base} {'+' if shape.lower_ms >= 0 else '-'} {bound(shape.lower_ms)}")
    high = F.expr(f"{base} {'+' if shape.upper_ms >= 0 else '-'} {bound(shape.upper_ms)}")
    joined = a.alias(shape.left_alias).join(b.alias(shape.right_alias), on & (F.col(other) >= low) & (F.col(other) <= high), "inner")
    if shape.where:
        joined = joined.where(shape.where)
    alias = {"left": shape.left_alias, "right": shape.right_alias}
    return joined.select(*[F.col(f"`{alias[c.side]}`.`{c.column}`").alias(c.alias) for c in shape.columns])


__all__ = ["stream_interval_join", "stream_windows"]
