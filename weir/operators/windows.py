"""Event-time windows over DataFrames: TUMBLE, HOP and SESSION.

Every window goes through partial results that can be merged: a row for each key
and pane first (combined before the shuffle), then windows from panes. A HOP of
many overlapping windows therefore repeats panes, not rows, and a SESSION sorts
panes of one gap's width, of which a hot key has few, instead of its rows: two
events in one pane are less than a gap apart, so they are always in one session.

Times are 64-bit milliseconds. A row without a key or without a time belongs to
no window. A session ends at its last event, and the next one begins when a full
gap has passed (at exactly the gap the sessions are two).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import BindError
from ..plans.shapes import Aggregate, WindowShape

TIME, LOW, HIGH = "__t", "__low", "__high"


def time_ms(df: DataFrame, column: str) -> Column:
    """The column as milliseconds; whole numbers are taken as such."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.LongType | T.IntegerType):
        return F.col(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column)) / 1000).cast("long")
    raise BindError(f"'{column}' is {kind.simpleString()}, not a time: whole milliseconds or a timestamp")


def _finite(value: Column) -> Column:
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("an aggregate's argument is not a finite number"))).otherwise(value)


def _argument(df: DataFrame, a: Aggregate) -> Column:
    value = F.expr(a.argument)
    kind = df.select(value.alias("x")).schema["x"].dataType
    if a.function == "COUNT":
        return value.isNotNull()
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return value.cast("long")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return _finite(value.cast("double"))
    raise BindError(f"{a.function}({a.argument}) is over {kind.simpleString()}; a whole or floating number is needed")


def prepare(df: DataFrame, shape: WindowShape, *keep: str) -> DataFrame:
    """Only what the window needs: group columns, time, arguments, and the columns named in ``keep``."""
    if shape.where:
        df = df.where(shape.where)
    for c in (*shape.group_columns, shape.event_time):
        if c not in df.columns:
            raise BindError(f"the window's column '{c}' is not in its input")
    inputs = [_argument(df, a).alias(f"__a{i}") for i, a in enumerate(shape.aggregates) if a.argument is not None]
    rows = df.select(*[F.col(c) for c in shape.group_columns], *[F.col(c) for c in keep], time_ms(df, shape.event_time).alias(TIME), *inputs)
    for c in (*shape.group_columns, TIME):
        rows = rows.where(F.col(c).isNotNull())
    return rows


def _partials(shape: WindowShape) -> list[Column]:
    out = []
    for i, a in enumerate(shape.aggregates):
        x = F.col(f"__a{i}")
        if a.function == "COUNT":
            out.append((F.count("*") if a.argument is None else F.count_if(x)).alias(f"__p{i}"))
        elif a.function == "AVG":
            out += [F.sum(x.cast("double")).alias(f"__p{i}"), F.count(x).alias(f"__n{i}")]
        else:
            out.append({"SUM": F.sum, "MIN": F.min, "MAX": F.max}[a.function](x).alias(f"__p{i}"))
    return out


def merge_columns(shape: WindowShape) -> list[Column]:
    """Aggregates that put partial results together."""
    out = []
    for i, a in enumerate(shape.aggregates):
        put = {"MIN": F.min, "MAX": F.max}.get(a.function, F.sum)
        out.append(put(f"__p{i}").alias(f"__p{i}"))
        if a.function == "AVG":
            out.append(F.sum(f"__n{i}").alias(f"__n{i}"))
    return out


def partial_windows(rows: DataFrame, shape: WindowShape) -> DataFrame:
    """Partial results of prepared rows: key, ``__low``, ``__high`` (a session's first and last event), partials."""
    keys = list(shape.group_columns)
    if shape.kind == "session":
        pane = F.col(TIME) - F.pmod(F.col(TIME), F.lit(shape.size_ms))
        panes = rows.groupBy(*keys, pane.alias("__pane")).agg(F.min(TIME).alias(LOW), F.max(TIME).alias(HIGH), *_partials(shape))
        return merge_sessions(panes.drop("__pane"), shape)
    step = shape.slide_ms or shape.size_ms
    start = F.col(TIME) - F.pmod(F.col(TIME), F.lit(step))
    panes = rows.groupBy(*keys, start.alias(LOW)).agg(*_partials(shape))
    many = shape.size_ms // step
    if many > 1:
        moved = F.explode(F.array(*[F.col(LOW) - i * step for i in range(many)])).alias("__start")
        parts = [c for c in panes.columns if c.startswith(("__p", "__n"))]
        spread = panes.select(*keys, moved, *parts).withColumnRenamed("__start", LOW)
        panes = spread.groupBy(*keys, LOW).agg(*merge_columns(shape))
    return panes.withColumn(HIGH, F.col(LOW) + shape.size_ms)


def merge_windows(parts: DataFrame, shape: WindowShape) -> DataFrame:
    """Put the partial results of equal windows (or touching sessions) together."""
    if shape.kind == "session":
        return merge_sessions(parts, shape)
    return parts.groupBy(*shape.group_columns, LOW, HIGH).agg(*merge_columns(shape))


def merge_sessions(parts: DataFrame, shape: WindowShape) -> DataFrame:
    """Sessions from parts of sessions: a part belongs to the one before it if less than a gap lies between."""
    keys = list(shape.group_columns)
    order = Window.partitionBy(*keys).orderBy(LOW, HIGH)
    before = F.max(HIGH).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(LOW) - before >= shape.size_ms), 1).otherwise(0)
    numbered = parts.withColumn("__fresh", fresh).withColumn("__s", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "__s").agg(F.min(LOW).alias(LOW), F.max(HIGH).alias(HIGH), *merge_columns(shape))
    return merged.drop("__s")


def close_at(shape: WindowShape) -> Column:
    """The watermark at which a window closes."""
    return F.col(HIGH) + shape.size_ms if shape.kind == "session" else F.col(HIGH)


def finish(parts: DataFrame, shape: WindowShape) -> DataFrame:
    """Group columns, ``window_start``, ``window_end``, aggregates, sums of aggregates."""
    out = parts
    for i, a in enumerate(shape.aggregates):
        value = F.col(f"__p{i}")
        if a.function == "AVG":
            value = F.when(F.col(f"__n{i}") > 0, value / F.col(f"__n{i}"))
        if a.fill is not None:
            whole = isinstance(parts.schema[f"__p{i}"].dataType, T.LongType) and a.function != "AVG"
            if whole and not a.fill.lstrip("-").isdigit():
                raise BindError(f"COALESCE fills the whole number '{a.alias}' with {a.fill}")
            value = F.coalesce(value, F.expr(a.fill).cast("long" if whole else "double"))
        out = out.withColumn(f"__f{i}", value)
    final = {a.alias: F.col(f"__f{i}") for i, a in enumerate(shape.aggregates)}
    sums = []
    for d in shape.derived:
        total = final[d.terms[0]]
        for t in d.terms[1:]:
            total = total + final[t]
        sums.append(total.alias(d.alias))
    return out.select(
        *shape.group_columns, F.col(LOW).alias("window_start"), F.col(HIGH).alias("window_end"), *[c.alias(n) for n, c in final.items()], *sums
    )


def watermark_ms(df: DataFrame, time_column: str, lag_ms: int, partition: str | None = None) -> int | None:
    """The least, over the partitions, of their latest times, minus the lag; None without any time."""
    latest = F.max(time_ms(df, time_column)).alias("t")
    tops = df.groupBy(partition).agg(latest) if partition else df.agg(latest)
    least = tops.agg(F.min("t").alias("t")).first()["t"]
    return None if least is None else least - lag_ms


def window_aggregate(df: DataFrame, shape: WindowShape, *, watermark: int | None = None) -> DataFrame:
    """All windows of a bounded input; with ``watermark``, only those it closes."""
    parts = partial_windows(prepare(df, shape), shape)
    if watermark is not None:
        parts = parts.where(close_at(shape) <= watermark)
    return finish(parts, shape)
