"""Windows under a strict event-time clock, epoch by epoch.

The clock is the least, over the active partitions, of the latest event time,
minus the lag, and never goes back. A row older than the clock is dropped even if
its window is open. Each epoch is judged by the clock that the one before left;
then the clock moves and windows that it passed are closed.

State is a table of partial results in a folder that all machines share, a version
an epoch: an epoch reads the version before it, merges its own partial results
(aggregations with combining, so a hot key is no single row's work) and writes the
next version. Open and closed windows are two filters on that version. Running an
epoch again reads the same version and gives the same result, so the output
table's identifier makes the whole exactly-once. Only the partitions' clocks (a
few numbers) pass through the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TableError
from ..operators.windows import HIGH, LOW, TIME, close_at, finish, merge_windows, partial_windows, prepare
from ..plans.shapes import WindowShape
from ..sources.files import Files

PARTITION = "__partition"


@dataclass
class Clock:
    """Latest event time and wall-clock time of the last on-time row of each partition, and the watermark."""

    latest: dict[str, int] = field(default_factory=dict)
    active: dict[str, int] = field(default_factory=dict)
    watermark: int | None = None

    def advance(self, lag_ms: int, idle_ms: int | None, now_ms: int, backlog: frozenset[str] = frozenset()) -> None:
        """Move the watermark. Partitions in ``backlog`` are never idle, and hold it while nothing of them was seen."""
        if any(p not in self.latest for p in backlog):
            return
        awake = [t for p, t in self.latest.items() if idle_ms is None or p in backlog or now_ms - self.active[p] < idle_ms]
        if awake:
            new = min(awake) - lag_ms
            self.watermark = new if self.watermark is None else max(self.watermark, new)


class StrictWindow:
    """One window query's operator; ``path`` is its state folder."""

    def __init__(self, spark: SparkSession, path: str, shape: WindowShape, lag_ms: int, idle_ms: int | None = None, keep: int = 2):
        self.spark, self.path, self.shape, self.lag_ms, self.idle_ms, self.keep = spark, path.rstrip("/"), shape, lag_ms, idle_ms, keep
        self.files = Files(spark)
        spec = json.dumps([asdict(shape), lag_ms], sort_keys=True)
        if not self.files.publish(f"{self.path}/spec.json", spec) and self.files.read(f"{self.path}/spec.json") != spec:
            raise TableError(f"the state at {path} is of another query")

    def _version(self, epoch: int) -> int | None:
        """The last version before ``epoch``."""
        done = [int(n[:-5]) for n in self.files.names(self.path) if n.endswith(".json") and n[:-5].isdigit()]
        return max((n for n in done if n < epoch), default=None)

    def clock(self, epoch: int) -> Clock:
        """The clock that ``epoch`` left."""
        raw = json.loads(self.files.read(f"{self.path}/{epoch}.json"))
        return Clock(**raw["clock"])

    def apply(self, rows: DataFrame, epoch: int, *, now_ms: int = 0, backlog: frozenset[str] = frozenset()) -> DataFrame:
        """The windows that ``epoch`` closes. ``rows`` may have a column ``__partition``; without it all are one's."""
        before = self._version(epoch)
        clock = self.clock(before) if before is not None else Clock()
        if PARTITION not in rows.columns:
            rows = rows.withColumn(PARTITION, F.lit("0"))
        own = prepare(rows.withColumn(PARTITION, F.col(PARTITION).cast("string")), self.shape, PARTITION)
        if clock.watermark is not None:
            own = own.where(F.col(TIME) >= clock.watermark)
        parts = partial_windows(own.drop(PARTITION), self.shape)
        if before is not None:
            held = self.spark.read.parquet(f"{self.path}/v{before}")
            if clock.watermark is not None:
                held = held.where(close_at(self.shape) > clock.watermark)
            parts = merge_windows(held.unionByName(parts), self.shape)
        target = f"{self.path}/v{epoch}"
        self.files.delete(f"{self.path}/{epoch}.json")
        parts.write.mode("overwrite").parquet(target)
        for r in own.groupBy(PARTITION).agg(F.max(TIME).alias("t")).collect():  # a row a partition
            p = r[PARTITION]
            clock.latest[p] = max(clock.latest.get(p, r["t"]), r["t"])
            clock.active[p] = now_ms
        clock.advance(self.lag_ms, self.idle_ms, now_ms, backlog)
        self.files.publish(f"{self.path}/{epoch}.json", json.dumps({"clock": asdict(clock)}))
        self._forget(epoch)
        written = self.spark.read.schema(parts.schema).parquet(target)
        closed = written.where(close_at(self.shape) <= clock.watermark) if clock.watermark is not None else written.limit(0)
        return finish(closed, self.shape)

    def open_windows(self, epoch: int) -> DataFrame:
        """Key, start and end of the windows that are open after ``epoch``."""
        held, mark = self.spark.read.parquet(f"{self.path}/v{epoch}"), self.clock(epoch).watermark
        held = held.where(close_at(self.shape) > mark) if mark is not None else held
        return held.select(*self.shape.group_columns, F.col(LOW).alias("window_start"), F.col(HIGH).alias("window_end"))

    def _forget(self, epoch: int) -> None:
        for n in self.files.names(self.path):
            number = n[1:] if n.startswith("v") else n.removesuffix(".json")
            if number.isdigit() and int(number) < epoch - self.keep:
                self.files.delete(f"{self.path}/{n}")
