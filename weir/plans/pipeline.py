"""A pipeline: configuration and statement, bound together, and the plans they run as.

The same statement becomes a bounded DataFrame (``run_batch``) or a streaming one
(``streaming_plan``); ``weir.streaming.runner`` moves either from inputs to the
output. Nothing here schedules anything: a plan is a DataFrame, and Catalyst
prunes, pushes down and picks joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import PipelineConfig, load_config
from ..errors import BindError, ConfigError, SqlError
from ..functions.units import memory_bytes
from ..operators.joins import interval_join, lookup_join
from ..operators.unions import union_all
from ..operators.windows import watermark_ms, window_aggregate
from ..sources import avro
from ..sources.decode import load_schema
from ..streaming.native import stream_interval_join, stream_windows
from .admission import admit
from .shapes import Branch, Statement
from .sqlfront import parse, table_select


def run_branch(branch: Branch, frames: dict[str, DataFrame]) -> DataFrame:
    """Filter, projection and limit over one input."""
    df = run_branch(branch.inner, frames) if branch.inner else frames[branch.source]
    df = df.alias(branch.alias) if branch.alias else df
    if branch.where:
        df = df.where(branch.where)
    df = df.selectExpr(*branch.items)
    return df.limit(branch.limit) if branch.limit is not None else df


def resolve(spec: str, folder: str | Path | None) -> Path:
    """A schema's file: a path as it stands, or a name in the schemas' folder."""
    if "/" in spec or spec.endswith((".json", ".avsc")):
        path = Path(spec)
        return path if path.is_absolute() or path.exists() or folder is None else Path(folder) / path.name
    if folder is None:
        raise ConfigError(f"'{spec}' is no path, and no folder of schemas was given")
    return Path(folder) / spec


@dataclass
class Pipeline:
    config: PipelineConfig
    statement: Statement
    schemas: dict[str, T.StructType]

    @classmethod
    def from_files(cls, config: str | Path, sql: str | Path, schemas_dir: str | Path | None = None) -> Pipeline:
        c = load_config(config)
        schemas = {}
        for i in c.inputs:
            if i.kind == "table" or not i.schema:
                continue
            schemas[i.name] = load_schema(resolve(i.schema, schemas_dir))
            if i.avro_schema:
                got = avro.spark_schema(resolve(i.avro_schema, schemas_dir).read_text(encoding="utf-8"))
                missing = [f.name for f in schemas[i.name] if f.name not in got.fieldNames()]
                if missing:
                    raise ConfigError(f"input '{i.name}': the Avro schema has no field '{missing[0]}'")
        return cls.build(c, Path(sql).read_text(encoding="utf-8"), schemas)

    @classmethod
    def build(cls, config: PipelineConfig, sql: str, schemas: dict[str, T.StructType] | None = None) -> Pipeline:
        pipeline = cls(config, parse(sql), schemas or {})
        pipeline.bind()
        return pipeline

    # --- binding -------------------------------------------------------------

    def bind(self) -> None:
        """Raise unless the statement's names are those of the configuration, in a shape that its inputs allow."""
        c, s = self.config, self.statement
        if s.target != c.output.name:
            raise BindError(f"the statement writes '{s.target}', the output is '{c.output.name}'")
        inputs, dims = {i.name for i in c.inputs}, {d.name for d in c.dimensions}
        for t in s.source_tables:
            if t not in inputs | dims:
                raise BindError(f"'{t}' is neither an input nor a dimension")
        unread = sorted((inputs | dims) - set(s.source_tables))
        if unread:
            raise BindError(f"the statement does not read '{unread[0]}'")
        if dims and s.kind != "lookup":
            raise BindError("a dimension is read by a lookup join only")
        tables = [i for i in c.inputs if i.kind == "table"]
        if s.kind == "general":
            raise SqlError(f"a pipeline can't run {s.why_batch_only}: use run_batch_sql for bounded tables")
        if s.kind == "lookup":
            self._bind_lookup(inputs, dims)
        if s.kind == "interval":
            self._bind_interval()
        if s.kind == "window":
            self._bind_window()
        if s.kind == "union" and tables:
            raise BindError("a union of tables stands under a window")
        if tables and c.output.topic is not None:
            table_select(s.select_sql)

    def _bind_lookup(self, inputs: set[str], dims: set[str]) -> None:
        l = self.statement.lookup  # noqa: E741
        if not dims:
            raise BindError("a join of two streams needs a BETWEEN of their times; an equality alone joins a dimension")
        if l.right in dims and l.left in inputs:
            key = l.right_key
        elif l.left in dims and l.right in inputs:
            if l.kind == "left":
                raise BindError("LEFT JOIN keeps the stream: the dimension stands on the right")
            key = l.left_key
        else:
            raise BindError("a lookup joins one input with one dimension")
        if key != self.config.dimensions[0].key:
            raise BindError(f"the dimension's key is '{self.config.dimensions[0].key}', the join uses '{key}'")

    def _bind_interval(self) -> None:
        j = self.statement.interval
        for side in ("left", "right"):
            i = self.config.input(getattr(j, side))
            if i.kind != "topic":
                raise BindError("an interval join is of two topics")
            if i.key != getattr(j, f"{side}_key"):
                raise BindError(f"input '{i.name}' has the key '{i.key}', the join uses '{getattr(j, f'{side}_key')}'")
            if i.watermark is None or i.watermark.column != getattr(j, f"{side}_time"):
                raise BindError(f"input '{i.name}': the join's time '{getattr(j, f'{side}_time')}' is not its watermark's column")
        if (self.config.deployment.consumers_per_topic or 1) != 1:
            raise BindError("an interval join takes one consumer a topic")

    def _bind_window(self) -> None:
        w = self.statement.window
        lags = set()
        for name in self.statement.source_tables:
            i = self.config.input(name)
            if i.watermark is None:
                raise BindError(f"input '{name}' declares no watermark")
            if i.watermark.column != w.event_time:
                raise BindError(f"input '{name}': the window's time '{w.event_time}' is not its watermark's column '{i.watermark.column}'")
            if i.key not in w.group_columns:
                raise BindError(f"GROUP BY does not have the key '{i.key}' of input '{name}'")
            lags.add(i.watermark.lag_ms)
        if len(lags) > 1:
            raise BindError("the inputs of a window have one lag")

    @property
    def lag_ms(self) -> int:
        return self.config.input(self.statement.source_tables[0]).watermark.lag_ms

    @property
    def idle_ms(self) -> int:
        return self.config.input(self.statement.source_tables[0]).watermark.idle_ms

    @property
    def budget(self) -> int | None:
        r = self.config.deployment.resources
        return memory_bytes(r.memory) if r and r.memory else None

    # --- plans ---------------------------------------------------------------

    def source(self, frames: dict[str, DataFrame]) -> DataFrame:
        """What a window reads: its input, or the union of its branches."""
        if self.statement.union:
            return union_all({b.source: run_branch(b, frames) for b in self.statement.union}, nullability=False)
        return frames[self.statement.window.source]

    def run_batch(self, frames: dict[str, DataFrame], *, closed: bool = False, partition: str | None = None) -> DataFrame:
        """The statement over bounded inputs. ``closed``: only windows that the inputs' watermark has passed."""
        s = self.statement
        if s.kind == "plain":
            return run_branch(s.plain, frames)
        if s.kind == "union":
            return union_all({b.source: run_branch(b, frames) for b in s.union}, nullability=False)
        if s.kind == "interval":
            return interval_join(frames[s.interval.left], frames[s.interval.right], s.interval)
        if s.kind == "lookup":
            return lookup_join(frames[s.lookup.left], frames[s.lookup.right], s.lookup, dimension=self.config.dimensions[0].name, budget=self.budget)
        rows, mark = self.source(frames), None
        if closed:
            if s.union:  # each branch is a partition of the clock
                marks = [watermark_ms(run_branch(b, frames), s.window.event_time, self.lag_ms) for b in s.union]
                mark = min((m for m in marks if m is not None), default=None)
            else:
                mark = watermark_ms(rows, s.window.event_time, self.lag_ms, partition)
            mark = -(1 << 62) if mark is None else mark
        return window_aggregate(rows, s.window, watermark=mark)

    def streaming_plan(self, streams: dict[str, DataFrame]) -> DataFrame:
        """The statement over streams, with Spark's own state; dimensions are joined by the runner."""
        s = self.statement
        if s.kind == "window":
            out = stream_windows(self.source(streams), s.window, self.lag_ms)
        elif s.kind == "interval":
            lags = [self.config.input(n).watermark.lag_ms for n in (s.interval.left, s.interval.right)]
            out = stream_interval_join(streams[s.interval.left], streams[s.interval.right], s.interval, *lags)
        elif s.kind == "union":
            out = union_all({b.source: run_branch(b, streams) for b in s.union})
        elif s.kind == "plain":
            out = run_branch(s.plain, streams)
        else:
            raise BindError("a lookup runs batch by batch")
        admit(out, s.kind)
        return out


def run_batch_sql(sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Any SELECT (or INSERT INTO .. SELECT ..) over bounded tables, as Spark runs it; window calls included."""
    text = sql if sql.lstrip()[:6].upper() == "INSERT" else f"INSERT INTO result {sql}"
    try:
        s = parse(text)
    except SqlError:
        s = None
    spark = next(iter(frames.values())).sparkSession
    if s is not None and s.kind == "window":
        rows = union_all({b.source: run_branch(b, frames) for b in s.union}, nullability=False) if s.union else frames[s.window.source]
        return window_aggregate(rows, s.window)
    if s is not None and s.kind == "interval":
        return interval_join(frames[s.interval.left], frames[s.interval.right], s.interval)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    select = s.select_sql if s is not None else sql.strip().rstrip(";")
    return spark.sql(select)
