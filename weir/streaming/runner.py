"""Moves a pipeline from its inputs to its output, one micro-batch or snapshot after another.

A micro-batch is committed to a keyed table under its number, so one that runs
again after a failure changes nothing. Topics and queues get it at least once.
Tables are read snapshot by snapshot; where the reading stands is saved with what
was written from it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import Input
from ..errors import BindError, ConfigError, TableError
from ..functions.units import duration_ms
from ..operators.convert import convert, match_columns
from ..operators.joins import check_dimension, lookup_join
from ..operators.unions import union_all
from ..plans.pipeline import Pipeline, run_branch
from ..plans.sqlfront import table_select
from ..sources import avro, queues, topics
from ..sources.decode import decode_json, encode_json
from ..sources.files import Files
from ..sources.registry import Registry
from ..sources.tables import KeyedTable
from .metrics import Metrics
from .strict import PARTITION, StrictWindow


class Runner:
    def __init__(self, spark: SparkSession, pipeline: Pipeline, checkpoint: str, *, clock: str = "strict", metrics: Metrics | None = None, avro_schemas: dict[str, str] | None = None, convert_to: dict[str, T.StructType] | None = None):
        if clock not in ("strict", "native"):
            raise ConfigError("the clock is strict or native")
        self.spark, self.pipeline, self.checkpoint, self.clock = spark, pipeline, checkpoint.rstrip("/"), clock
        self.config, self.metrics = pipeline.config, metrics or Metrics(pipeline.config.pipeline.name)
        self.avro_schemas, self.convert_to = avro_schemas or {}, convert_to or {}
        self.writer = f"{self.config.pipeline.name}-v{self.config.pipeline.version}"
        self.client_options: dict[str, str] = {}  # besides region and endpoint
        self._schema_id: int | None = None
        self._checked: int | None = None
        self._claim()
        self.now: Callable[[], int] = lambda: int(time.time() * 1000)

    def _claim(self) -> None:
        """Mark the checkpoint folder as this pipeline's; one of another pipeline is refused."""
        s, out = self.pipeline.statement, self.config.output
        inputs = [[i.name, i.kind, getattr(i, i.kind)] for i in self.config.inputs]
        own = json.dumps({"writer": self.writer, "kind": s.kind, "sql": s.select_sql, "inputs": inputs, "output": [out.kind, getattr(out, out.kind)]}, sort_keys=True)
        files, path = Files(self.spark), f"{self.checkpoint}/pipeline.json"
        if not files.publish(path, own) and files.read(path) != own:
            raise TableError(f"the checkpoint at {self.checkpoint} is another pipeline's, or of another version of this one")

    @property
    def folder(self) -> str | None:
        """The root of folder topics."""
        return topics.folder_of(self.config.connectors.redpanda.brokers) if self.config.connectors.redpanda else None

    @property
    def registry_url(self) -> str | None:
        r = self.config.connectors.schema_registry
        return r.url if r else None

    # --- ends ----------------------------------------------------------------

    def table_path(self, name: str) -> str:
        database, _, table = name.rpartition(".")
        return f"{self.config.connectors.paimon.warehouse.rstrip('/')}/{database or 'default'}.db/{table}"

    def output_table(self) -> KeyedTable:
        return KeyedTable(self.spark, self.table_path(self.config.output.table))

    def decode(self, raw: DataFrame, i: Input) -> DataFrame:
        """Columns of an input's messages, and its partition."""
        keep = raw.select(F.col("partition").alias(PARTITION), "value")
        if i.format == "avro":
            wrapped = not i.avro_schema  # a schema from a file: bare datums
            schema, url = self.avro_schemas.get(i.name), self.registry_url if wrapped else None
            if schema is None and url is not None:
                found = Registry(url).latest(i.topic)
                schema = found[1] if found else None
            if schema is None:
                raise ConfigError(f"input '{i.name}' needs its Avro schema")
            value = F.unbase64(F.col("value").cast("string")) if i.kind == "topic" and self.folder is not None else F.col("value")
            rows = keep.select(PARTITION, avro.decode_column(value, schema, wrapped=wrapped, registry=url).alias("r")).select(PARTITION, "r.*")
        else:
            rows = decode_json(keep, self.pipeline.schemas[i.name], keep=(PARTITION,))
        if i.convert_to:
            target = self.convert_to.get(i.convert_to)
            if target is None:
                raise ConfigError(f"input '{i.name}': the schema '{i.convert_to}' is not known")
            both = T.StructType([rows.schema[PARTITION], *target])
            rows = convert(rows, both, match_columns(rows.schema, both))
        return rows

    def stream(self, i: Input, files_per_trigger: int | None) -> DataFrame:
        if i.kind == "topic":
            return self.decode(topics.read_topic_stream(self.spark, self.config, i, files_per_trigger=files_per_trigger), i)
        queues.register(self.spark)
        own = getattr(self.config.connectors, i.kind)
        options = {"region": own.region, "endpoint": own.endpoint, "start_from": i.start_from, "receive_wait": i.receive_wait, "commit_interval": self.config.deployment.commit_interval}
        options["stream" if i.kind == "kinesis" else "queue"] = getattr(i, i.kind)
        raw = self.spark.readStream.format(f"weir_{i.kind}").options(**{k: v for k, v in options.items() if v is not None}).load()
        return self.decode(raw, i)

    def write(self, rows: DataFrame, number: int, progress: object = None) -> None:
        """One micro-batch to the output."""
        out, began = self.config.output, time.time_ns()
        if out.kind == "table":
            table = self.output_table()
            done = table.commit(rows, writer=self.writer, identifier=number, progress=progress)
            if done is not None:
                self.metrics.add("rows_written", table.rows_of(done))
        elif out.kind == "topic":
            root = self.folder
            messages = self.messages(rows)
            if root is not None and self.config.output.format == "avro":
                messages = messages.withColumn("value", F.base64("value"))  # lines of text
            if root is not None:
                # a marker a batch: one that was written is not written again
                files, marker = Files(self.spark), f"{root}/{out.topic}-written/{self.writer}-{number}.json"
                done = None if files.exists(marker) else (topics.write_topic(messages, root, out.topic, self.config.deployment.partitions), files.publish(marker, "{}"))
            else:
                done = messages.write.format("kafka").option("kafka.bootstrap.servers", ",".join(self.config.connectors.redpanda.brokers)).option("topic", out.topic).save()
        else:
            service, own = out.kind, getattr(self.config.connectors, out.kind)
            options = {"region": own.region, "endpoint": own.endpoint, "stream" if service == "kinesis" else "queue": getattr(out, service)} | self.client_options
            messages = self.messages(rows)
            send = queues.QueueWriter(service, options)
            messages.select("key", "value").foreachPartition(lambda part: send.write(part) and None)
            done = True
        self.metrics.add("write_ns", time.time_ns() - began)
        if done is not None:
            self.metrics.add("commits")

    def messages(self, rows: DataFrame) -> DataFrame:
        """``key, value`` of the output's messages."""
        if self.config.output.format == "avro":
            key = self.config.output.key
            schema = avro.avro_schema(rows.schema)
            if self._schema_id is None:
                self._schema_id = Registry(self.registry_url).register(self.config.output.topic, schema)
            own = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"the key '{key}' is null")).cast("string")).otherwise(F.col(key).cast("string"))
            return rows.select(own.alias("key"), avro.encode_column(rows.columns, schema, number=self._schema_id).alias("value"))
        return encode_json(rows, self.config.output.key)

    # --- streams -------------------------------------------------------------

    def start(self, *, available_now: bool = False, files_per_trigger: int | None = None) -> StreamingQuery:
        """Run over topics and queues; ``available_now`` ends when what is there has been read."""
        if any(i.kind == "table" for i in self.config.inputs):
            raise BindError("tables are read by run_snapshots")
        s = self.pipeline.statement
        frames = {i.name: self.stream(i, files_per_trigger) for i in self.config.inputs}
        strict = s.kind == "window" and (self.clock == "strict" or s.window.kind == "session")
        if strict:
            if s.union:
                parts = {b.source: run_branch(b, frames) for b in s.union}
                union_all(parts, nullability=False)
                tagged = [df.withColumn(PARTITION, F.lit(n)) for n, df in parts.items()]
                plan = tagged[0]
                for t in tagged[1:]:
                    plan = plan.union(t)
            else:
                plan = frames[s.window.source]
            operator = StrictWindow(self.spark, f"{self.checkpoint}/windows", s.window, self.pipeline.lag_ms, self.pipeline.idle_ms)

            def each(rows: DataFrame, number: int) -> None:
                self.write(operator.apply(rows, number, now_ms=self.now()), number)

        elif s.kind == "lookup":
            plan = frames[self.config.inputs[0].name].drop(PARTITION)

            def each(rows: DataFrame, number: int) -> None:
                self.write(self.lookup(rows), number)

        else:
            plan = self.pipeline.streaming_plan({n: df.drop(PARTITION) for n, df in frames.items()})

            def each(rows: DataFrame, number: int) -> None:
                self.write(rows, number)

        writer = plan.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.checkpoint}/stream").outputMode("append")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{duration_ms(self.config.deployment.commit_interval)} milliseconds")
        return writer.start()

    def lookup(self, rows: DataFrame) -> DataFrame:
        """A micro-batch joined with the dimension as it is now."""
        s, d = self.pipeline.statement.lookup, self.config.dimensions[0]
        table = KeyedTable(self.spark, self.table_path(d.table))
        number = table.latest_id()
        dimension = table.read(number)
        if self._checked != number:  # once a snapshot
            check_dimension(dimension, d.key, d.name)
            self._checked = number
        frames = {d.name: dimension, self.config.inputs[0].name: rows}
        return lookup_join(frames[s.left], frames[s.right], s, dimension=d.name, budget=self.pipeline.budget, checked=True)

    # --- tables --------------------------------------------------------------

    def run_snapshots(self, limit: int | None = None) -> int:
        """Read the input tables' snapshots that are there, one (of each) at a time; how many turns were taken.

        Where reading stands is saved with each commit. A turn without output saves
        nothing, so it is read again after a restart, from a state that is as old.
        """
        s, c = self.pipeline.statement, self.config
        inputs = {i.name: KeyedTable(self.spark, self.table_path(i.table)) for i in c.inputs}
        number, cursor = self._position(list(inputs))
        operator, turns = None, 0
        if s.kind == "window":
            operator = StrictWindow(self.spark, f"{self.checkpoint}/windows", s.window, self.pipeline.lag_ms, None, keep=1_000_000)
        while limit is None or turns < limit:
            found = {n: t.next_append(cursor[n], changelog=c.output.topic is not None and t.spec.changelog == "input") for n, t in inputs.items()}
            if not any(found.values()):
                break
            number, turns = number + 1, turns + 1
            frames = {n: f[1] if f else inputs[n].read(0) for n, f in found.items()}
            cursor = cursor | {n: f[0] for n, f in found.items() if f}
            if operator is not None:
                if s.union:
                    tagged = [run_branch(b, frames).withColumn(PARTITION, F.lit(b.source)) for b in s.union]
                    rows = tagged[0]
                    for t in tagged[1:]:
                        rows = rows.union(t)
                    backlog = frozenset(b.source for b in s.union)
                else:
                    rows, backlog = frames[s.window.source], frozenset()
                out = operator.apply(rows, number, now_ms=self.now(), backlog=backlog)
            elif c.output.topic is not None:
                wanted = table_select(s.select_sql)
                rows = next(iter(frames.values()))
                names = [n for n in rows.columns] if wanted.columns is None else list(wanted.columns)
                if wanted.columns is not None and "rowkind" in rows.columns and "rowkind" not in names:
                    names = ["rowkind", *names]
                out = rows.select(*names)
            else:
                out = run_branch(s.plain, frames)
            self.write(out, number, {"cursor": cursor})
            if c.output.topic is not None:
                Files(self.spark).publish(f"{self.checkpoint}/cursor/{number}.json", str(next(iter(cursor.values()))))
        return turns

    def _position(self, names: list[str]) -> tuple[int, dict[str, int]]:
        """(number of the last turn that was committed, snapshot of each input then)."""
        start = {n: 0 for n in names}
        if self.config.output.topic is not None:
            files = Files(self.spark)
            done = [int(n[:-5]) for n in files.names(f"{self.checkpoint}/cursor") if n[:-5].isdigit()]
            if not done:
                return -1, start
            return max(done), {names[0]: int(files.read(f"{self.checkpoint}/cursor/{max(done)}.json"))}
        last = self.output_table().snapshot()
        if self.writer not in last.writers:
            return -1, start
        return last.writers[self.writer], dict(last.progress.get(self.writer, {}).get("cursor", start))
