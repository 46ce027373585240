"""The pipeline's YAML: what it may say, and the rules that its parts keep together.

Key names are those that existing pipeline files use (``redpanda``, ``paimon`` and
so on name connectors of other products); ``kafka`` and ``warehouse`` are accepted
for the first two as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints

import yaml

from .errors import AlignmentError, ConfigError, KeyMismatchError
from .functions.units import cpu_cores, duration_ms, memory_bytes

FORMATS = ("json", "avro")
STARTS = ("latest", "trim_horizon")


@dataclass
class Meta:
    name: str
    version: int = 1


@dataclass
class Brokers:
    brokers: list[str]
    group: str | None = None


@dataclass
class Warehouse:
    warehouse: str
    catalog: str | None = None
    catalog_uri: str | None = None


@dataclass
class Registry:
    url: str


@dataclass
class Aws:
    region: str
    endpoint: str | None = None


@dataclass
class Connectors:
    redpanda: Brokers | None = None
    paimon: Warehouse | None = None
    schema_registry: Registry | None = None
    sqs: Aws | None = None
    kinesis: Aws | None = None


@dataclass
class Watermark:
    column: str
    lag: str
    idle: str | None = None

    @property
    def lag_ms(self) -> int:
        return duration_ms(self.lag)

    @property
    def idle_ms(self) -> int:
        """Without ``idle`` a partition counts as idle after the lag."""
        return duration_ms(self.idle) if self.idle else self.lag_ms


@dataclass
class Input:
    name: str
    key: str
    topic: str | None = None
    table: str | None = None
    kinesis: str | None = None
    sqs: str | None = None
    start_from: str | None = None
    receive_wait: str | None = None
    schema: str | None = None
    format: str = "json"
    avro_schema: str | None = None
    watermark: Watermark | None = None
    convert_to: str | None = None

    @property
    def sources(self) -> list[str]:
        return [k for k in ("topic", "table", "kinesis", "sqs") if _text(getattr(self, k))]

    @property
    def kind(self) -> str:
        return next((k for k in ("table", "kinesis", "sqs") if _text(getattr(self, k))), "topic")


@dataclass
class Dimension:
    name: str
    table: str
    key: str


@dataclass
class Output:
    name: str
    key: str
    table: str | None = None
    topic: str | None = None
    kinesis: str | None = None
    sqs: str | None = None
    bucket: int | None = None
    sequence_field: str | None = None
    rowkind_field: str | None = None
    format: str = "json"

    @property
    def kind(self) -> str:
        return next(k for k in ("table", "topic", "kinesis", "sqs") if getattr(self, k) is not None)


@dataclass
class Resources:
    cpu: str | None = None
    memory: str | None = None


@dataclass
class Scaling:
    strategy: str = "partitions"
    min: int = 1
    max: int = 16


@dataclass
class State:
    checkpoint_interval: str | None = None
    checkpoint_storage: str | None = None
    checkpoint_retention: int | None = None


@dataclass
class Metrics:
    bind_addr: str = "127.0.0.1:0"
    otlp_endpoint: str | None = None
    otlp_interval: str | None = None
    service_name: str | None = None


@dataclass
class Deployment:
    partitions: int
    resources: Resources | None = None
    scaling: Scaling | None = None
    state: State | None = None
    commit_interval: str = "10s"
    metrics: Metrics | None = None
    consumers_per_topic: int | None = None
    batch_size: int | None = None
    decode_parallelism: int | None = None


@dataclass
class PipelineConfig:
    pipeline: Meta
    connectors: Connectors
    inputs: list[Input]
    output: Output
    deployment: Deployment
    dimensions: list[Dimension] = field(default_factory=list)

    def input(self, name: str) -> Input:
        return next(i for i in self.inputs if i.name == name)


def _text(value: str | None) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


ALIASES = {Connectors: {"kafka": "redpanda", "warehouse": "paimon"}}


def _build(kind: Any, value: Any, where: str) -> Any:
    """``value`` from YAML as ``kind``; errors name the place."""
    origin = get_origin(kind)
    if origin in (Union, UnionType):
        if value is None:
            return None
        return _build(next(a for a in get_args(kind) if a is not type(None)), value, where)
    if origin is list:
        if not isinstance(value, list):
            raise ConfigError(f"{where} must be a list")
        return [_build(get_args(kind)[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if hasattr(kind, "__dataclass_fields__"):
        if not isinstance(value, dict):
            raise ConfigError(f"{where or 'the file'} must be a mapping")
        names, hints = {f.name for f in fields(kind)}, get_type_hints(kind)
        given = {ALIASES.get(kind, {}).get(k, k): v for k, v in value.items()}
        made = {k: _build(hints[k], v, f"{where}.{k}".lstrip(".")) for k, v in given.items() if k in names}
        try:
            return kind(**made)
        except TypeError as e:
            raise ConfigError(f"{where or 'the file'}: {str(e).partition(') ')[2] or e}") from None
    if kind is int:
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ConfigError(f"{where} must be a whole number")
        return value
    if kind is str:
        if isinstance(value, dict | list) or value is None:
            raise ConfigError(f"{where} must be a text")
        return str(value)
    return value


def parse_config(text: str) -> PipelineConfig:
    """The configuration in a YAML text, checked by ``validate``."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from None
    config = _build(PipelineConfig, raw, "")
    validate(config)
    return config


def load_config(path: str | Path) -> PipelineConfig:
    return parse_config(Path(path).read_text(encoding="utf-8"))


def validate(c: PipelineConfig) -> None:
    """Raise for the first rule that the configuration breaks."""
    _validate_output(c)
    for i in c.inputs:
        _validate_input(c, i)
    kinds = [i.kind for i in c.inputs]
    if c.output.topic is not None and {"kinesis", "sqs"} & set(kinds):
        raise ConfigError("a topic output takes topic inputs only; kinesis and sqs publish a table")
    if ("topic" in kinds or c.output.topic is not None) and c.connectors.redpanda is None:
        raise ConfigError("a topic input or output requires connectors.redpanda.brokers")
    if "table" in kinds:
        _validate_table_inputs(c)
    _validate_dimensions(c)
    if c.deployment.resources and c.deployment.resources.cpu:
        cpu_cores(c.deployment.resources.cpu)
    duration_ms(c.deployment.commit_interval)
    for name in ("batch_size", "consumers_per_topic", "decode_parallelism"):
        if getattr(c.deployment, name) == 0:
            raise ConfigError(f"deployment.{name} must be 1 or more")


def _warehouse(c: PipelineConfig) -> str | None:
    return _text(c.connectors.paimon.warehouse) if c.connectors.paimon else None


def _registry(c: PipelineConfig) -> str | None:
    return _text(c.connectors.schema_registry.url) if c.connectors.schema_registry else None


def _validate_output(c: PipelineConfig) -> None:
    out = c.output
    given = [k for k in ("table", "topic", "kinesis", "sqs") if getattr(out, k) is not None]
    if len(given) != 1:
        raise ConfigError("the output needs exactly one of output.table, output.topic, output.kinesis or output.sqs")
    kind = given[0]
    if not _text(getattr(out, kind)):
        raise ConfigError(f"output.{kind} is empty")
    if out.format not in FORMATS:
        raise ConfigError(f"output.format '{out.format}' is not one of {', '.join(FORMATS)}")
    if kind == "table":
        if out.bucket is None:
            raise ConfigError("output.bucket is required when the output is a table")
        if out.bucket != c.deployment.partitions:
            raise AlignmentError(f"deployment.partitions is {c.deployment.partitions}, output.bucket is {out.bucket}")
        if not _warehouse(c):
            raise ConfigError("a table output requires connectors.paimon.warehouse")
    else:
        if out.bucket is not None:
            raise ConfigError("output.bucket belongs to a table; a topic, kinesis or sqs does not use it")
        if out.sequence_field is not None or out.rowkind_field is not None:
            raise ConfigError("sequence_field and rowkind_field belong to a table")
        if kind in ("kinesis", "sqs") and getattr(c.connectors, kind) is None:
            raise ConfigError(f"a {kind} output requires connectors.{kind}.region")
    if out.format == "avro":
        if kind != "topic":
            raise ConfigError("output format avro publishes a topic")
        if not _registry(c):
            raise ConfigError("output format avro requires connectors.schema_registry.url")


def _validate_input(c: PipelineConfig, i: Input) -> None:
    who = f"input '{i.name}'"
    if i.key != c.output.key:
        raise KeyMismatchError(f"{who} has key '{i.key}', the output has key '{c.output.key}'")
    if len(i.sources) != 1:
        raise ConfigError(f"{who} needs one source: topic, table, kinesis or sqs")
    if i.format not in FORMATS:
        raise ConfigError(f"{who}: format '{i.format}' is not one of {', '.join(FORMATS)}")
    if i.watermark:
        duration_ms(i.watermark.lag)
        if i.watermark.idle:
            duration_ms(i.watermark.idle)
    if i.kind == "table":
        if i.schema is not None or i.avro_schema is not None:
            raise ConfigError(f"{who}: a table brings its schema")
        if i.format != "json":
            raise ConfigError(f"{who}: a table is not decoded by a format")
        if i.watermark and c.output.table is None:
            raise ConfigError(f"{who}: a table that publishes a topic declares no watermark")
        return
    if i.kind in ("kinesis", "sqs") and getattr(c.connectors, i.kind) is None:
        raise ConfigError(f"{who}: {i.kind} requires connectors.{i.kind}.region")
    if i.kind == "sqs" and i.receive_wait is not None:
        duration_ms(i.receive_wait)
    if i.start_from is not None and i.kind != "kinesis":
        raise ConfigError(f"{who}: start_from is for kinesis only")
    if i.start_from is not None and i.start_from not in STARTS:
        raise ConfigError(f"{who}: start_from '{i.start_from}' is not one of {', '.join(STARTS)}")
    if i.receive_wait is not None and i.kind != "sqs":
        raise ConfigError(f"{who}: receive_wait is for sqs only")
    declared, avro = _text(i.schema), _text(i.avro_schema)
    if i.format == "json":
        if i.avro_schema is not None:
            raise ConfigError(f"{who}: avro_schema goes with format: avro only")
        if not declared:
            raise ConfigError(f"{who}: format json requires schema")
    elif bool(declared) != bool(avro):
        raise ConfigError(f"{who}: avro from a file takes schema and avro_schema together")
    elif not declared:
        if i.kind != "topic":
            raise ConfigError(f"{who}: avro from kinesis or sqs brings its schema in avro_schema")
        if not _registry(c):
            raise ConfigError(f"{who}: format avro without a file requires connectors.schema_registry.url")


def _validate_table_inputs(c: PipelineConfig) -> None:
    tables = [i for i in c.inputs if i.kind == "table"]
    if len(tables) != len(c.inputs):
        raise ConfigError("a table is read by itself: no other kind of input beside it")
    if len(tables) > 1 and c.output.table is None:
        raise ConfigError("several tables write a table")
    if c.output.table is None and c.output.topic is None:
        raise ConfigError("a table publishes a topic or writes another table")
    if c.output.table is not None and c.deployment.partitions != 1:
        raise ConfigError("reading tables to write another uses one partition: a snapshot is read whole")
    if len(tables) > 1:
        for i in tables:
            if i.watermark is None:
                raise ConfigError(f"input '{i.name}': a union of tables declares a watermark")
    if c.deployment.consumers_per_topic not in (None, 1):
        raise ConfigError("a table is read by one cursor, not by several consumers")
    if not _warehouse(c):
        raise ConfigError("reading a table requires connectors.paimon.warehouse")


def _validate_dimensions(c: PipelineConfig) -> None:
    if not c.dimensions:
        return
    if len(c.dimensions) > 1:
        raise ConfigError("a lookup joins one dimension")
    d = c.dimensions[0]
    if not (_text(d.name) and _text(d.table) and _text(d.key)):
        raise ConfigError("the dimension needs name, table and key")
    if any(i.name == d.name for i in c.inputs):
        raise ConfigError(f"the dimension '{d.name}' has the name of an input")
    if any(i.kind == "table" for i in c.inputs):
        raise ConfigError("a lookup enriches a stream, not a table's snapshots")
    if not _warehouse(c):
        raise ConfigError("a dimension requires connectors.paimon.warehouse")
    memory = c.deployment.resources.memory if c.deployment.resources else None
    if not _text(memory):
        raise ConfigError("a dimension needs deployment.resources.memory")
    memory_bytes(memory)
