from __future__ import annotations

import pytest

from weir.config import parse_config
from weir.errors import AlignmentError, ConfigError, KeyMismatchError, SqlError
from weir.functions.units import cpu_cores, duration_ms, interval_ms, memory_bytes


@pytest.mark.parametrize(("raw", "ms"), [("250ms", 250), ("5s", 5_000), ("2m", 120_000), ("5h", 18_000_000), ("1d", 86_400_000), (" 1s ", 1000)])
def test_durations(raw, ms):
    assert duration_ms(raw) == ms


@pytest.mark.parametrize("raw", ["", "5", "0s", "-1s", "1.5s", "5 s", "5w", "s", "99999999999999999999d", "9223372036854775807s"])
def test_bad_durations(raw):
    with pytest.raises(ConfigError):
        duration_ms(raw)


@pytest.mark.parametrize(("raw", "n"), [("1024", 1024), ("512Mi", 512 << 20), ("4G", 4 * 10**9), ("1ki", 1024), ("2Ti", 2 << 40), ("3K", 3000)])
def test_memory(raw, n):
    assert memory_bytes(raw) == n


@pytest.mark.parametrize("raw", ["", "Mi", "0", "1.5G", "-1", "4X", "99999999999T"])
def test_bad_memory(raw):
    with pytest.raises(ConfigError):
        memory_bytes(raw)


@pytest.mark.parametrize(("raw", "n"), [("4", 4), ("1.5", 2), ("500m", 1), ("2500m", 3), ("0.1", 1)])
def test_cpu(raw, n):
    assert cpu_cores(raw) == n


@pytest.mark.parametrize("raw", ["", "x", "0", "-1", "nan", "inf", "m"])
def test_bad_cpu(raw):
    with pytest.raises(ConfigError):
        cpu_cores(raw)


def test_intervals():
    assert interval_ms("1", "DAY") == 86_400_000
    assert interval_ms("250", "milliseconds") == 250
    for number, unit in (("0", "SECOND"), ("1", "MONTH"), ("1.5", "HOUR"), ("-1", "HOUR")):
        with pytest.raises(SqlError):
            interval_ms(number, unit)


BASE = """
pipeline: {name: orders}
connectors:
  redpanda: {brokers: [localhost:9092]}
  paimon: {warehouse: /lake}
  schema_registry: {url: http://registry}
  kinesis: {region: us-east-1}
  sqs: {region: us-east-1}
inputs:
  - {name: orders, topic: orders, key: id, schema: orders.json}
output: {name: lake, table: lake, key: id, bucket: 4, sequence_field: version}
deployment: {partitions: 4}
"""
TABLES = """
pipeline: {name: t}
connectors: {redpanda: {brokers: [b]}, paimon: {warehouse: /lake}}
inputs:
  - {name: a, table: db.a, key: id}
output: {name: o, table: o, key: id, bucket: 1}
deployment: {partitions: 1}
"""


def test_a_configuration():
    c = parse_config(BASE)
    assert c.pipeline.version == 1
    assert c.output.kind == "table"
    assert c.inputs[0].kind == "topic"
    assert c.deployment.commit_interval == "10s"
    assert parse_config(BASE.replace("redpanda:", "kafka:").replace("paimon:", "warehouse:")).connectors.redpanda.brokers == ["localhost:9092"]


def test_watermark_idle_is_the_lag_by_default():
    c = parse_config(BASE.replace("schema: orders.json", "schema: orders.json, watermark: {column: t, lag: 10s}"))
    assert (c.inputs[0].watermark.lag_ms, c.inputs[0].watermark.idle_ms) == (10_000, 10_000)
    c = parse_config(BASE.replace("schema: orders.json", "schema: orders.json, watermark: {column: t, lag: 10s, idle: 1m}"))
    assert c.inputs[0].watermark.idle_ms == 60_000


@pytest.mark.parametrize(
    ("old", "new", "why"),
    [
        ("table: lake,", "table: lake, topic: x,", "exactly one"),
        ("table: lake, ", "", "exactly one"),
        ("table: lake,", "table: ' ',", "empty"),
        ("bucket: 4, ", "", "bucket is required"),
        ("paimon: {warehouse: /lake}", "paimon: {warehouse: ' '}", "warehouse"),
        ("table: lake, key: id, bucket: 4, sequence_field: version", "topic: x, key: id, bucket: 4", "belongs to a table"),
        ("table: lake, key: id, bucket: 4, sequence_field: version", "topic: x, key: id, sequence_field: v", "belong to a table"),
        ("table: lake, key: id, bucket: 4, sequence_field: version", "topic: '', key: id", "empty"),
        ("sequence_field: version", "format: avro", "publishes a topic"),
        ("topic: orders, key", "topic: orders, table: x, key", "one source"),
        ("topic: orders, key", "key", "one source"),
        ("schema: orders.json", "schema: orders.json, start_from: latest", "kinesis only"),
        ("schema: orders.json", "schema: orders.json, receive_wait: 5s", "sqs only"),
        ("schema: orders.json", "schema: orders.json, avro_schema: x.avsc", "format: avro"),
        (", schema: orders.json", "", "requires schema"),
        (", schema: orders.json", ", format: avro, avro_schema: x.avsc", "together"),
        ("topic: orders", "kinesis: s, format: avro", "together"),
        ("topic: orders, key: id, schema: orders.json", "kinesis: s, key: id, format: avro", "brings its schema"),
        ("topic: orders", "sqs: q, receive_wait: soon", "duration"),
        ("  kinesis: {region: us-east-1}\n", "", None),
        ("partitions: 4", "partitions: 4, batch_size: 0", "1 or more"),
        ("partitions: 4", "partitions: 4, resources: {cpu: none}", "cpu"),
        ("partitions: 4", "partitions: 4, commit_interval: 5x", "duration"),
        ("  redpanda: {brokers: [localhost:9092]}\n", "", "brokers"),
        ("inputs:", "dimensions: [{name: d, table: d, key: k}]\ninputs:", "memory"),
        ("inputs:", "dimensions: [{name: orders, table: d, key: k}]\ninputs:", "name of an input"),
        ("inputs:", "dimensions: [{name: d, table: d, key: k}, {name: e, table: e, key: k}]\ninputs:", "one dimension"),
        ("inputs:", "dimensions: [{name: d, table: '', key: k}]\ninputs:", "needs name"),
        ("pipeline: {name: orders}", "pipeline: {}", "name"),
        ("partitions: 4", "partitions: many", "whole number"),
    ],
)
def test_rules(old, new, why):
    assert old in BASE
    text = BASE.replace(old, new, 1)
    if why is None:
        parse_config(text)
        return
    with pytest.raises(ConfigError, match=why):
        parse_config(text)


def test_alignment_and_key():
    with pytest.raises(AlignmentError):
        parse_config(BASE.replace("bucket: 4", "bucket: 3"))
    with pytest.raises(KeyMismatchError):
        parse_config(BASE.replace("topic: orders, key: id", "topic: orders, key: other"))


def test_kinesis_needs_its_connector():
    text = BASE.replace("  kinesis: {region: us-east-1}\n", "").replace("topic: orders", "kinesis: s")
    with pytest.raises(ConfigError, match="connectors.kinesis"):
        parse_config(text)
    with pytest.raises(ConfigError, match="topic inputs only"):
        parse_config(BASE.replace("topic: orders", "kinesis: s").replace("table: lake, key: id, bucket: 4, sequence_field: version", "topic: x, key: id"))


def test_table_inputs():
    parse_config(TABLES)
    two = TABLES.replace("key: id}\noutput", "key: id, watermark: {column: t, lag: 1s}}\n  - {name: b, table: b, key: id, watermark: {column: t, lag: 1s}}\noutput")
    parse_config(two)
    for old, new, why in (
        ("key: id}\n", "key: id, schema: x}\n", "brings its schema"),
        ("key: id}\n", "key: id, format: avro}\n", "not decoded"),
        ("partitions: 1", "partitions: 1, consumers_per_topic: 2", "one cursor"),
        ("key: id}\n", "key: id}\n  - {name: c, topic: c, key: id, schema: s}\n", "by itself"),
        ("bucket: 1}\ndeployment: {partitions: 1}", "bucket: 2}\ndeployment: {partitions: 2}", "one partition"),
    ):
        with pytest.raises(ConfigError, match=why):
            parse_config(TABLES.replace(old, new, 1))
    with pytest.raises(ConfigError, match="declares a watermark"):
        parse_config(TABLES.replace("key: id}\n", "key: id}\n  - {name: b, table: b, key: id}\n", 1))
    topic = TABLES.replace("table: o, key: id, bucket: 1", "topic: o, key: id")
    parse_config(topic)
    with pytest.raises(ConfigError, match="no watermark"):
        parse_config(topic.replace("key: id}\noutput", "key: id, watermark: {column: t, lag: 1s}}\noutput"))
    with pytest.raises(ConfigError, match="not a table's snapshots"):
        parse_config(TABLES.replace("inputs:", "dimensions: [{name: d, table: d, key: k}]\ninputs:"))


def test_not_yaml():
    for text in ("a: [", "[]", "x"):
        with pytest.raises(ConfigError):
            parse_config(text)
