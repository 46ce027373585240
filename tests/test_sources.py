from __future__ import annotations

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.config import parse_config
from weir.errors import ConfigError, DataError
from weir.queries import config_text
from weir.sources import avro, queues, topics
from weir.sources.decode import declared_schema, decode_json, encode_json

SCHEMA = declared_schema('[{"name": "id", "type": "Int64", "nullable": false}, {"name": "s", "type": "Utf8"}, {"name": "x", "type": "Float64"}, {"name": "b", "type": "Boolean"}, {"name": "i", "type": "Int32"}]')


def decode(spark, *values, strict=True):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return [tuple(r) for r in decode_json(df, SCHEMA, strict=strict).collect()]


def test_declared_schema():
    assert SCHEMA.simpleString() == "struct<id:bigint,s:string,x:double,b:boolean,i:int>"
    assert not SCHEMA["id"].nullable
    for bad in ("{}", "[]", '[{"name": "a", "type": "Decimal"}]', '[{"type": "Int64"}]', '[{"name": "a", "type": "Int64"}, {"name": "a", "type": "Utf8"}]'):
        with pytest.raises(ConfigError):
            declared_schema(bad)


def test_json_reads(spark):
    assert decode(spark, '{"id": 1, "s": "a", "x": 2, "b": true, "i": 3}') == [(1, "a", 2.0, True, 3)]
    assert decode(spark, ' {"id": 1, "s": null, "more": {"s": [1]}} \n') == [(1, None, None, None, None)]
    assert decode(spark, '{"id": 1, "id": 2, "s": "x", "s": "y"}') == [(2, "y", None, None, None)]


@pytest.mark.parametrize("bad", ['{"id": 1.0}', '{"id": 1e3}', '{"id": "7"}', '{"id": 99999999999999999999}', '{"id": 1, "b": 1}', "[1]", "x", '{"id": 1} tail', '{"id": 1, "s": 7}', '{"id": 1, "s": {}}', '{"s": "no id"}', '{"id": 1, "i": 3000000000}'])
def test_json_refuses(spark, bad):
    with pytest.raises(Exception):  # noqa: B017
        decode(spark, bad)


def test_encode_json(spark):
    df = spark.createDataFrame([(1, None, 2.5, True)], "id long, s string, x double, b boolean")
    assert tuple(encode_json(df, "id").first()) == ("1", '{"id":1,"s":null,"x":2.5,"b":true}')
    with pytest.raises(Exception, match="is null"):
        encode_json(spark.createDataFrame([(None,)], "id long"), "id").collect()
    with pytest.raises(Exception, match="finite"):
        encode_json(spark.createDataFrame([(1, float("nan"))], "id long, x double"), "id").collect()
    with pytest.raises(ConfigError):
        encode_json(spark.sql("SELECT 1L AS id, current_date() AS d"), "id")
    with pytest.raises(ConfigError):
        encode_json(spark.sql("SELECT 1.5D AS id"), "id")


AVRO = json.dumps({"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "x", "type": ["double", "null"]}, {"name": "b", "type": "boolean"}, {"name": "f", "type": "float"}, {"name": "i", "type": "int"}]})


@settings(max_examples=100, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.none() | st.text(), st.none() | st.floats(allow_nan=False), st.booleans(), st.integers(-(2**31), 2**31 - 1))
def test_avro_round_trip(n, s, x, b, i):
    wanted = avro.fields(AVRO)
    row = (n, s, x, b, 0.5, i)
    assert avro.read_datum(avro.write_datum(row, wanted), wanted) == row


def test_avro_refuses():
    wanted = avro.fields(AVRO)
    good = avro.write_datum((1, "a", 2.0, True, 0.5, 3), wanted)
    for bad in (good[:-1], good + b"\0", b"", b"\xff" * 12):
        with pytest.raises(DataError):
            avro.read_datum(bad, wanted)
    with pytest.raises(DataError):
        avro.write_datum((None, "a", 2.0, True, 0.5, 3), wanted)
    with pytest.raises(DataError):
        avro.unwrap(b"\1abcd")
    for kind in (["null", "string", "long"], {"type": "array", "items": "long"}, "fixed"):
        with pytest.raises(ConfigError):
            avro.fields(json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": kind}]}))


def test_avro_columns(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True), (2**53 + 1, None, None, False)], "id long, s string, x double, b boolean")
    schema = avro.avro_schema(df.schema)
    data = df.select(avro.encode_column(df.columns, schema, number=9).alias("v"))
    assert avro.unwrap(bytes(data.first()["v"]))[0] == 9
    out = data.select(avro.decode_column(F.col("v"), schema, wrapped=True).alias("r")).select("r.*")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_avro_writer_schema_and_compatibility(spark):
    old = json.dumps({"type": "record", "name": "r", "fields": [{"name": "gone", "type": "long"}, {"name": "id", "type": "long"}]})
    new = json.dumps({"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"], "default": None}]})
    avro.check_backward(new, old)
    for bad in ([{"name": "id", "type": "string"}], [{"name": "id", "type": "long"}, {"name": "s", "type": "string"}]):
        with pytest.raises(ConfigError):
            avro.check_backward(json.dumps({"type": "record", "name": "r", "fields": bad}), old)
    message = avro.wrap(3, avro.write_datum((7, 8), avro.fields(old)))
    df = spark.createDataFrame([(bytearray(message),)], "v binary")
    out = df.select(avro.decode_column(F.col("v"), new, wrapped=True, writers={3: old}).alias("r")).select("r.*")
    assert tuple(out.first()) == (8, None)


def test_kafka_options():
    c = parse_config(config_text("o", "id", {"a": None}).replace("/topics", "b1:9092"))
    options = topics.kafka_options(c, c.inputs[0], 500)
    assert options["subscribe"] == "a" and options["startingOffsets"] == "earliest" and options["kafka.isolation.level"] == "read_committed" and options["maxOffsetsPerTrigger"] == "500"
    assert topics.folder_of(["b1:9092"]) is None and topics.folder_of(["file:///x/"]) == "file:///x"


def test_topic_partitions_are_counted(spark, tmp_path):
    c = parse_config(config_text("o", "id", {"a": None}, root=f"file://{tmp_path}"))
    with pytest.raises(ConfigError, match="0 partitions"):
        topics.read_topic_stream(spark, c, c.inputs[0])


@pytest.fixture
def service(tmp_path):
    def write(**files):
        for name, rows in files.items():
            (tmp_path / f"{name}.json").write_text(json.dumps(rows))
        return {"client": "tests.fakes:client", "endpoint": str(tmp_path), "stream": "s", "queue": "q"}

    return write


def test_kinesis_reads_shards(service):
    r = queues.KinesisReader(service(shard0=["a", "b", "c"], shard1=["d"]) | {"start_from": "trim_horizon"})
    start = r.initialOffset()
    end = r.latestOffset()
    assert end == {"shards": {"shard0": "2", "shard1": "0"}}
    got = [row for p in r.partitions(start, end) for row in r.read(p)]
    assert sorted(bytes(x[3]) for x in got) == [b"a", b"b", b"c", b"d"]
    assert r.partitions(end, r.latestOffset()) == []
    service(shard0=["a", "b", "c", "e"], shard2=["child"])  # more records, and a child shard
    later = r.latestOffset()
    got = [row for p in r.partitions(end, later) for row in r.read(p)]
    assert sorted(bytes(x[3]) for x in got) == [b"child", b"e"]


def test_kinesis_latest(service):
    r = queues.KinesisReader(service(shard0=["a", "b"]))
    start = r.initialOffset()
    assert start == {"shards": {"shard0": "1"}}
    service(shard0=["a", "b", "c"])
    assert [bytes(x[3]) for p in r.partitions(start, r.latestOffset()) for x in r.read(p)] == [b"c"]
    with pytest.raises(ConfigError):
        queues.KinesisReader({"stream": "s", "start_from": "now"})


def test_sqs_deletes_after_the_commit(service, tmp_path):
    r = queues.SqsReader(service(queue=[f"m{i}" for i in range(23)]))
    rows, end = r.read(r.initialOffset())
    assert len(list(rows)) == 23 and end == {"count": 23}
    assert not os.path.exists(tmp_path / "deleted.json")
    assert len(list(r.readBetweenOffsets({"count": 0}, end))) == 23
    r.commit(end)
    assert len(json.loads((tmp_path / "deleted.json").read_text())) == 23
    assert r.read(end)[1] == end


def test_send_tries_what_failed_again():
    seen = []

    def put(batch):
        seen.append(list(batch))
        return [0] if len(seen) == 1 else []

    queues.send([("k", str(i)) for i in range(5)], 3, put)
    assert [len(b) for b in seen] == [3, 1, 2]
    with pytest.raises(DataError, match="3 times"):
        queues.send([("k", "v")], 3, lambda b: list(range(len(b))))


def test_queue_writers(service, tmp_path):
    options = service()
    queues.QueueWriter("kinesis", options).write(iter([{"key": "a", "value": "1"}, {"key": "b", "value": "2"}]))
    assert sorted(json.loads((tmp_path / "sent.json").read_text())) == [["a", "1"], ["b", "2"]]
    (tmp_path / "sent.json").unlink()
    queues.QueueWriter("sqs", options).write(iter([{"key": "a", "value": str(i)} for i in range(12)]))
    assert len(json.loads((tmp_path / "sent.json").read_text())) == 12


def test_streams_from_queues(spark, service):
    queues.register(spark)
    options = service(shard0=["a", "b", "c"], queue=["x", "y"])
    for name in ("weir_kinesis", "weir_sqs"):
        rows = spark.readStream.format(name).options(**options, start_from="trim_horizon").load().select(F.col("value").cast("string").alias("v"))
        q = rows.writeStream.format("memory").queryName(name).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert sorted(r["v"] for r in spark.sql("SELECT v FROM weir_kinesis").collect()) == ["a", "b", "c"]
    assert sorted(r["v"] for r in spark.sql("SELECT v FROM weir_sqs").collect()) == ["x", "y"]


def test_types(spark):
    assert avro.spark_schema(AVRO)["f"].dataType == T.DoubleType()


def test_avro_keeps_large_numbers_beside_nulls(spark):
    schema = '{"type":"record","name":"r","fields":[{"name":"a","type":["null","long"]},{"name":"b","type":["null","double"]}]}'
    rows = [(2**53 + 1, 0.5), (None, 1.0), (-(2**63), None), (2**63 - 1, -0.0)]
    df = spark.createDataFrame(rows, "a long, b double").coalesce(1)
    back = df.select(avro.decode_column(avro.encode_column(["a", "b"], schema), schema).alias("x")).select("x.*")
    assert [tuple(r) for r in back.collect()] == rows
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="not finite"):
            spark.createDataFrame([(1, bad)], "a long, b double").select(avro.encode_column(["a", "b"], schema)).collect()
