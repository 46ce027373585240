from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import types as T

from weir.config import parse_config
from weir.errors import ConfigError
from weir.plans.pipeline import Pipeline
from weir.queries import config_text
from weir.sources import avro
from weir.sources.registry import Registry
from weir.sources.tables import KeyedTable, TableSpec
from weir.streaming.runner import Runner

RECORD = json.dumps({"type": "record", "name": "row", "fields": [{"name": "id", "type": "long"}, {"name": "v", "type": ["null", "long"]}]})


@pytest.fixture
def registry():
    subjects: dict[str, list[int]] = {}
    schemas: list[str] = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            parts = self.path.strip("/").split("/")
            if parts[0] == "schemas" and int(parts[2]) <= len(schemas):
                return self.answer(200, {"schema": schemas[int(parts[2]) - 1]})
            if parts[0] == "subjects" and subjects.get(parts[1]):
                n = subjects[parts[1]][-1]
                return self.answer(200, {"id": n, "schema": schemas[n - 1]})
            return self.answer(404, {})

        def do_POST(self):
            schema = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["schema"]
            if schema not in schemas:
                schemas.append(schema)
            subjects.setdefault(self.path.split("/")[2], []).append(schemas.index(schema) + 1)
            self.answer(200, {"id": schemas.index(schema) + 1})

        def do_PUT(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.answer(500 if "refused" in self.path else 200, {})

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Registry(f"http://127.0.0.1:{server.server_port}")
    server.shutdown()


def test_subjects(registry):
    assert registry.latest("t") is None
    assert registry.register("t", RECORD) == 1 and registry.latest("t") == (1, RECORD) and registry.schema(1) == RECORD
    with pytest.raises(ConfigError, match="no schema"):
        registry.schema(9)
    with pytest.raises(ConfigError, match="can't be read"):
        registry.register("t", RECORD.replace('"long"}', '"string"}', 1))
    with pytest.raises(ConfigError, match="refuses"):
        registry.register("refused", RECORD)
    with pytest.raises(ConfigError, match="reached"):
        Registry("http://127.0.0.1:1").latest("t")


def test_avro_topic_to_topic_to_table(spark, registry, tmp_path):
    root = f"file://{tmp_path}"
    base = lambda name, topic: config_text(name, "id", {topic: None}, root=f"{root}/topics", warehouse=f"{root}/lake").replace("connectors:", f"connectors:\n  schema_registry: {{url: '{registry.url}'}}")
    folder = tmp_path / "topics" / "a" / "partition=0"
    folder.mkdir(parents=True)
    (folder / "1.txt").write_text('{"id": 1, "v": 5}\n{"id": 2, "v": null}\n')
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.LongType())])
    text = base("b", "a").replace("table: b, key: id, bucket: 1", "topic: b, key: id, format: avro")
    first = Runner(spark, Pipeline.build(parse_config(text), "INSERT INTO b SELECT id, v + 1 AS w FROM a", {"a": schema}), f"{root}/c1")
    first.start(available_now=True).awaitTermination()
    assert [f["name"] for f in json.loads(registry.latest("b")[1])["fields"]] == ["id", "w"]

    t = KeyedTable.create(spark, f"{root}/lake/default.db/o", TableSpec(T.StructType([T.StructField("id", T.LongType()), T.StructField("w", T.LongType())]), ("id",)))
    text = base("o", "b").replace("schema: x.json", "format: avro")
    second = Runner(spark, Pipeline.build(parse_config(text), "INSERT INTO o SELECT id, w FROM b"), f"{root}/c2")
    second.start(available_now=True).awaitTermination()
    assert sorted(map(tuple, t.read().collect())) == [(1, 6), (2, None)]
    none = Runner(spark, Pipeline.build(parse_config(text.replace("topic: b", "topic: zz")), "INSERT INTO o SELECT id, w FROM b"), f"{root}/c3")
    (tmp_path / "topics" / "zz" / "partition=0").mkdir(parents=True)
    with pytest.raises(ConfigError, match="Avro schema"):
        none.start(available_now=True)
    assert avro.fields(RECORD)
