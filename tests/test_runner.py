from __future__ import annotations

import urllib.request

import pytest
from pyspark.sql import types as T

from weir.__main__ import main
from weir.config import parse_config
from weir.errors import BindError, ConfigError, TableError
from weir.plans.pipeline import Pipeline
from weir.queries import config_text
from weir.sources.tables import KeyedTable, TableSpec
from weir.streaming.metrics import Listener, Metrics, serve
from weir.streaming.runner import Runner

LONG = T.LongType()


def schema(*names):
    return T.StructType([T.StructField(n.rstrip("$"), T.StringType() if n.endswith("$") else LONG) for n in names])


@pytest.fixture
def world(spark, tmp_path):
    """Topics, a warehouse and a checkpoint in a folder."""

    class World:
        root = f"file://{tmp_path}"
        n = 0

        def put(self, topic, *rows, partition=0):
            folder = tmp_path / "topics" / topic / f"partition={partition}"
            folder.mkdir(parents=True, exist_ok=True)
            World.n += 1
            (folder / f"{World.n:05d}.txt").write_text("\n".join(rows) + "\n")

        def table(self, name, schema, key, **options):
            return KeyedTable.create(spark, f"{self.root}/lake/default.db/{name}", TableSpec(schema, key, **options))

        def runner(self, sql, key, inputs, schemas=None, text=None, **options):
            base = text or config_text("o", key, inputs, lag=options.pop("lag", "1s"), dimension=options.pop("dimension", None), root=f"{self.root}/topics", warehouse=f"{self.root}/lake")
            for old, new in options.pop("swap", ()):
                base = base.replace(old, new)
            return Runner(spark, Pipeline.build(parse_config(base), sql, schemas or {}), f"{self.root}/checkpoint", **options)

        def run(self, runner):
            runner.start(available_now=True).awaitTermination()

    return World()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_and_restart(world):
    t = world.table("o", schema("id", "v"), ("id",), sequence_field="v")
    sql = "INSERT INTO o SELECT id, v FROM a WHERE v > 0"
    make = lambda: world.runner(sql, "id", {"a": None}, {"a": schema("id", "v")})
    world.put("a", '{"id": 1, "v": 5}', '{"id": 2, "v": -1}')
    world.run(make())
    world.put("a", '{"id": 1, "v": 3}', '{"id": 3, "v": 1}')
    world.run(make())
    world.run(make())
    assert rows(t.read()) == [(1, 5), (3, 1)]
    assert t.latest_id() == 2


def test_checkpoint_of_another_pipeline(world):
    world.table("o", schema("id", "v"), ("id",))
    world.runner("INSERT INTO o SELECT id, v FROM a", "id", {"a": None}, {"a": schema("id", "v")})
    world.runner("INSERT INTO o SELECT id, v FROM a", "id", {"a": None}, {"a": schema("id", "v")})
    with pytest.raises(TableError, match="another"):
        world.runner("INSERT INTO o SELECT id, v + 1 AS v FROM a", "id", {"a": None}, {"a": schema("id", "v")})


def test_bad_message_commits_nothing(world):
    t = world.table("o", schema("id", "v"), ("id",))
    world.put("a", '{"id": 1, "v": 5}', "garbage")
    with pytest.raises(Exception):  # noqa: B017
        world.run(world.runner("INSERT INTO o SELECT id, v FROM a", "id", {"a": None}, {"a": schema("id", "v")}))
    assert t.latest_id() == 0


def test_strict_windows_over_restarts(world):
    t = world.table("o", schema("k", "window_start", "window_end", "n", "s"), ("k", "window_start"))
    sql = "INSERT INTO o SELECT k, COUNT(*) AS n, SUM(v) AS s FROM a GROUP BY k, TUMBLE(t, INTERVAL '1' SECOND)"
    make = lambda: world.runner(sql, "k", {"a": "t"}, {"a": schema("k", "t", "v")})
    world.put("a", '{"k": 1, "t": 1500, "v": 10}')
    world.run(make())
    world.put("a", '{"k": 1, "t": 1900, "v": 1}', '{"k": 1, "t": 3100, "v": 7}')
    world.run(make())
    world.put("a", '{"k": 1, "t": 1999, "v": 100}')  # late
    world.run(make())
    world.put("a", '{"k": 1, "t": 9000, "v": 0}')
    world.run(make())
    assert rows(t.read()) == [(1, 1000, 2000, 2, 11), (1, 3000, 4000, 1, 7)]


def test_strict_sessions_stream(world):
    t = world.table("o", schema("k", "window_start", "window_end", "n"), ("k", "window_start"))
    sql = "INSERT INTO o SELECT k, COUNT(*) AS n FROM a GROUP BY k, SESSION(t, INTERVAL '5' SECOND)"
    world.put("a", *[f'{{"k": 1, "t": {x}}}' for x in (0, 4000, 9000, 20000)])
    world.run(world.runner(sql, "k", {"a": "t"}, {"a": schema("k", "t")}, clock="native"))
    assert rows(t.read()) == [(1, 0, 4000, 2), (1, 9000, 9000, 1)]


def test_native_windows(world):
    t = world.table("o", schema("k", "window_start", "window_end", "n"), ("k", "window_start"))
    sql = "INSERT INTO o SELECT k, COUNT(*) AS n FROM a GROUP BY k, HOP(t, INTERVAL '5' SECOND, INTERVAL '10' SECOND)"
    world.put("a", '{"k": 1, "t": 12000}')
    world.put("a", '{"k": 1, "t": 60000}')
    r = world.runner(sql, "k", {"a": "t"}, {"a": schema("k", "t")}, clock="native")
    r.start(available_now=True, files_per_trigger=1).awaitTermination()
    assert rows(t.read()) == [(1, 10000, 20000, 1), (1, 5000, 15000, 1)]


def test_union_of_topics(world):
    t = world.table("o", schema("id", "v"), ("id",))
    sql = "INSERT INTO o SELECT id, v FROM web WHERE v > 15 UNION ALL SELECT id, v FROM app"
    world.put("web", '{"id": 1, "v": 10}', '{"id": 2, "v": 20}')
    world.put("app", '{"id": 3, "v": 1}')
    world.run(world.runner(sql, "id", {"web": None, "app": None}, {n: schema("id", "v") for n in ("web", "app")}))
    assert rows(t.read()) == [(2, 20), (3, 1)]


def test_window_over_a_union_of_topics(world):
    t = world.table("o", schema("k", "window_start", "window_end", "n"), ("k", "window_start"))
    sql = "INSERT INTO o SELECT k, COUNT(*) AS n FROM (SELECT k, t FROM a UNION ALL SELECT k, t FROM b) GROUP BY k, TUMBLE(t, INTERVAL '1' SECOND)"
    world.put("a", '{"k": 1, "t": 100}', '{"k": 1, "t": 9000}')
    world.put("b", '{"k": 1, "t": 200}', '{"k": 1, "t": 2500}')
    world.run(world.runner(sql, "k", {"a": "t", "b": "t"}, {n: schema("k", "t") for n in ("a", "b")}))
    assert rows(t.read()) == [(1, 0, 1000, 2)]  # the slower branch holds the clock at 1500


def test_lookup_sees_the_dimension_of_each_batch(world):
    t = world.table("o", schema("id", "name$"), ("id",))
    d = world.table("dim", schema("cid", "name$"), ("cid",))
    make = lambda: world.runner("INSERT INTO o SELECT f.id, d.name FROM f LEFT JOIN dim d ON f.cid = d.cid", "id", {"f": None}, {"f": schema("id", "cid")}, dimension=("dim", "cid"))
    spark = d.spark
    d.commit(spark.createDataFrame([(7, "old")], d.spec.schema))
    world.put("f", '{"id": 1, "cid": 7}')
    world.run(make())
    d.commit(spark.createDataFrame([(7, "new")], d.spec.schema))
    world.put("f", '{"id": 2, "cid": 7}', '{"id": 3, "cid": 8}')
    world.run(make())
    assert rows(t.read()) == [(1, "old"), (2, "new"), (3, None)]


def test_topic_to_topic(world, tmp_path):
    text = config_text("o", "id", {"a": None}, root=f"{world.root}/topics", warehouse="/x").replace("table: o, key: id, bucket: 1", "topic: o, key: id")
    world.put("a", '{"id": 1, "v": 5}')
    r = world.runner("INSERT INTO o SELECT id, v + 1 AS w FROM a", "id", {"a": None}, {"a": schema("id", "v")}, text=text)
    world.run(r)
    world.run(r)
    got = [p.read_text() for p in (tmp_path / "topics" / "o").rglob("*.txt")]
    assert "".join(got) == '{"id":1,"w":6}\n'


def test_queue_output(world, tmp_path):
    (tmp_path / "q").mkdir()
    text = config_text("o", "id", {"a": None}, root=f"{world.root}/topics").replace("table: o, key: id, bucket: 1", "sqs: o, key: id").replace("connectors:", f"connectors:\n  sqs: {{region: x, endpoint: '{tmp_path}/q'}}")
    world.put("a", '{"id": 1}', '{"id": 2}')
    r = world.runner("INSERT INTO o SELECT id FROM a", "id", {"a": None}, {"a": schema("id")}, text=text)
    r.client_options = {"client": "tests.fakes:client"}
    world.run(r)
    assert sorted(__import__("json").loads((tmp_path / "q" / "sent.json").read_text())) == ['{"id":1}', '{"id":2}']


def test_schema_conversion_of_an_input(world):
    t = world.table("o", schema("id", "n"), ("id",))
    world.put("a", '{"ID": "1", "n": 2}')
    source = T.StructType([T.StructField("ID", T.StringType()), T.StructField("n", T.IntegerType())])
    target = schema("id", "n")
    r = world.runner("INSERT INTO o SELECT id, n FROM a", "id", {"a": None}, {"a": source}, swap=[("schema: x.json", "schema: x.json, convert_to: common")], convert_to={"common": target})
    world.run(r)
    assert rows(t.read()) == [(1, 2)]
    with pytest.raises(ConfigError, match="not known"):
        world.run(world.runner("INSERT INTO o SELECT id, n FROM a", "id", {"a": None}, {"a": source}, swap=[("schema: x.json", "schema: x.json, convert_to: other")]))


TABLES = """
pipeline: {{name: t}}
connectors: {{redpanda: {{brokers: ['{root}/topics']}}, paimon: {{warehouse: '{root}/lake'}}}}
inputs:
{inputs}
output: {{name: o, {output}, key: k}}
deployment: {{partitions: 1}}
"""


def tables(world, sql, names, output="table: o, bucket: 1", time=None):
    mark = f", watermark: {{column: {time}, lag: 1s}}" if time else ""
    inputs = "\n".join(f"  - {{name: {n}, table: {n}, key: k{mark}}}" for n in names)
    return world.runner(sql, "k", {}, text=TABLES.format(root=world.root, inputs=inputs, output=output))


def test_table_to_table(world):
    a, t = world.table("a", schema("k", "v"), ("k",)), world.table("o", schema("k", "w"), ("k",))
    spark = a.spark
    a.commit(spark.createDataFrame([(1, 5), (2, -5)], a.spec.schema))
    a.commit(spark.createDataFrame([(3, 7)], a.spec.schema))
    make = lambda: tables(world, "INSERT INTO o SELECT k, v + 1 AS w FROM a WHERE v > 0", ["a"])
    assert make().run_snapshots() == 2
    assert rows(t.read()) == [(1, 6), (3, 8)]
    assert make().run_snapshots() == 0
    a.commit(spark.createDataFrame([(4, -1)], a.spec.schema))  # no rows out: the turn is taken again
    assert make().run_snapshots() == 1 and make().run_snapshots() == 1
    a.commit(spark.createDataFrame([(5, 1)], a.spec.schema))
    assert make().run_snapshots() == 2 and make().run_snapshots() == 0
    assert rows(t.read()) == [(1, 6), (3, 8), (5, 2)]
    with pytest.raises(BindError):
        make().start()


def test_window_over_a_table(world):
    a, t = world.table("a", schema("k", "t", "id"), ("id",)), world.table("o", schema("k", "window_start", "window_end", "n"), ("k", "window_start"))
    make = lambda: tables(world, "INSERT INTO o SELECT k, COUNT(*) AS n FROM a GROUP BY k, TUMBLE(t, INTERVAL '1' SECOND)", ["a"], time="t")
    for i, ts in enumerate(((100, 200), (1_500,), (2_500,), (9_000,))):
        a.commit(a.spark.createDataFrame([(1, x, 10 * i + j) for j, x in enumerate(ts)], a.spec.schema))
        make().run_snapshots()
    assert rows(t.read()) == [(1, 0, 1000, 2), (1, 1000, 2000, 1), (1, 2000, 3000, 1)]


def test_window_over_a_union_of_tables(world):
    names = ["a", "b"]
    ts = {n: world.table(n, schema("k", "t"), ("k", "t")) for n in names}
    t = world.table("o", schema("k", "window_start", "window_end", "n"), ("k", "window_start"))
    sql = "INSERT INTO o SELECT k, COUNT(*) AS n FROM (SELECT k, t FROM a UNION ALL SELECT k, t FROM b) GROUP BY k, TUMBLE(t, INTERVAL '1' SECOND)"
    ts["a"].commit(ts["a"].spark.createDataFrame([(1, 100), (1, 30_000)], "k long, t long"))
    assert tables(world, sql, names, time="t").run_snapshots() == 1
    assert rows(t.read()) == []  # nothing of b yet
    ts["b"].commit(ts["b"].spark.createDataFrame([(1, 500), (1, 2_000)], "k long, t long"))
    tables(world, sql, names, time="t").run_snapshots()
    assert rows(t.read()) == [(1, 0, 1000, 2)]


def test_table_to_topic(world, tmp_path):
    a = world.table("a", schema("k", "v"), ("k",))
    a.commit(a.spark.createDataFrame([(1, 5)], a.spec.schema))
    make = lambda: tables(world, "INSERT INTO o SELECT k, v FROM a", ["a"], output="topic: o")
    assert make().run_snapshots() == 1 and make().run_snapshots() == 0
    a.commit(a.spark.createDataFrame([(2, 6)], a.spec.schema))
    assert make().run_snapshots() == 1
    got = sorted("".join(p.read_text() for p in (tmp_path / "topics" / "o").rglob("*.txt")).split())
    assert got == ['{"k":1,"v":5}', '{"k":2,"v":6}']


def test_streams_refuse_what_needs_all_rows(world):
    from weir.errors import SqlError

    with pytest.raises(SqlError):
        world.runner("INSERT INTO o SELECT DISTINCT id FROM a", "id", {"a": None})


def test_metrics(spark, world):
    m = Metrics("p")
    listener = Listener(m)
    spark.streams.addListener(listener)
    try:
        world.table("o", schema("id"), ("id",))
        world.put("a", '{"id": 1}', '{"id": 2}')
        world.run(world.runner("INSERT INTO o SELECT id FROM a", "id", {"a": None}, {"a": schema("id")}, metrics=m))
        for _ in range(50):
            if m.values["rows_read"]:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert m.values["rows_read"] == 2 and m.values["commits"] == 1 and m.values["rows_written"] == 2
    server = serve(m, "127.0.0.1:0")
    try:
        text = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics").read().decode()
    finally:
        server.shutdown()
    assert 'weir_rows_read{pipeline="p"} 2' in text and "weir_consumer_lag" in text


def test_cli(tmp_path, capsys):
    (tmp_path / "p.yaml").write_text(config_text("o", "id", {"a": None}, schema="a.json"))
    (tmp_path / "p.sql").write_text("INSERT INTO o SELECT id FROM a")
    (tmp_path / "a.json").write_text('[{"name": "id", "type": "Int64"}]')
    base = ["--config", str(tmp_path / "p.yaml"), "--sql", str(tmp_path / "p.sql"), "--schemas-dir", str(tmp_path)]
    assert main([*base, "--check"]) == 0
    assert "plain: a -> o" in capsys.readouterr().out
    assert main(base) == 1
    (tmp_path / "p.sql").write_text("SELECT 1")
    assert main([*base, "--check"]) == 1
    assert "error" in capsys.readouterr().err
    assert main(["--config", str(tmp_path / "p.yaml"), "--compact", "--compact-min-files", "1"]) == 1
