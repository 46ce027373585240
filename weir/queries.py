"""One query for each operator: the engine's plans over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import parse_config
from .operators.convert import convert
from .operators.unions import union_all
from .plans.pipeline import Pipeline, run_batch_sql
from .sources import avro, topics
from .sources.decode import decode_json, encode_json
from .sources.scratch import scratch_path
from .sources.tables import KeyedTable, TableSpec
from .streaming.runner import Runner
from .streaming.strict import StrictWindow

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def config_text(output: str, key: str, inputs: dict[str, str | None], *, lag: str = "1h", dimension: tuple[str, str] | None = None, root: str = "/topics", warehouse: str = "/warehouse", schema: str = "x.json") -> str:
    """YAML of a pipeline of topics; ``inputs`` maps names to their watermark's column."""
    lines = ["pipeline: {name: q}", "connectors:", f"  redpanda: {{brokers: ['{root}']}}", f"  paimon: {{warehouse: '{warehouse}'}}", "inputs:"]
    for name, time in inputs.items():
        mark = f", watermark: {{column: {time}, lag: {lag}}}" if time else ""
        lines.append(f"  - {{name: {name}, topic: {name}, key: {key}, schema: {schema}{mark}}}")
    if dimension:
        lines += ["dimensions:", f"  - {{name: {dimension[0]}, table: {dimension[0]}, key: {dimension[1]}}}"]
    lines += [f"output: {{name: {output}, table: {output}, key: {key}, bucket: 1}}", "deployment: {partitions: 1, resources: {memory: 512Mi}}"]
    return "\n".join(lines)


def batch(sql: str, key: str, frames: dict[str, DataFrame], times: dict[str, str] | None = None, *, lag: str = "1h", dimension: tuple[str, str] | None = None, **options) -> DataFrame:
    """The statement through configuration, front end, binding and planner."""
    inputs = {n: (times or {}).get(n) for n in frames if not dimension or n != dimension[0]}
    target = sql.split()[2]
    pipeline = Pipeline.build(parse_config(config_text(target, key, inputs, lag=lag, dimension=dimension)), sql)
    return pipeline.run_batch(frames, **options)


MS = "(epoch_us(ts) // 1000)"

# --- filter, project, union, convert ------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def etl_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INSERT INTO orders_lake SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'"
    return batch(sql, "o_orderkey", {"orders": table(spark, sf_dir, "orders")})


@query("""SELECT event_id, user_id, CASE WHEN value < 10 THEN 'low' WHEN value BETWEEN 10 AND 50 THEN 'mid' ELSE 'high' END AS band,
    value * 2 + 1 AS scaled, upper(event_type) AS kind FROM events WHERE value IS NOT NULL AND event_type <> 'error'""")
def project_expr_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """INSERT INTO bands SELECT event_id, user_id,
        CASE WHEN value < 10 THEN 'low' WHEN value BETWEEN 10 AND 50 THEN 'mid' ELSE 'high' END AS band,
        value * 2 + 1 AS scaled, upper(event_type) AS kind
        FROM events WHERE value IS NOT NULL AND event_type <> 'error'"""
    return batch(sql, "user_id", {"events": events(spark, sf_dir)})


@query("SELECT event_id, amount FROM (SELECT event_id, value + 1 AS amount, event_type FROM events WHERE value > 20) WHERE event_type <> 'view'")
def derived_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INSERT INTO o SELECT event_id, amount FROM (SELECT event_id, value + 1 AS amount, event_type FROM events WHERE value > 20) x WHERE event_type <> 'view'"
    return batch(sql, "event_id", {"events": events(spark, sf_dir)})


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 100)")
def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT is the feature; which rows it keeps is open, so they are counted."""
    rows = batch("INSERT INTO o SELECT o_orderkey FROM orders LIMIT 100", "o_orderkey", {"orders": table(spark, sf_dir, "orders")})
    return rows.agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, value FROM events WHERE event_type = 'click' AND value > 15
    UNION ALL SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT user_id, event_id, value FROM events WHERE event_type = 'signup'""")
def union_all_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    frames = {k: e.where(F.col("event_type") == k) for k in ("click", "purchase", "signup")}
    sql = "INSERT INTO o SELECT user_id, event_id, value FROM click WHERE value > 15 UNION ALL SELECT user_id, event_id, value FROM purchase UNION ALL SELECT user_id, event_id, value FROM signup"
    return batch(sql, "user_id", frames)


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS order_status, CAST(o_totalprice AS DOUBLE) AS total, CAST(o_custkey AS VARCHAR) AS customer
    FROM orders UNION ALL
    SELECT CAST(l_orderkey AS BIGINT), l_linestatus, CAST(l_linenumber AS DOUBLE), CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 1""")
def schema_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("order_status", T.StringType()), T.StructField("total", T.DoubleType()), T.StructField("customer", T.StringType())])
    a = convert(table(spark, sf_dir, "orders"), target, {"id": "o_orderkey", "order_status": "o_orderstatus", "total": "o_totalprice", "customer": "o_custkey"})
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    b = convert(lines, target, {"id": "l_orderkey", "order_status": "l_linestatus", "total": "l_linenumber", "customer": "l_suppkey"})
    return union_all({"orders": a, "lineitem": b})


# --- windows -------------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of floating numbers depend on their order; four places (of means eight) don't."""
    return df.withColumns({c: F.round(c, 8 if c == "mean" else 4) for c in columns})


@query(f"""SELECT user_id, {MS} - {MS} % 3600000 AS window_start, {MS} - {MS} % 3600000 + 3600000 AS window_end, count(*) AS n, count(value) AS n_value,
    round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 8) AS mean, CAST(sum(event_id) AS BIGINT) AS ids
    FROM events GROUP BY ALL""")
def tumble_1h_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """INSERT INTO o SELECT user_id, window_start, window_end, COUNT(*) AS n, COUNT(value) AS n_value, SUM(value) AS total, MIN(value) AS low,
        MAX(value) AS high, AVG(value) AS mean, SUM(event_id) AS ids FROM events GROUP BY user_id, TUMBLE(ts, INTERVAL '1' HOUR)"""
    return _rounded(batch(sql, "user_id", {"events": events(spark, sf_dir)}, {"events": "ts"}), "total", "mean")


@query(f"""SELECT event_type, {MS} - {MS} % 60000 AS window_start, {MS} - {MS} % 60000 + 60000 AS window_end, count(*) AS n FROM events
    WHERE value > 25 AND event_type <> 'view' GROUP BY ALL""")
def tumble_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INSERT INTO o SELECT event_type, COUNT(*) AS n FROM events WHERE value > 25 AND event_type <> 'view' GROUP BY event_type, TUMBLE(ts, INTERVAL '1' MINUTE)"
    return batch(sql, "event_type", {"events": events(spark, sf_dir)}, {"events": "ts"})


@query(f"""WITH e AS (SELECT event_type, value, {MS} AS t FROM events)
    SELECT event_type, t - t % 3600000 - k * 3600000 AS window_start, t - t % 3600000 - k * 3600000 + 21600000 AS window_end, count(*) AS n, round(sum(value), 4) AS total,
    min(value) AS low, max(value) AS high, round(avg(value), 8) AS mean FROM e, range(6) r(k) GROUP BY ALL""")
def hop_6h_1h_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """INSERT INTO o SELECT event_type, COUNT(*) AS n, SUM(value) AS total, MIN(value) AS low, MAX(value) AS high, AVG(value) AS mean
        FROM events GROUP BY event_type, HOP(ts, INTERVAL '1' HOUR, INTERVAL '6' HOUR)"""
    return _rounded(batch(sql, "event_type", {"events": events(spark, sf_dir)}, {"events": "ts"}), "total", "mean")


def _session_sql(gap: int, having: str = "") -> str:
    return f"""WITH e AS (SELECT user_id, value, {MS} AS t FROM events),
    f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < {gap} THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM f)
    SELECT user_id, min(t) AS window_start, max(t) AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s{having}"""


@query(_session_sql(1_800_000))
def session_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INSERT INTO o SELECT user_id, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY user_id, SESSION(ts, INTERVAL '30' MINUTE)"
    return _rounded(batch(sql, "user_id", {"events": events(spark, sf_dir)}, {"events": "ts"}), "total")


@query(_session_sql(43_200_000, f" HAVING max(t) + 43200000 <= (SELECT max({MS}) - 3600000 FROM events)"))
def session_closed_12h(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INSERT INTO o SELECT user_id, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY user_id, SESSION(ts, INTERVAL '12' HOUR)"
    return _rounded(batch(sql, "user_id", {"events": events(spark, sf_dir)}, {"events": "ts"}, closed=True), "total")


@query(f"""WITH m AS (SELECT max({MS}) - 86400000 AS mark FROM events)
    SELECT user_id, {MS} - {MS} % 3600000 AS window_start, {MS} - {MS} % 3600000 + 3600000 AS window_end, count(*) AS n FROM events, m
    WHERE {MS} - {MS} % 3600000 + 3600000 <= mark GROUP BY ALL""")
def tumble_closed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INSERT INTO o SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id, TUMBLE(ts, INTERVAL '1' HOUR)"
    return batch(sql, "user_id", {"events": events(spark, sf_dir)}, {"events": "ts"}, lag="1d", closed=True)


@query(f"""WITH p AS (SELECT event_type, max({MS}) AS t FROM events GROUP BY ALL), m AS (SELECT min(t) - 7200000 AS mark FROM p)
    SELECT user_id, {MS} - {MS} % 3600000 AS window_start, {MS} - {MS} % 3600000 + 3600000 AS window_end, count(*) AS n FROM events, m
    WHERE {MS} - {MS} % 3600000 + 3600000 <= mark GROUP BY ALL""")
def tumble_closed_min_of_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INSERT INTO o SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id, TUMBLE(ts, INTERVAL '1' HOUR)"
    return batch(sql, "user_id", {"events": events(spark, sf_dir)}, {"events": "ts"}, lag="2h", closed=True, partition="event_type")


PIVOT = """MAX(CASE WHEN event_type = 'click' THEN value END) AS click_value,
    COALESCE(MAX(CASE WHEN event_type = 'click' THEN {id} END), 0) AS click_score,
    COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN {id} END), 0) AS purchase_score,
    COALESCE(COUNT(CASE WHEN event_type = 'error' THEN 1 END), 0) AS error_score"""


@query(f"""WITH w AS (SELECT user_id, {MS} - {MS} % 86400000 AS window_start, {MS} - {MS} % 86400000 + 86400000 AS window_end, {PIVOT.format(id="event_id")} FROM events GROUP BY 1, 2, 3)
    SELECT user_id, window_start, window_end, click_value, CAST(click_score AS BIGINT) AS click_score, CAST(purchase_score AS BIGINT) AS purchase_score,
    CAST(error_score AS BIGINT) AS error_score, CAST(click_score + purchase_score + error_score AS BIGINT) AS score FROM w""")
def pivot_case_coalesce_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = f"""INSERT INTO o SELECT user_id, window_start, window_end, {PIVOT.format(id="event_id")}, click_score + purchase_score + error_score AS score
        FROM events GROUP BY user_id, TUMBLE(ts, INTERVAL '1' DAY)"""
    return batch(sql, "user_id", {"events": events(spark, sf_dir)}, {"events": "ts"})


@query(ORACLES["pivot_case_coalesce_derived"])
def window_over_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide window again, from one input for each kind of event."""
    e = events(spark, sf_dir)
    kinds = ("click", "error", "purchase", "signup", "view")
    branches = " UNION ALL ".join(f"SELECT event_type, user_id, value, event_id, ts FROM {k}_events" for k in kinds)
    sql = f"""INSERT INTO o SELECT user_id, window_start, window_end, {PIVOT.format(id="event_id")}, click_score + purchase_score + error_score AS score
        FROM ({branches}) GROUP BY user_id, TUMBLE(ts, INTERVAL '1' DAY)"""
    frames = {f"{k}_events": e.where(F.col("event_type") == k) for k in kinds}
    return batch(sql, "user_id", frames, {n: "ts" for n in frames})


def _epochs_sql(lag: int, size: int) -> str:
    """Rows of four epochs, each judged by the clock that the ones before left."""
    return f"""WITH e AS (SELECT user_id, event_id % 4 AS epoch, {MS} AS t FROM events),
    marks AS (SELECT epoch, max(max(t)) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {lag} AS mark FROM e GROUP BY epoch),
    kept AS (SELECT e.* FROM e JOIN marks USING (epoch) WHERE mark IS NULL OR t >= mark)
    SELECT user_id, t - t % {size} AS window_start, t - t % {size} + {size} AS window_end, count(*) AS n FROM kept
    WHERE t - t % {size} + {size} <= (SELECT max(t) - {lag} FROM e) GROUP BY ALL"""


def _strict(spark: SparkSession, sf_dir: str, sql: str, lag: int) -> DataFrame:
    shape = Pipeline.build(parse_config(config_text("o", "user_id", {"events": "ts"}, lag=f"{lag}ms")), sql).statement.window
    operator = StrictWindow(spark, scratch_path(spark, "strict"), shape, lag)
    e, out = events(spark, sf_dir), scratch_path(spark, "closed")
    for k in range(4):
        operator.apply(e.where(F.pmod("event_id", F.lit(4)) == k), k).write.mode("append").parquet(out)
    return spark.read.parquet(out)


@query(_epochs_sql(864_000_000, 3_600_000))
def late_drop_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four epochs under the strict clock, ten days of lag: windows close once, late rows are dropped."""
    return _strict(spark, sf_dir, "INSERT INTO o SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id, TUMBLE(ts, INTERVAL '1' HOUR)", 864_000_000)


@query()
def strict_session_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that grow over epochs; tests hold them against a plain loop."""
    return _strict(spark, sf_dir, "INSERT INTO o SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id, SESSION(ts, INTERVAL '6' HOUR)", 864_000_000)


# --- joins ---------------------------------------------------------------------


def _interval(spark: SparkSession, sf_dir: str, low: str, high: str, where: str = "") -> DataFrame:
    e = events(spark, sf_dir)
    frames = {"signups": e.where("event_type = 'signup'"), "purchases": e.where("event_type = 'purchase'")}
    sql = f"""INSERT INTO o SELECT s.user_id, s.event_id AS signup_id, p.event_id AS purchase_id, p.value AS value FROM signups AS s JOIN purchases AS p
        ON s.user_id = p.user_id AND p.ts BETWEEN s.ts {low} AND s.ts {high}{where}"""
    return batch(sql, "user_id", frames, {"signups": "ts", "purchases": "ts"})


def _interval_sql(low: int, high: int, where: str = "") -> str:
    return f"""SELECT s.user_id, s.event_id AS signup_id, p.event_id AS purchase_id, p.value AS value FROM events s JOIN events p ON s.user_id = p.user_id
    AND epoch_us(p.ts) // 1000 BETWEEN epoch_us(s.ts) // 1000 + {low} AND epoch_us(s.ts) // 1000 + {high} WHERE s.event_type = 'signup' AND p.event_type = 'purchase'{where}"""


@query(_interval_sql(0, 3_600_000))
def interval_join_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval(spark, sf_dir, "", "+ INTERVAL '1' HOUR")


@query(_interval_sql(-86_400_000, 43_200_000))
def interval_join_negative_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval(spark, sf_dir, "- INTERVAL '1' DAY", "+ INTERVAL '12' HOUR")


@query(_interval_sql(0, 864_000_000, " AND p.value > 30"))
def interval_join_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval(spark, sf_dir, "", "+ INTERVAL '10' DAY", " WHERE p.value > 30")


def _lookup(spark: SparkSession, sf_dir: str, kind: str, where: str = "", dimension: str = "") -> DataFrame:
    orders = convert(table(spark, sf_dir, "orders"), T.StructType([T.StructField(n, t) for n, t in (("o_orderkey", T.LongType()), ("c_custkey", T.LongType()), ("o_totalprice", T.DoubleType()))]), {"c_custkey": "o_custkey"})
    customer = table(spark, sf_dir, "customer")
    if dimension:
        customer = customer.where(dimension)
    sql = f"""INSERT INTO o SELECT f.o_orderkey, f.o_totalprice, d.c_name AS customer_name, d.c_mktsegment FROM orders f {kind} JOIN customer d
        ON f.c_custkey = d.c_custkey{where}"""
    return batch(sql, "o_orderkey", {"orders": orders, "customer": customer}, dimension=("customer", "c_custkey"))


@query("SELECT o_orderkey, o_totalprice, c_name AS customer_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, "INNER")


@query("SELECT o_orderkey, o_totalprice, c_name AS customer_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, "LEFT", dimension="c_mktsegment <> 'BUILDING'")


@query("SELECT o_orderkey, o_totalprice, c_name AS customer_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000")
def lookup_left_where_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, "LEFT", " WHERE d.c_mktsegment = 'BUILDING' AND f.o_totalprice > 1000")


# --- keyed tables ---------------------------------------------------------------

LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _line_table(spark: SparkSession, sf_dir: str, **options) -> tuple[KeyedTable, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    spec = TableSpec(schema, ("l_orderkey",), buckets=4, sequence_field="l_linenumber", **options)
    return KeyedTable.create(spark, scratch_path(spark, "lines"), spec), rows


UPSERT_SQL = """WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM r
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, (l_partkey % 3 = 0) DESC, l_partkey DESC, l_quantity DESC) = 1"""


@query(UPSERT_SQL)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits in the wrong order: a lower sequence never overwrites; of equal ones the later commit counts."""
    t, rows = _line_table(spark, sf_dir)
    t.commit(rows.where("l_partkey % 3 <> 0"), writer="q", identifier=0)
    t.commit(rows.where("l_partkey % 3 = 0"), writer="q", identifier=1)
    t.commit(rows.where("l_partkey % 3 = 0"), writer="q", identifier=1)  # a replay
    return t.read()


@query(UPSERT_SQL)
def compact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _line_table(spark, sf_dir)
    t.commit(rows.where("l_partkey % 3 <> 0"))
    t.commit(rows.where("l_partkey % 3 = 0"))
    t.compact(2)
    return t.read()


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_partkey % 3 = 0 OR l_partkey % 3 = 2")
def table_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the snapshots behind the first, over a compaction."""
    t, rows = _line_table(spark, sf_dir)
    for k in (1, 2, 0):
        t.commit(rows.where(F.pmod("l_partkey", F.lit(3)) == k))
    t.compact(2)
    return t.tail(1)[1]


@query("""WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity,
    CASE WHEN l_linenumber % 3 = 0 THEN '-D' WHEN l_linenumber = 1 THEN '+I' ELSE '+U' END AS kind FROM lineitem),
    m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, (kind <> '-D') DESC, l_partkey DESC, l_quantity DESC) = 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM m WHERE kind <> '-D'""")
def changelog_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _line_table(spark, sf_dir, changelog="input")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "-d").when(F.col("l_linenumber") == 1, "+I").otherwise("+U")
    before = rows.where("l_linenumber = 1").withColumn("l_linenumber", F.lit(99).cast("long")).withColumn("rowkind", F.lit("-U"))
    t.commit(rows.withColumn("rowkind", kind).union(before))
    return t.read()


@query("""SELECT CASE WHEN l_linenumber = 1 THEN '+I' ELSE '+U' END AS rowkind, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM lineitem""")
def changelog_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _line_table(spark, sf_dir, changelog="input")
    t.commit(rows.withColumn("rowkind", F.when(F.col("l_linenumber") == 1, "+I").otherwise("+U")))
    return t.tail(0, changelog=True)[1]


# --- messages --------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType())])
    return decode_json(events(spark, sf_dir), schema, "props", keep=("event_id",))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus, 'cust', CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END) AS VARCHAR) AS value FROM orders""")
def topic_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust")
    return encode_json(rows, "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE o_custkey END AS cust FROM orders")
def avro_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust")
    schema = avro.avro_schema(rows.schema)
    data = rows.select(avro.encode_column(rows.columns, schema, number=7).alias("value"))
    out = data.select(avro.decode_column(F.col("value"), schema, wrapped=True).alias("r")).select("r.*")
    return out.withColumn("cust", F.coalesce("cust", F.lit(-1).cast("long")))  # nulls come back as such


# --- streams: files in, Structured Streaming, keyed table out ----------------------


def _topic(rows: DataFrame, root: str, name: str, partitions: int = 2) -> None:
    topics.write_topic(rows.select(F.lit("x").alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).withColumn("key", F.xxhash64("value").cast("string")), root, name, partitions)


def _run_stream(spark: SparkSession, sql: str, key: str, inputs: dict[str, DataFrame], times: dict[str, str], output: T.StructType, primary: tuple[str, ...], *, lag: str = "1h", clock: str = "strict", sequence: str | None = None) -> KeyedTable:
    base = scratch_path(spark, "stream")
    text = config_text("o", key, {n: times.get(n) for n in inputs}, lag=lag, root=f"{base}/topics", warehouse=f"{base}/lake").replace("bucket: 1", "bucket: 2").replace("partitions: 1", "partitions: 2")
    for n, rows in inputs.items():
        _topic(rows, f"{base}/topics", n)
    t = KeyedTable.create(spark, f"{base}/lake/default.db/o", TableSpec(output, primary, buckets=2, sequence_field=sequence))
    pipeline = Pipeline.build(parse_config(text), sql, {n: T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]) for n, rows in inputs.items()})
    runner = Runner(spark, pipeline, f"{base}/checkpoint", clock=clock)
    runner.start(available_now=True).awaitTermination()
    runner.start(available_now=True).awaitTermination()  # nothing new: nothing changes
    return t


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def stream_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sql = "INSERT INTO o SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'"
    return _run_stream(spark, sql, "o_orderkey", {"orders": rows}, {}, rows.schema, ("o_orderkey",)).read()


@query(f"""WITH m AS (SELECT min(t) - 3600000 AS mark FROM (SELECT max({MS}) AS t FROM events))
    SELECT user_id, {MS} - {MS} % 86400000 AS window_start, {MS} - {MS} % 86400000 + 86400000 AS window_end, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events
    GROUP BY 1, 2, 3 HAVING {MS.replace("ts", "max(ts)")} - {MS.replace("ts", "max(ts)")} % 86400000 + 86400000 <= (SELECT mark - 86400000 FROM m)""")
def stream_strict_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day that closed a day before the end, whichever partition the clock's minimum is of."""
    rows = events(spark, sf_dir).selectExpr("user_id", "event_id", "CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts) / 1000) AS LONG) AS t")
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("user_id", "window_start", "window_end", "n", "ids")])
    sql = "INSERT INTO o SELECT user_id, COUNT(*) AS n, SUM(event_id) AS ids FROM events GROUP BY user_id, TUMBLE(t, INTERVAL '1' DAY)"
    closed = _run_stream(spark, sql, "user_id", {"events": rows}, {"events": "t"}, out, ("user_id", "window_start")).read()
    mark = rows.agg(F.max("t")).first()[0] - 3_600_000 - 86_400_000
    return closed.where(F.col("window_end") <= mark)


@query(_interval_sql(0, 86_400_000))
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).selectExpr("user_id", "event_id", "value", "event_type", "CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts) / 1000) AS LONG) AS t")
    cols = ("user_id", "event_id", "value", "t")
    frames = {"signups": e.where("event_type = 'signup'").select(*cols), "purchases": e.where("event_type = 'purchase'").select(*cols)}
    sql = """INSERT INTO o SELECT s.user_id, s.event_id AS signup_id, p.event_id AS purchase_id, p.value AS value FROM signups s JOIN purchases p
        ON s.user_id = p.user_id AND p.t BETWEEN s.t AND s.t + INTERVAL '1' DAY"""
    out = T.StructType([T.StructField(n, T.DoubleType() if n == "value" else T.LongType()) for n in ("user_id", "signup_id", "purchase_id", "value")])
    return _run_stream(spark, sql, "user_id", frames, {"signups": "t", "purchases": "t"}, out, ("signup_id", "purchase_id"), lag="60d").read()


# --- beyond the pipelines' language: what Spark gives bounded tables ----------------


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def batch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch_sql("SELECT DISTINCT o_custkey, o_orderstatus FROM orders", {"orders": table(spark, sf_dir, "orders")})


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def batch_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    return run_batch_sql("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", frames)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def batch_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    return run_batch_sql("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", frames)


RANKED = """SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS rk FROM (SELECT o_custkey, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) r WHERE rk <= 3"""


@query(RANKED)
def batch_rank_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch_sql(RANKED, {"orders": table(spark, sf_dir, "orders")})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def batch_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top list: the limit is the feature."""
    return run_batch_sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", {"orders": table(spark, sf_dir, "orders")})


ROLLUP = "SELECT {a} AS status, {b} AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP ({a}, {b})"


@query(ROLLUP.format(a="o_orderstatus", b="o_orderpriority"))
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch_sql(ROLLUP.format(a="o_orderstatus", b="o_orderpriority"), {"orders": table(spark, sf_dir, "orders")})


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def batch_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch_sql("INSERT INTO o SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 5", {"orders": table(spark, sf_dir, "orders")})


@query("""SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY n_name""")
def batch_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY n_name"""
    return run_batch_sql(sql, {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region", "orders")})



