from __future__ import annotations

import pytest

from weir.errors import SqlError
from weir.plans.shapes import Derived
from weir.plans.sqlfront import parse, table_select

JOIN = "INSERT INTO o SELECT o.order_id, o.amount, p.payment_id FROM orders AS o JOIN payments AS p ON o.order_id = p.order_id AND p.t BETWEEN {low} AND {high}"
WINDOW = "INSERT INTO o SELECT k, {items} FROM s {where}GROUP BY k, {window}"


def test_insert_select():
    s = parse("INSERT INTO db.lake SELECT id, amount AS total FROM orders WHERE status <> 'cancelled';")
    assert (s.target, s.source_tables, s.kind) == ("lake", ("orders",), "plain")
    assert s.select_sql.startswith("SELECT") and "INSERT" not in s.select_sql
    assert s.plain.where == "status <> 'cancelled'"


def test_group_by_without_a_window_is_for_bounded_tables():
    s = parse("INSERT INTO o SELECT id, SUM(amount) AS total FROM orders WHERE status <> 'x' GROUP BY id")
    assert (s.kind, s.why_batch_only) == ("general", "GROUP BY")


@pytest.mark.parametrize("sql", ["SELECT DISTINCT a FROM t", "SELECT a FROM t ORDER BY a", "SELECT sum(a) FROM t", "SELECT rank() OVER (ORDER BY a) AS r FROM t", "SELECT a FROM t WHERE a IN (SELECT b FROM u)"])
def test_batch_only(sql):
    assert parse(f"INSERT INTO o {sql}").kind == "general"


def test_strings_comments_and_quotes():
    s = parse("INSERT INTO o -- to the lake\nSELECT a, 'it''s; FROM x' AS b, \"odd name\" /* all */ FROM \"My Table\" WHERE c = ' UNION '")
    assert s.source_tables == ("My Table",)
    assert s.plain.items == ("a", "'it''s; FROM x' AS b", "`odd name`")


@pytest.mark.parametrize("sql", ["", "  \n ", "THIS IS NOT SQL", "SELECT 1", "SELECT 1; SELECT 2", "INSERT INTO o", "INSERT INTO o SELECT a", "INSERT INTO o SELECT FROM t", "INSERT INTO o SELECT a FROM t WHERE", "INSERT INTO o SELECT (a FROM t", "INSERT INTO o SELECT a) FROM t", "INSERT INTO o WITH x AS (SELECT 1) SELECT a FROM x", "INSERT INTO o SELECT a FROM a, b", "INSERT INTO o SELECT a FROM t LIMIT x"])
def test_refused(sql):
    with pytest.raises(SqlError):
        parse(sql)


def test_union_all():
    s = parse("INSERT INTO o SELECT id, a FROM web WHERE a > 15 UNION ALL SELECT id, a FROM app UNION ALL (SELECT id, a FROM store)")
    assert s.kind == "union" and s.source_tables == ("web", "app", "store")
    assert s.union[0].where == "a > 15"


@pytest.mark.parametrize(
    ("sql", "why"),
    [
        ("SELECT id FROM web UNION SELECT id FROM app", "UNION ALL"),
        ("SELECT id FROM web UNION DISTINCT SELECT id FROM app", "UNION ALL"),
        ("SELECT id FROM web EXCEPT SELECT id FROM app", "UNION ALL"),
        ("SELECT id FROM web INTERSECT SELECT id FROM app", "UNION ALL"),
        ("SELECT a.id FROM web a JOIN app b ON a.id = b.id UNION ALL SELECT id FROM store", "one table a branch"),
        ("SELECT id FROM web UNION ALL SELECT id FROM web", "only once"),
        ("SELECT id FROM web UNION ALL SELECT id FROM app ORDER BY id", "no order"),
        ("(SELECT id FROM web ORDER BY id) UNION ALL SELECT id FROM app", "no order"),
        ("SELECT id FROM web UNION ALL SELECT id FROM app LIMIT 5", "no order"),
        ("SELECT k, count(*) AS n FROM a GROUP BY k UNION ALL SELECT id, n FROM app", "plain SELECT"),
    ],
)
def test_unions_refused(sql, why):
    with pytest.raises(SqlError, match=why):
        parse(f"INSERT INTO o {sql}")


def test_windows():
    w = parse(WINDOW.format(items="COUNT(*) AS n", where="WHERE status <> 'x' ", window="TUMBLE(t, INTERVAL '1' MINUTE)")).window
    assert (w.kind, w.event_time, w.size_ms, w.group_columns, w.where) == ("tumble", "t", 60_000, ("k",), "status <> 'x'")
    w = parse(WINDOW.format(items="COUNT(*) AS n", where="", window="HOP(t, INTERVAL '5' SECOND, INTERVAL '10' SECOND)")).window
    assert (w.kind, w.size_ms, w.slide_ms) == ("hop", 10_000, 5_000)
    w = parse(WINDOW.format(items="SUM(a) AS s", where="", window="SESSION(t, INTERVAL '250' MILLISECOND)")).window
    assert (w.kind, w.size_ms) == ("session", 250)


def test_case_coalesce_and_sums_of_aliases():
    items = "window_start, window_end, MAX(CASE WHEN m = 'H' THEN v END) AS hv, COALESCE(MAX(CASE WHEN m = 'H' THEN s END), 0) AS hs, COALESCE(SUM(x), -1.5) AS os, hs + os AS total"
    w = parse(WINDOW.format(items=items, where="", window="TUMBLE(t, INTERVAL '1' MINUTE)")).window
    assert [a.alias for a in w.aggregates] == ["hv", "hs", "os"]
    assert [a.fill for a in w.aggregates] == [None, "0", "-1.5"]
    assert w.derived == (Derived("total", ("hs", "os")),)
    assert w.output_columns == ["k", "window_start", "window_end", "hv", "hs", "os", "total"]


@pytest.mark.parametrize(
    ("items", "window", "why"),
    [
        ("COUNT(*) AS n", "HOP(t, INTERVAL '3' SECOND, INTERVAL '10' SECOND)", "divide"),
        ("COUNT(*) AS n", "TUMBLE(t, INTERVAL '1' MONTH)", "unit"),
        ("COUNT(*) AS n", "TUMBLE(t, 60)", "INTERVAL"),
        ("COUNT(*) AS n", "TUMBLE(t + 1, INTERVAL '1' MINUTE)", "column"),
        ("COUNT(*) AS n", "TUMBLE(t)", "2 arguments"),
        ("COUNT(*) AS n", "TUMBLE(t, INTERVAL '1' MINUTE), TUMBLE(t, INTERVAL '2' MINUTE)", "one window"),
        ("COUNT(*) AS n", "k + 1, TUMBLE(t, INTERVAL '1' MINUTE)", "takes columns"),
        ("COUNT(*)", "TUMBLE(t, INTERVAL '1' MINUTE)", "alias"),
        ("COUNT(DISTINCT a) AS n", "TUMBLE(t, INTERVAL '1' MINUTE)", "DISTINCT"),
        ("SUM(MAX(a)) AS n", "TUMBLE(t, INTERVAL '1' MINUTE)", "inside"),
        ("MEDIAN(a) AS n", "TUMBLE(t, INTERVAL '1' MINUTE)", "not one of"),
        ("SUM(*) AS n", "TUMBLE(t, INTERVAL '1' MINUTE)", "column or an expression"),
        ("COUNT(*) AS n, SUM(a) AS n", "TUMBLE(t, INTERVAL '1' MINUTE)", "twice"),
        ("COALESCE(SUM(a), b) AS n", "TUMBLE(t, INTERVAL '1' MINUTE)", "number"),
        ("SUM(a) AS x, x + y AS z", "TUMBLE(t, INTERVAL '1' MINUTE)", "is none"),
        ("*", "TUMBLE(t, INTERVAL '1' MINUTE)", r"SELECT \*"),
        ("window_start", "TUMBLE(t, INTERVAL '1' MINUTE)", "has an aggregate"),
        ("COUNT(*) AS n", "TUMBLE(t, INTERVAL '1' MINUTE) HAVING n > 1", "HAVING"),
        ("COUNT(*) AS n", "TUMBLE(t, INTERVAL '1' MINUTE) ORDER BY n", "ORDER"),
        ("COUNT(*) AS n", "TUMBLE(t, INTERVAL '1' MINUTE) LIMIT 1", "LIMIT"),
    ],
)
def test_windows_refused(items, window, why):
    with pytest.raises(SqlError, match=why):
        parse(WINDOW.format(items=items, where="", window=window))


def test_window_over_a_union():
    sql = "INSERT INTO o SELECT k, COUNT(*) AS n FROM (SELECT k, t FROM a UNION ALL SELECT k, t FROM b) GROUP BY k, TUMBLE(t, INTERVAL '1' MINUTE)"
    s = parse(sql)
    assert s.window.source is None and s.source_tables == ("a", "b")
    with pytest.raises(SqlError, match="UNION ALL"):
        parse("INSERT INTO o SELECT k, COUNT(*) AS n FROM (SELECT k, t FROM a) GROUP BY k, TUMBLE(t, INTERVAL '1' MINUTE)")


def test_interval_join():
    j = parse(JOIN.format(low="o.t", high="o.t + INTERVAL '1' HOUR")).interval
    assert (j.left, j.right, j.left_key, j.right_key, j.base_is_left, j.lower_ms, j.upper_ms) == ("orders", "payments", "order_id", "order_id", True, 0, 3_600_000)
    assert [c.alias for c in j.columns] == ["order_id", "amount", "payment_id"]
    j = parse(JOIN.format(low="o.t - INTERVAL '5' SECOND", high="o.t - INTERVAL '1' SECOND").replace("p.t BETWEEN", "p.t BETWEEN") + " WHERE o.amount > 3").interval
    assert (j.lower_ms, j.upper_ms, j.where) == (-5_000, -1_000, "o.amount > 3")


@pytest.mark.parametrize(
    ("sql", "why"),
    [
        (JOIN.format(low="o.t + INTERVAL '2' HOUR", high="o.t + INTERVAL '1' HOUR"), "above"),
        (JOIN.format(low="p.t", high="p.t + INTERVAL '1' HOUR"), "BETWEEN takes"),
        (JOIN.format(low="o.t", high="o.u + INTERVAL '1' HOUR"), "BETWEEN takes"),
        (JOIN.format(low="t", high="t"), "qualified"),
        (JOIN.format(low="o.t", high="o.t").replace("o.amount", "amount"), "qualified"),
        (JOIN.format(low="o.t", high="o.t").replace("o.amount", "p.order_id"), "twice"),
        (JOIN.format(low="o.t", high="o.t").replace("JOIN payments", "LEFT JOIN payments"), "INNER"),
        (JOIN.format(low="o.t", high="o.t") + " GROUP BY o.order_id", "GROUP"),
        (JOIN.format(low="o.t", high="o.t").replace(" = ", " < "), "equality"),
        (JOIN.format(low="o.t", high="o.t") + " OR o.a = p.a", "OR"),
        (JOIN.format(low="o.t", high="o.t") + " AND o.a = p.a", "exactly one equality"),
    ],
)
def test_interval_joins_refused(sql, why):
    with pytest.raises(SqlError, match=why):
        parse(sql)


def test_lookup():
    s = parse("INSERT INTO o SELECT o.id, c.name AS customer FROM orders o LEFT JOIN customers c ON o.cid = c.cid WHERE c.country = 'AR'")
    assert s.kind == "lookup" and s.lookup.kind == "left" and s.lookup.where == "c.country = 'AR'"
    assert s.lookup.items == ("o.id", "c.name AS customer")


@pytest.mark.parametrize("join", ["RIGHT JOIN", "FULL OUTER JOIN", "CROSS JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN", "NATURAL JOIN"])
def test_other_joins_are_refused(join):
    with pytest.raises(SqlError, match="not supported"):
        parse(f"INSERT INTO o SELECT a.x FROM a {join} b ON a.id = b.id")


@pytest.mark.parametrize(
    ("sql", "why"),
    [
        ("SELECT a.x FROM a JOIN b USING (id)", "USING"),
        ("SELECT a.x FROM a JOIN b", "needs ON"),
        ("SELECT * FROM a JOIN b ON a.id = b.id", r"SELECT \*"),
        ("SELECT a.x FROM a JOIN b ON id = b.id", "qualified"),
        ("SELECT a.x FROM a JOIN b ON a.id = b.id JOIN c ON a.id = c.id", "two tables"),
        ("SELECT o.id FROM orders o JOIN c FOR SYSTEM_TIME AS OF TIMESTAMP '2020-01-01' x ON o.id = x.id", "SYSTEM_TIME"),
    ],
)
def test_lookups_refused(sql, why):
    with pytest.raises(SqlError, match=why):
        parse(f"INSERT INTO o {sql}")


def test_table_select():
    assert table_select("SELECT order_id, paid.amount FROM paid").columns == ("order_id", "amount")
    assert table_select("SELECT p.* FROM paid p").columns is None
    for sql, why in (
        ("SELECT id FROM paid WHERE a > 0", "WHERE"),
        ("SELECT id AS x FROM paid", "alias"),
        ("SELECT a.id FROM a JOIN b ON a.id = b.id", "JOIN"),
        ("SELECT id, id FROM a", "twice"),
        ("SELECT id + 1 FROM a", "columns only"),
        ("SELECT id FROM a LIMIT 1", "LIMIT"),
        ("SELECT *, id FROM a", "alone"),
    ):
        with pytest.raises(SqlError, match=why):
            table_select(sql)
