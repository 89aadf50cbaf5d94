"""Queries of joins, set operations and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.plans.registry import DAILY, KEY, MONTHLY, daily, monthly, query, r, table


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50) GROUP BY 1")
def join_semi(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.semi(table(spark, d, "orders"), lines, ["o_orderkey"]).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY 1")
def join_anti(spark, d):
    orders = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.anti(table(spark, d, "customer"), orders, ["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query(f"WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY time) AS rn FROM daily), m AS (SELECT g, x AS x2, row_number() OVER (PARTITION BY g ORDER BY time) AS rn FROM daily WHERE y > 100) SELECT {KEY}, {r('y', 'y')}, {r('x2', 'x2')} FROM n JOIN m USING (g, rn)")
def join_positional(spark, d):
    rows = daily(spark, d)
    return rel.positional(rows.select("group", "time", "y"), rows.filter("y > 100").select("group", "time", F.col("x").alias("x2")))


_SPANS = "s AS (SELECT event_id AS sid, user_id, ts - INTERVAL 6 HOUR AS a, ts AS b FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_SPANS} SELECT sid, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s JOIN events e ON e.user_id = s.user_id AND e.ts BETWEEN a AND b GROUP BY sid")
def join_range(spark, d):
    """Events of the six hours before each purchase."""
    events = table(spark, d, "events")
    spans = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("sid"), "user_id", (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("start"), F.col("ts").alias("end"))
    found = rel.in_span(events.select("user_id", "ts", "event_type"), spans, ["user_id"], at="ts", width=21_600)
    return found.groupBy("sid").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query(f"WITH {_SPANS}, v AS (SELECT event_id AS vid, user_id, ts AS c, ts + INTERVAL 2 HOUR AS e FROM events WHERE event_type = 'click') SELECT sid, count(*) AS n FROM s JOIN v ON v.user_id = s.user_id AND a <= e AND c <= b GROUP BY sid")
def join_overlap(spark, d):
    events = table(spark, d, "events")
    spans = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("sid"), "user_id", (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("a"), F.col("ts").alias("b"))
    views = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("c"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("e"))
    return rel.overlapping(spans, views, ["user_id"], ("a", "b"), ("c", "e"), width=21_600).groupBy("sid").agg(F.count("*").alias("n"))


@query("SELECT a.o_orderpriority AS priority, sum(n)::DOUBLE AS n_above FROM orders a JOIN (SELECT p, (SELECT count(*) FROM orders b WHERE b.o_totalprice > p) AS n FROM (SELECT DISTINCT o_totalprice AS p FROM orders WHERE o_orderpriority LIKE '1%')) q ON a.o_totalprice = q.p WHERE a.o_orderpriority LIKE '1%' GROUP BY 1")
def join_theta_count(spark, d):
    """How many orders cost more than each urgent one, summed."""
    orders = table(spark, d, "orders")
    urgent = orders.filter("o_orderpriority like '1%'").select("o_orderpriority", "o_totalprice")
    counted = rel.less_than(urgent, orders.select(F.col("o_totalprice").alias("p")), "o_totalprice", "p")
    return counted.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.sum("n_above").cast("double").alias("n_above"))


@query("SELECT user_id, event_type, ts, event_id, value FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, round(value, 6) + 0.0 AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY events.ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def keep_last(spark, d):
    return rel.keep_last(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT o_orderpriority AS priority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_rows(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey", "o_totalprice")
    return rel.top(rows, ["priority"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query(f"WITH {DAILY}, {MONTHLY} SELECT {KEY}, {r('y', 'y')}, x FROM daily UNION ALL SELECT {KEY}, {r('y', 'y')}, NULL AS x FROM monthly")
def union_missing_columns(spark, d):
    return rel.stacked(daily(spark, d), monthly(spark, d))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey AS k FROM lineitem")
def set_intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k")))


_SUMS = "count(*) AS n, round(sum(l_quantity), 6) + 0.0 AS quantity FROM lineitem"


def _sums():
    return {"n": F.count("*"), "quantity": F.sum("l_quantity")}


def _flags(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")


@query(f"SELECT l_returnflag AS flag, l_linestatus AS status, {_SUMS} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def group_rollup(spark, d):
    return rel.rolled_up(_flags(spark, d), ["flag", "status"], **_sums())


@query(f"SELECT l_returnflag AS flag, l_linestatus AS status, {_SUMS} GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(spark, d):
    return rel.cubed(_flags(spark, d), ["flag", "status"], **_sums())


@query(f"SELECT l_returnflag AS flag, l_linestatus AS status, {_SUMS} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def group_sets(spark, d):
    return rel.grouping_sets(_flags(spark, d), [["flag"], ["status"], []], **_sums()).drop("_grouping")


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS users, sum(DISTINCT user_id)::BIGINT AS total FROM events GROUP BY 1")
def distinct_aggregates(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("users"), F.sum_distinct("user_id").alias("total"))


@query("SELECT event_type AS kind, true AS distinct_close, true AS median_close FROM events GROUP BY 1")
def approximate_aggregates(spark, d):
    """Whether sketches are within five percent of the exact values."""
    events = table(spark, d, "events")
    about = rel.approximate(events, ["event_type"], "value")
    exact = events.groupBy("event_type").agg(F.count_distinct("value").alias("n"), F.median("value").alias("m"))
    close = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= 0.05 * F.abs(F.col(b))).alias(f"{a.split('_')[0]}_close")
    return about.join(exact, "event_type").select(F.col("event_type").alias("kind"), close("distinct_about", "n"), close("median_about", "m"))


@query("WITH n AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE)::INTEGER, 1) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM n) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark, d):
    return rel.sessions(table(spark, d, "events"), ("user_id",), 1800, time="ts")


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id FROM events ORDER BY value DESC, event_id LIMIT 25")
def sorted_head(spark, d):
    """The rows of the largest values: a total order, of which each partition keeps only its head."""
    return table(spark, d, "events").select("ts", "event_id", "value").orderBy(F.desc("value"), "event_id").limit(25).drop("value")
