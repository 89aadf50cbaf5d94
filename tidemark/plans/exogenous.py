"""Queries of regressions with exogenous columns, conformal intervals around any model, similarities and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.models import exogenous as ex
from tidemark.models.forecasters import PolynomialTrend, SeasonalNaive
from tidemark.operators.windows import Lag, RollingStatistics
from tidemark.plans.registry import BY, MONTHLY, fitted, monthly, query, r, table
from tidemark.streaming.memory import Observing, ObservingForecaster

#: The panel: monthly orders y, their mean price x (known up to now), the days of a month (known ahead), and a forecast of y,
#: made anew every quarter: the value of a year before, plus the vintage's month.
PANEL = f"""WITH {MONTHLY},
m AS (SELECT g, time, y, x FROM monthly JOIN (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate)::TIMESTAMP AS time, avg(o_totalprice) / 1000 AS x FROM orders GROUP BY 1, 2) USING (g, time)),
n AS (SELECT *, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY g) AS n FROM m),
d AS (SELECT *, day(last_day(time + INTERVAL 1 MONTH))::DOUBLE AS f1, day(last_day(time + INTERVAL 2 MONTH))::DOUBLE AS f2, lead(y, 1) OVER ({BY}) AS a1, lead(y, 2) OVER ({BY}) AS a2 FROM n),
v AS (SELECT t.g, o.time AS vt, t.time + INTERVAL 1 YEAR AS time, t.y + month(o.time) AS w FROM m t JOIN m o ON o.g = t.g AND t.time + INTERVAL 1 YEAR > o.time AND t.time + INTERVAL 1 YEAR <= o.time + INTERVAL 6 MONTH WHERE month(o.time) % 3 = 1),
e AS (SELECT d.*, (SELECT arg_max(w, vt) FROM v WHERE v.g = d.g AND v.time = d.time + INTERVAL 1 MONTH AND vt <= d.time) AS w1, (SELECT arg_max(w, vt) FROM v WHERE v.g = d.g AND v.time = d.time + INTERVAL 2 MONTH AND vt <= d.time) AS w2 FROM d)"""


def panel(spark, d):
    orders = table(spark, d, "orders")
    x = orders.groupBy(F.col("o_orderpriority").alias("group"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time")).agg((F.avg("o_totalprice") / 1000).alias("x"))
    return monthly(spark, d).join(x, ["group", "time"])


def days_ahead(spark, d):
    """The length of each month, two beyond the end included."""
    rows = panel(spark, d).select("group", "time")
    later = rows.groupBy("group").agg(F.max("time").alias("time"))
    for h in (1, 2):
        rows = rows.union(later.select("group", F.expr(f"timestampadd(MONTH, {h}, time)").alias("time")))
    return rows.withColumn("days", F.dayofmonth(F.last_day(F.to_date("time"))).cast("double"))


def vintages(spark, d):
    rows = panel(spark, d).select("group", "time", "y")
    origins = rows.filter(F.month("time") % 3 == 1).select("group", F.col("time").alias("vintage_time"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("_h"))
    asked = origins.withColumn("time", F.expr("timestampadd(MONTH, _h, vintage_time)")).withColumn("_before", F.expr("timestampadd(YEAR, -1, time)"))
    return asked.join(rows.withColumnRenamed("time", "_before"), ["group", "_before"]).select("group", "vintage_time", "time", (F.col("y") + F.month("vintage_time")).alias("w"))


def line(name: str, y: str, a: str, source: str = "e") -> str:
    return f"{name} AS (SELECT regr_slope({y}, {a}) AS ka, regr_intercept({y}, {a}) AS k0 FROM {source})"


def steps(first: str, second: str, source: str) -> str:
    """The result of two steps from each series' last row."""
    when = "strftime(time, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(time + INTERVAL 1 MONTH * h, '%Y-%m-%d %H:%M:%S') AS time, h::INTEGER AS step"
    return f"SELECT g AS \"group\", {when}, {r(f'CASE h WHEN 1 THEN {first} ELSE {second} END', 'y_hat')} FROM {source} CROSS JOIN (SELECT unnest([1, 2]) AS h) WHERE rn = n"


def _plane(model: str, a: str, b: str) -> str:
    return f"({model}.k0 + {model}.ka * {a} + {model}.kb * {b})"


@query(f"{PANEL}, {fitted('p', 'a1', 'y', 'x')}, {fitted('q', 'a2', 'y', 'x')} {steps(_plane('p', 'y', 'x'), _plane('q', 'y', 'x'), 'e, p, q')}")
def forecast_actual_direct(spark, d):
    return ex.ExogenousReduction(lags=(0,), actual={"x": (0,)}, interval="1mo").fit(panel(spark, d)).predict(2)


@query(f"{PANEL}, {fitted('p', 'a1', 'y', 'f1')}, {fitted('q', 'a2', 'y', 'f2')} {steps(_plane('p', 'y', 'f1'), _plane('q', 'y', 'f2'), 'e, p, q')}")
def forecast_future_direct(spark, d):
    return ex.ExogenousReduction(lags=(0,), future=days_ahead(spark, d), interval="1mo").fit(panel(spark, d)).predict(2)


@query(f"{PANEL}, {fitted('p', 'a1', 'y', 'w1')}, {fitted('q', 'a2', 'y', 'w2')} {steps(_plane('p', 'y', 'w1'), _plane('q', 'y', 'w2'), 'e, p, q')}")
def forecast_vintages_direct(spark, d):
    return ex.ExogenousReduction(lags=(0,), forecasts=vintages(spark, d), interval="1mo").fit(panel(spark, d)).predict(2)


@query(f"{PANEL}, {fitted('p', 'a1', 'f1', 'f2')}, {fitted('q', 'a2', 'f1', 'f2')} {steps(_plane('p', 'f1', 'f2'), _plane('q', 'f1', 'f2'), 'e, p, q')}")
def forecast_future_multi_output(spark, d):
    return ex.ExogenousReduction(lags=(), future=days_ahead(spark, d), strategy="multi-output", interval="1mo").fit(panel(spark, d)).predict(2)


@query(f"{PANEL}, {fitted('p', 'a1', 'y', 'f1')} {steps(_plane('p', 'y', 'f1'), _plane('p', _plane('p', 'y', 'f1'), 'f2'), 'e, p')}")
def forecast_future_recursive(spark, d):
    return ex.ExogenousReduction(lags=(0,), future=days_ahead(spark, d), strategy="recursive", interval="1mo").fit(panel(spark, d)).predict(2)


@query(f"{PANEL}, {line('p', 'a1', 'f1')}, z AS (SELECT e.*, p.k0 + p.ka * f1 AS p1 FROM e, p), {fitted('q', 'a2', 'f2', 'p1', 'z')} {steps('p1', _plane('q', 'f2', 'p1'), 'z, q')}")
def forecast_future_dirrec(spark, d):
    return ex.ExogenousReduction(lags=(), future=days_ahead(spark, d), strategy="dir-rec", interval="1mo").fit(panel(spark, d)).predict(2)


_HELD = f"{PANEL}, head AS (SELECT e.*, CASE WHEN n - rn >= 19 THEN a1 END AS h1, CASE WHEN n - rn >= 20 THEN a2 END AS h2 FROM e WHERE n - rn >= 18), {fitted('p', 'h1', 'y', 'x', 'head')}, {fitted('q', 'h2', 'y', 'x', 'head')}, s AS (SELECT g, time, 1 AS step, rn + 1 AS tgt, n, {_plane('p', 'y', 'x')} AS f, a1 AS y FROM e, p UNION ALL SELECT g, time, 2, rn + 2, n, {_plane('q', 'y', 'x')}, a2 FROM e, q), c AS (SELECT g, step, list_sort(list(abs(y - f))) AS scores FROM s WHERE y IS NOT NULL AND n - tgt < 18 GROUP BY 1, 2)"
_ENDS = "strftime(time, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(time + INTERVAL 1 MONTH * step, '%Y-%m-%d %H:%M:%S') AS time, step::INTEGER AS step"


@query(f"{_HELD} SELECT s.g AS \"group\", {_ENDS}, {r('f', 'y_hat')}, 0.8::DOUBLE AS coverage_rate, {r('f - scores[ceil((len(scores) + 1) * 0.8 - 1e-9)::INT]', 'lower')}, {r('f + scores[ceil((len(scores) + 1) * 0.8 - 1e-9)::INT]', 'upper')} FROM s JOIN c USING (g, step) WHERE tgt - step = n")
def conformal_around_regression(spark, d):
    model = ex.ExogenousReduction(lags=(0,), actual={"x": (0,)})
    return ex.Conformal(model=model, calibration_size=18, interval="1mo").fit(panel(spark, d)).predict_interval(2)


_TREND = f"{PANEL}, t AS (SELECT *, (rn - 1)::DOUBLE AS i FROM n), k AS (SELECT g, regr_slope(y, i) AS ka, regr_intercept(y, i) AS k0 FROM t WHERE n - rn >= 18 GROUP BY g), s AS (SELECT t.g, t.time, h AS step, t.n, t.rn + h AS tgt, k0 + ka * (i + h) AS f, u.y FROM t JOIN k USING (g) CROSS JOIN (SELECT unnest([1, 2]) AS h) LEFT JOIN (SELECT g, rn, y FROM n) u ON u.g = t.g AND u.rn = t.rn + h), c AS (SELECT step, list_sort(list(y - f)) AS scores FROM s WHERE y IS NOT NULL AND n - tgt < 18 GROUP BY 1)"


@query(f"{_TREND} SELECT s.g AS \"group\", {_ENDS}, {r('f', 'y_hat')}, 0.9::DOUBLE AS coverage_rate, {r('f + scores[greatest(1, floor((len(scores) + 1) * 0.05 + 1e-9))::INT]', 'lower')}, {r('f + scores[least(len(scores), ceil((len(scores) + 1) * 0.95 - 1e-9))::INT]', 'upper')} FROM s JOIN c USING (step) WHERE tgt - step = n")
def conformal_around_trend(spark, d):
    return ex.Conformal(model=PolynomialTrend(), calibration_size=18, kind="residual", rates=(0.9,), pooled=True, interval="1mo").fit(panel(spark, d)).predict_interval(2)


@query(f"{_HELD}, z AS (SELECT s.g, s.step, abs(y - f) AS score, time + INTERVAL 1 MONTH * step AS target FROM s WHERE y IS NOT NULL AND n - tgt < 18), w AS (SELECT z.*, 1.0 / (18 + 1 + month(target) % 3) AS weight FROM z), k AS (SELECT *, sum(weight) OVER (PARTITION BY g, step ORDER BY score) AS cum FROM w), u AS (SELECT g, step, coalesce(min(CASE WHEN cum >= 0.7 - 1e-12 THEN score END), max(score)) AS reach FROM k GROUP BY 1, 2) SELECT s.g AS \"group\", {_ENDS}, {r('f', 'y_hat')}, 0.7::DOUBLE AS coverage_rate, {r('f - reach', 'lower')}, {r('f + reach', 'upper')} FROM s JOIN u USING (g, step) WHERE tgt - step = n")
def conformal_weighted(spark, d):
    model = ex.Conformal(model=ex.ExogenousReduction(lags=(0,), actual={"x": (0,)}), calibration_size=18, rates=(0.7,), interval="1mo").fit(panel(spark, d))
    weights = model.held.select("group", "time", (1.0 / (19 + F.month("time") % 3)).alias("weight"))
    return model.predict_weighted(2, weights).select("group", "vintage_time", "time", "step", "y_hat", "coverage_rate", "lower", "upper")


@query()
def conformal_adaptive(spark, d):
    return ex.Conformal(model=SeasonalNaive(seasonality=12), calibration_size=24, interval="1mo").fit(panel(spark, d)).predict_adaptive()


_PHASE = "a AS (SELECT g, time, n, rn, sin(2 * pi() * rn / 12) AS s, cos(2 * pi() * rn / 12) AS c, y / stddev_pop(y) OVER (PARTITION BY g) AS z FROM n WHERE n - rn BETWEEN 1 AND 24), b AS (SELECT n.g, n.time, sin(2 * pi() * rn / 12) AS s, cos(2 * pi() * rn / 12) AS c, y / dev AS z FROM n JOIN (SELECT g, stddev_pop(y) AS dev FROM n WHERE n - rn BETWEEN 1 AND 24 GROUP BY g) USING (g) WHERE n = rn), p AS (SELECT a.g, b.time AS qt, a.time, sqrt(pow(a.s - b.s, 2) + pow(a.c - b.c, 2)) / 0.5 AS d1, abs(a.z - b.z) AS d2 FROM a JOIN b USING (g)), k AS (SELECT *, exp(min(d1) OVER w - d1) AS k1, exp(min(d2) OVER w - d2) AS k2 FROM p WINDOW w AS (PARTITION BY g)), u AS (SELECT *, k1 / (sum(k1) OVER w + 1) AS w1, k2 / (sum(k2) OVER w + 1) AS w2, k1 * k2 AS kk FROM k WINDOW w AS (PARTITION BY g))"
_PAIR = "g AS \"group\", strftime(qt, '%Y-%m-%d %H:%M:%S') AS query_time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time"


def _places(spark, d):
    w = Window.partitionBy("group")
    rows = panel(spark, d).withColumns({"place": F.row_number().over(w.orderBy("time")), "_n": F.count("*").over(w)})
    back = F.col("_n") - F.col("place")
    return rows.filter((back >= 1) & (back <= 24)), rows.filter(back == 0)


@query(f"{PANEL}, {_PHASE} SELECT {_PAIR}, {r('w1', 'weight')} FROM u")
def similarity_seasonal(spark, d):
    return ex.SeasonalSimilarity().weights(*_places(spark, d))


@query(f"{PANEL}, {_PHASE} SELECT {_PAIR}, {r('(w1 + w2) / 2', 'weight')} FROM u")
def similarity_mean(spark, d):
    both = (ex.SeasonalSimilarity(), ex.DistanceSimilarity(features=("y",)))
    return ex.CompositeSimilarity(similarities=both, combination="mean").weights(*_places(spark, d))


@query(f"{PANEL}, {_PHASE} SELECT {_PAIR}, {r('kk / (sum(kk) OVER (PARTITION BY g) + 1)', 'weight')} FROM u")
def similarity_product(spark, d):
    both = (ex.SeasonalSimilarity(), ex.DistanceSimilarity(features=("y",)))
    return ex.CompositeSimilarity(similarities=both).weights(*_places(spark, d))


@query(f"{PANEL} SELECT g AS \"group\", strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {r(f'avg(y) OVER ({BY} ROWS 2 PRECEDING)', 'y_mean')} FROM n QUALIFY n - rn < 9")
def observe_transform(spark, d):
    """Rolling means of the last nine months, as three batches that come one after the other."""
    w = Window.partitionBy("group").orderBy(F.desc("time"))
    rows = panel(spark, d).withColumn("_b", F.row_number().over(w)).select("group", "time", "y", "_b")
    op = Observing(RollingStatistics(window_size=3, columns=("y",)), 2, "1mo").fit(rows.filter("_b > 9").drop("_b"))
    out = None
    for low, high in ((7, 9), (4, 6), (1, 3)):
        one = op.observe_transform(rows.filter(F.col("_b").between(low, high)).drop("_b"))
        out = one if out is None else out.union(one)
    return out


@query(f"{PANEL}, s AS (SELECT a.g, a.time AS vt, h AS step, c.y AS f FROM n a CROSS JOIN (SELECT unnest([1, 2]) AS h) JOIN n c ON c.g = a.g AND c.rn = a.rn - (11 - (h - 1)) WHERE a.n - a.rn < 6) SELECT g AS \"group\", strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(vt + INTERVAL 1 MONTH * step, '%Y-%m-%d %H:%M:%S') AS time, step::INTEGER AS step, {r('f', 'y_hat')} FROM s")
def observe_predict(spark, d):
    """Forecasts from each of the last six months, told of them in two batches."""
    w = Window.partitionBy("group").orderBy(F.desc("time"))
    rows = panel(spark, d).withColumn("_b", F.row_number().over(w)).select("group", "time", "y", "_b")
    model = ObservingForecaster(SeasonalNaive(seasonality=12, interval="1mo"), 12).fit(rows.filter("_b > 6").drop("_b"))
    first = model.observe_predict(rows.filter("_b between 4 and 6").drop("_b"), 2)
    return first.union(model.observe_predict(rows.filter("_b <= 3").drop("_b"), 2))


@query(f"{PANEL} SELECT g AS \"group\", strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {r(f'lag(y, 1) OVER ({BY})', 'y_lag_1')} FROM n QUALIFY n - rn < 4")
def rewind_transform(spark, d):
    """A memory that goes back by four months, and sees these months again."""
    w = Window.partitionBy("group").orderBy(F.desc("time"))
    rows = panel(spark, d).withColumn("_b", F.row_number().over(w)).select("group", "time", "y", "_b")
    op = Observing(Lag(lags=(1,), columns=("y",)), 1, "1mo").fit(rows.drop("_b"))
    return op.rewind(rows.filter("_b > 4").drop("_b")).observe_transform(rows.filter("_b <= 4").drop("_b"))
