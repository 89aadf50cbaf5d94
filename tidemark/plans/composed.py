"""Queries of composition, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.compose.pipeline import ByColumns, ByTarget, Combining, PerVintage, Pipeline, Union
from tidemark.metrics.scores import point_score
from tidemark.models.forecasters import PatternSeasonality, PolynomialTrend, SeasonalNaive
from tidemark.operators.reshape import actuals_as_forecasts
from tidemark.operators.resample import Downsampler, on_grid
from tidemark.operators.scalers import StandardScaler
from tidemark.operators.stationarity import Log, SeasonalDifferencing
from tidemark.operators.windows import Lag, RollingStatistics
from tidemark.plans.registry import BY, DAILY, KEY, MONTHLY, daily, monthly, query, r, table


@query(f"WITH {DAILY}, d AS (SELECT g, time, y - lag(y, 7) OVER ({BY}) AS v FROM daily), n AS (SELECT *, row_number() OVER ({BY}) AS rn FROM d WHERE v IS NOT NULL) SELECT {KEY}, {r(f'avg(v) OVER ({BY} ROWS 2 PRECEDING)', 'diff_7_y_mean')} FROM n QUALIFY rn >= 3")
def pipeline_diff_rolling(spark, d):
    return Pipeline(steps=(SeasonalDifferencing(seasonality=7, columns=("y",)), RollingStatistics(window_size=3))).fit(daily(spark, d)).transform(daily(spark, d))


@query(f"WITH {DAILY} SELECT {KEY}, lag(y, 2) OVER ({BY}) AS lags__y_lag_2, {r('2 * ln(y + 1)', 'logs__log_1_y')} FROM daily QUALIFY row_number() OVER ({BY}) > 2")
def union_lags_logs(spark, d):
    return Union(branches={"lags": Lag(lags=(2,), columns=("y",)), "logs": Log(offset=1.0, columns=("y",))}, weights={"logs": 2.0}).fit(daily(spark, d)).transform(daily(spark, d))


@query(f"WITH {DAILY} SELECT {KEY}, {r('(y - (SELECT avg(y) FROM daily)) / (SELECT stddev_pop(y) FROM daily)', 'y')}, x FROM daily")
def columns_scaled(spark, d):
    return ByColumns(branches=((StandardScaler(), ("y",)),), remainder="passthrough").fit(daily(spark, d)).transform(daily(spark, d))


@query(f"WITH {DAILY}, n AS (SELECT *, row_number() OVER ({BY}) - 1 AS rn FROM daily), v AS (SELECT a.g, a.time AS vt, b.time, b.y FROM n a JOIN n b ON a.g = b.g AND b.rn - a.rn BETWEEN 1 AND 5 WHERE a.rn % 10 = 0) SELECT g AS \"group\", strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, lag(y) OVER (PARTITION BY g, vt ORDER BY time) AS y_lag_1 FROM v QUALIFY row_number() OVER (PARTITION BY g, vt ORDER BY time) > 1")
def per_vintage_lag(spark, d):
    rows = actuals_as_forecasts(daily(spark, d), 5, ("y",), stride=10).drop("step")
    return PerVintage(inner=Lag(lags=(1,), columns=("y",))).fit(rows).transform(rows)


_END = f"WITH {MONTHLY}, mn AS (SELECT *, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY g) AS n, max(time) OVER (PARTITION BY g) AS t1 FROM monthly), z AS (SELECT a.g, t1, h, a.y FROM mn a CROSS JOIN (SELECT unnest(range(1, 7)) AS h) WHERE a.rn = n - (11 - (h - 1) % 12))"
_ENDKEY = "g AS \"group\", strftime(t1, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(t1 + INTERVAL 1 MONTH * h, '%Y-%m-%d %H:%M:%S') AS time, h::INTEGER AS step"


@query(f"{_END} SELECT {_ENDKEY}, {r('y + 2 * y', 'y_hat')} FROM z")
def combine_sum(spark, d):
    rows = monthly(spark, d).withColumn("twice", F.col("y") * 2)
    return Combining(terms={"y": SeasonalNaive(seasonality=12), "twice": SeasonalNaive(seasonality=12)}, interval="1mo").fit(rows).predict(6)


@query(f"{_END} SELECT {_ENDKEY}, c AS component, {r('''CASE c WHEN 'y' THEN y ELSE 2 * y END''', 'y_hat')} FROM z CROSS JOIN (VALUES ('y'), ('twice')) v(c)")
def forecast_by_target(spark, d):
    rows = monthly(spark, d).withColumn("twice", F.col("y") * 2)
    return ByTarget(targets={"y": SeasonalNaive(seasonality=12), "twice": SeasonalNaive(seasonality=12)}, interval="1mo").fit(rows).predict(6)


@query(f"WITH {DAILY}, ends AS (SELECT g, min(time) AS a, max(time) AS b FROM daily GROUP BY g), grid AS (SELECT g, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS time FROM ends), f AS (SELECT grid.g, grid.time, coalesce(y, 0) AS y FROM grid LEFT JOIN daily ON daily.g = grid.g AND daily.time = grid.time), m AS (SELECT g, date_trunc('month', time) AS time, sum(y) AS y FROM f GROUP BY 1, 2), n AS (SELECT *, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY g) AS n FROM m), e AS (SELECT a.g, abs(a.y - b.y) AS e FROM n a JOIN n b ON a.g = b.g AND b.rn = a.rn - 12 WHERE a.rn > a.n - 12) SELECT g AS \"group\", {r('avg(e)', 'mae')} FROM e GROUP BY g")
def flagship_naive_mae(spark, d):
    """Daily quantities on a full grid, by month; the last twelve months forecast from the year before, and scored."""
    from pyspark.sql import Window

    from tidemark.operators.base import Operator

    full = on_grid(daily(spark, d).select("group", "time", "y"), "1d", Operator()).select("group", "time", F.coalesce("y", F.lit(0.0)).alias("y"))
    months = Downsampler(interval="1mo", aggregation="sum").transform(full)
    w = Window.partitionBy("group").orderBy(F.desc("time"))
    months = months.withColumn("_b", F.row_number().over(w))
    forecast = SeasonalNaive(seasonality=12, interval="1mo").fit(months.filter("_b > 12").drop("_b")).predict(12)
    truth = months.filter("_b <= 12").select("group", "time", "y")
    return point_score(forecast.join(truth, ["group", "time"]).withColumn("component", F.lit("y")), "mae", over=("step", "vintage", "component"))


@query(f"WITH {MONTHLY} SELECT g AS \"group\", count(*) AS n FROM monthly GROUP BY g")
def series_lengths(spark, d):
    return monthly(spark, d).groupBy("group").agg(F.count("*").alias("n"))


@query(f"WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY time DESC) - 1 AS b, count(*) OVER (PARTITION BY g) AS n, date_diff('month', min(time) OVER (PARTITION BY g), time) AS t FROM monthly), l AS (SELECT g, regr_slope(y, t) AS s, regr_intercept(y, t) AS i FROM n GROUP BY g), p AS (SELECT g, b % 12 AS k, avg(y) AS v FROM n WHERE b < n - n % 12 GROUP BY 1, 2) SELECT n.g AS \"group\", {r('avg(abs(y - i - s * t))', 'trend_mae')}, {r('avg(abs(y - v))', 'pattern_mae')} FROM n JOIN l ON l.g = n.g JOIN p ON p.g = n.g AND p.k = b % 12 GROUP BY n.g")
def decomposed_forecast_scores(spark, d):
    """In-sample error of a trend, as a check that needs no forecast."""
    rows = monthly(spark, d)
    fitted = PolynomialTrend(interval="1mo").fit(rows).fitted()
    pattern = PatternSeasonality(seasonality=12, interval="1mo").fit(rows).fitted().withColumnRenamed("y_hat", "p_hat")
    return rows.join(fitted, ["group", "time"]).join(pattern, ["group", "time"]).groupBy("group").agg(F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("trend_mae"), F.avg(F.abs(F.col("y") - F.col("p_hat"))).alias("pattern_mae"))


@query("SELECT event_type AS \"group\", count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_profile(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("group")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
