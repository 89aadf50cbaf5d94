"""Queries of learned and signal operators; tests/test_library.py holds those without SQL against known cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.models import learned as ln
from tidemark.models.forecasters import SeasonalNaive
from tidemark.operators import signal as sg
from tidemark.operators.reshape import window_futures
from tidemark.plans.registry import DAILY, KEY, MONTHLY, daily, monthly, query, r, recursion, table


@query(f"{recursion(*sg.design('butterworth', 'lowpass', 2, 0.2))} SELECT {KEY}, {r('o1', 'y_filtered')} FROM e")
def filter_butterworth(spark, d):
    return sg.NumericalFilter(order=2, cutoff=0.2, columns=("y",)).transform(daily(spark, d))


@query(f"{recursion(*sg.design('chebyshev1', 'highpass', 3, 0.3))} SELECT {KEY}, {r('o1', 'y_filtered')} FROM e")
def filter_chebyshev_highpass(spark, d):
    return sg.NumericalFilter(design="chebyshev1", mode="highpass", order=3, cutoff=0.3, columns=("y",)).transform(daily(spark, d))


@query()
def impute_neighbours(spark, d):
    rows = daily(spark, d).withColumn("y", F.when(F.dayofmonth("time") % 5 != 0, F.col("y")))
    return sg.NeighbourImputer().transform(rows)


@query()
def step_components(spark, d):
    rows = daily(spark, d)
    steps = window_futures(rows, rows, 4, "1d", ("y",))
    return sg.StepReducer(bases=("y",)).fit(steps).transform(steps).select("group", "time", F.abs("y_pc_0").alias("y_pc_0"))


@query(f"WITH {DAILY} SELECT {KEY}, {r('y * 2', 'y')} FROM daily")
def function_transform(spark, d):
    rows = daily(spark, d).select("group", "time", "y")
    double = lambda df: df.withColumn("y", F.col("y") * 2)
    half = lambda df: df.withColumn("y", F.col("y") / 2)
    return sg.FunctionTransformer(func=double, inverse=half).fit(rows).transform(rows)


@query()
def forecast_interval_reduction(spark, d):
    return ln.IntervalReduction(lags=(0, 11), horizon=2, interval="1mo").fit(monthly(spark, d)).predict_interval(2)


@query()
def forecast_class_probabilities(spark, d):
    """The most frequent order state of a month, by priority."""
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("group"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time"), F.col("o_orderstatus").alias("y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("group", "time").orderBy(F.desc("n"), "y")
    rows = counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("group", "time", "y")
    return ln.ClassProbaReduction(interval="1mo").fit(rows).predict_proba(2)


@query(f"WITH {MONTHLY}, m AS (SELECT g, time, y, y * 0.5 + month(time) AS x, row_number() OVER (PARTITION BY g ORDER BY time DESC) AS b, max(time) OVER (PARTITION BY g) AS t1 FROM monthly) SELECT g AS \"group\", strftime(t1, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(t1 + INTERVAL 1 MONTH * (13 - b)::INTEGER, '%Y-%m-%d %H:%M:%S') AS time, (13 - b)::INTEGER AS step, {r('(SELECT regr_intercept(y, x) FROM m) + (SELECT regr_slope(y, x) FROM m) * x', 'y_hat')} FROM m WHERE b BETWEEN 7 AND 12")
def forecast_from_forecasted_feature(spark, d):
    rows = monthly(spark, d).withColumn("x", F.col("y") * 0.5 + F.month("time"))
    return ln.ForecastedFeature(features=("x",), feature_model=SeasonalNaive(seasonality=12), interval="1mo").fit(rows).predict(6)


@query(f"WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY time DESC) AS b, month(time)::DOUBLE AS m FROM monthly), s AS (SELECT g, greatest(stddev_pop(m), 1e-12) AS s FROM n WHERE b BETWEEN 2 AND 37 GROUP BY g), p AS (SELECT a.g, q.time AS qt, a.time, abs(a.m - q.m) / s AS d FROM n a JOIN n q ON a.g = q.g AND q.b = 1 JOIN s ON s.g = a.g WHERE a.b BETWEEN 2 AND 37), k AS (SELECT *, exp(-(d - min(d) OVER (PARTITION BY g, qt))) AS k FROM p) SELECT g AS \"group\", strftime(qt, '%Y-%m-%d %H:%M:%S') AS query_time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {r('k / (sum(k) OVER (PARTITION BY g, qt) + 1)', 'weight')} FROM k")
def similarity_weights(spark, d):
    w = Window.partitionBy("group").orderBy(F.desc("time"))
    rows = monthly(spark, d).withColumns({"_b": F.row_number().over(w), "m": F.month("time").cast("double")})
    return ln.similarity_weights(rows.filter("_b between 2 and 37"), rows.filter("_b = 1"), ("m",))
