"""Operators on small tables: boundaries, nulls, inverses, sources and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.metrics.conformity import required_calibration_size
from tidemark.models.forecasters import Reduction, SeasonalNaive
from tidemark.operators.features import Arithmetic, OutlierThreshold
from tidemark.operators.intervals import Interval, add_interval, inferred
from tidemark.operators.resample import TimeImputer
from tidemark.operators.scalers import PowerTransformer, QuantileTransformer, SplineTransformer, StandardScaler
from tidemark.operators.windows import ExponentialMovingAverage, Lag, RollingStatistics
from tidemark.selection.search import expanding_window, sliding_window
from tidemark.sources.tsf import quantile_labelled, read_tsf, synthetic, write_tsf
from tidemark.streaming.observe import downsample, observe_predict

T0 = datetime(2021, 1, 1)


def series(spark, values, group="a", step=timedelta(days=1)):
    return spark.createDataFrame([(group, T0 + i * step, v) for i, v in enumerate(values)], "group string, time timestamp_ntz, y double")


def ys(df, c="y"):
    return [r[c] for r in df.orderBy("group", "time").collect()]


def test_interval_strings():
    assert Interval.parse("15m") == Interval(15, "min")
    assert Interval.parse("2mo").months == 2 and Interval.parse("1w").seconds == 604800
    assert add_interval(datetime(2021, 1, 31), "1mo") == datetime(2021, 2, 28)
    assert add_interval(datetime(2020, 11, 30), "1q") == datetime(2021, 2, 28)
    assert add_interval(datetime(2020, 2, 29), "1y", 4) == datetime(2024, 2, 29)
    with pytest.raises(ValueError):
        Interval.parse("1x")


def test_inferred_interval(spark):
    assert inferred(series(spark, [1.0] * 5)) == Interval(1, "d")
    assert inferred(series(spark, [1.0] * 5, step=timedelta(minutes=30))) == Interval(30, "min")
    months = spark.createDataFrame([("a", add_interval(T0, "1mo", i), 1.0) for i in range(15)], "group string, time timestamp_ntz, y double")
    assert inferred(months) == Interval(1, "mo")
    with pytest.raises(ValueError):
        inferred(series(spark, [1.0]).union(series(spark, [2.0])))


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_warm_up_lengths(spark, n):
    df = series(spark, [float(i) for i in range(n)])
    assert len(ys(Lag(lags=(3,)).transform(df), "y_lag_3")) == max(0, n - 3)
    assert len(ys(RollingStatistics(window_size=4).transform(df), "y_mean")) == max(0, n - 3)


def test_rolling_needs_full_windows(spark):
    out = ys(RollingStatistics(window_size=2, statistics=("mean",)).transform(series(spark, [1.0, None, 3.0, 5.0])), "y_mean")
    assert out == [None, None, 4.0]


def test_ewma_matches_pandas(spark):
    import pandas as pd

    values = [1.0, 2.0, None, 4.0, 3.0]
    for adjust in (True, False):
        for ignore in (True, False):
            got = ys(ExponentialMovingAverage(alpha=0.4, adjust=adjust, ignore_nulls=ignore).transform(series(spark, values)), "y_ewma")
            if adjust or ignore:
                want = pd.Series(values).ewm(alpha=0.4, adjust=adjust, ignore_na=ignore).mean().tolist()
                assert got == pytest.approx(want)


def test_imputer_ends_and_limit(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, None])
    assert ys(TimeImputer(method="linear").transform(df)) == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert ys(TimeImputer(method="forward", limit=1).transform(df)) == [None, 1.0, 1.0, None, 4.0, 4.0]
    assert ys(TimeImputer(method="nearest").transform(df)) == [1.0, 1.0, 1.0, 4.0, 4.0, 4.0]


def test_clip_keeps_nulls(spark):
    assert ys(OutlierThreshold(low=1, high=2).transform(series(spark, [0.0, None, 3.0]))) == [1.0, None, 2.0]


def test_division_by_zero_is_null(spark):
    df = series(spark, [1.0]).withColumn("x", F.lit(0.0))
    assert ys(Arithmetic(left="y", right="x", op="div").transform(df), "arithmetic") == [None]


def test_constant_column_scales_to_zero(spark):
    df = series(spark, [5.0] * 4)
    assert ys(StandardScaler().fit(df).transform(df)) == [0.0] * 4


def test_spline_basis_sums_to_one(spark):
    df = series(spark, [float(i) for i in range(20)])
    out = SplineTransformer().fit(df).transform(df)
    assert all(sum(r[2:]) == pytest.approx(1) for r in out.collect())


def test_quantile_and_power(spark):
    df = series(spark, [float(i * i) for i in range(50)])
    q = ys(QuantileTransformer(n_quantiles=11).fit(df).transform(df))
    assert q[0] == 0 and q[-1] == 1 and q == sorted(q)
    p = ys(PowerTransformer().fit(df).transform(df))
    assert sum(p) == pytest.approx(0, abs=1e-6) and sum(v * v for v in p) / 50 == pytest.approx(1)


def test_reduction_follows_a_line(spark):
    df = series(spark, [2.0 * i for i in range(30)])
    for strategy in ("multi-output", "direct", "dir-rec", "recursive"):
        got = [r.y_hat for r in Reduction(lags=(0, 1), strategy=strategy, horizon=3).fit(df).predict(3).orderBy("step").collect()]
        assert got == pytest.approx([60, 62, 64], rel=1e-6)


def test_folds():
    assert [(f.train_end, f.test_end) for f in expanding_window(10, 3, 2)] == [(4, 6), (6, 8), (8, 10)]
    assert [(f.train_start, f.train_end, f.test_end) for f in sliding_window(12, 2, 3, 4)] == [(2, 6, 9), (5, 9, 12)]
    with pytest.raises(ValueError):
        expanding_window(3, 3, 2)


def test_calibration_size():
    assert required_calibration_size(0.9, True) == 9
    assert required_calibration_size(0.9, False) == 19


def test_tsf_round_trip(spark, tmp_path):
    file = tmp_path / "a.tsf"
    file.write_text("# a comment\n@relation x\n@attribute series_name string\n@attribute start_timestamp date\n@frequency monthly\n@horizon 2\n@missing true\n@data\nT1:2020-01-31 00-00-00:1.0,?,3.5\nT2:2021-06-01 00-00-00:7\n")
    rows = read_tsf(spark, str(file)).orderBy("series_name", "time").collect()
    assert [(r.series_name, r.time.month, r.value) for r in rows] == [("T1", 1, 1.0), ("T1", 2, None), ("T1", 3, 3.5), ("T2", 6, 7.0)]
    write_tsf(read_tsf(spark, str(file)), str(tmp_path / "out"), "monthly")
    text = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out"))
    assert text.filter("value like 'T1:2020-01-31 00-00-00:1.0,?,3.5%'").count() == 1
    assert quantile_labelled(read_tsf(spark, str(file)), ["low", "high"]).count() == 3


def test_synthetic_is_reproducible(spark):
    a = synthetic(spark, 2, 10).orderBy("group", "time").collect()
    assert a == synthetic(spark, 2, 10).orderBy("group", "time").collect() and len(a) == 20


def test_stream_agrees_with_batch(spark, tmp_path):
    df = series(spark, [float(i) for i in range(10)]).union(series(spark, [100.0 + i for i in range(10)], "b"))
    for i in range(2):
        df.filter(F.dayofmonth("time").between(5 * i + 1, 5 * i + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = observe_predict(stream, 4, 3).writeStream.outputMode("update").format("memory").queryName("predicted").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.group, r.step): r.y_hat for r in spark.sql("SELECT * FROM predicted WHERE vintage_time = (SELECT max(vintage_time) FROM predicted)").collect()}
    want = {(r.group, r.step): r.y_hat for r in SeasonalNaive(seasonality=3).fit(df).predict(4).collect()}
    assert got == want


def test_stream_downsample(spark, tmp_path):
    df = series(spark, [1.0, 3.0, 5.0, 7.0], step=timedelta(minutes=30)).withColumn("time", F.col("time").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = downsample(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "1 hour", "0 minutes").writeStream.outputMode("append").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["mean"], r.n) for r in spark.sql("SELECT * FROM hours ORDER BY time").collect()] == [(2.0, 2)]
