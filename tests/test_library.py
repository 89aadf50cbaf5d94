"""Parts without a query of their own: checks, archives, memory, recurrences, filters, splits, contracts, streams."""

import datetime as dt
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.compose import kinds
from tidemark.functions import analytics as an
from tidemark.metrics import conformity as cf
from tidemark.metrics import scores as sc
from tidemark.models import exogenous as ex
from tidemark.models import learned as ln
from tidemark.models.forecasters import FourierSeasonality, PolynomialTrend, Reduction, SeasonalNaive
from tidemark.operators import features as ft
from tidemark.operators import scalers as sl
from tidemark.operators import scan, signal
from tidemark.operators import validation as v
from tidemark.operators.relational import less_than
from tidemark.operators.windows import ExponentialMovingAverage, Lag, SlidingWindowFunction
from tidemark.selection import validation as sv
from tidemark.sources import datasets
from tidemark.streaming import memory

START = dt.datetime(2024, 1, 1)


def series(spark, values, groups=("a",), unit="days"):
    rows = [(g, START + dt.timedelta(**{unit: i}), None if x is None else float(x)) for g in groups for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "group string, time timestamp_ntz, y double")


def values(df, column, by="time"):
    return [r[column] for r in df.orderBy("group", by).collect()]


# --- checks ------------------------------------------------------------------------------------------------------


def test_time_columns_and_schemas(spark):
    good = series(spark, [1, 2, 3])
    assert v.check_time_column(good) is good
    for bad in (good.drop("time"), good.withColumn("time", F.col("time").cast("string")), good.withColumn("time", F.when(F.col("y") > 1, F.col("time"))), good.union(good)):
        with pytest.raises(ValueError):
            v.check_time_column(bad)
    assert v.check_schema(good.select("y", "time", "group", F.lit(1).alias("z")), good.schema).columns == good.columns
    for bad in (good.drop("y"), good.withColumn("y", F.col("y").cast("int"))):
        with pytest.raises(ValueError):
            v.check_schema(bad, good.schema)
    ints = good.select("group", "time", F.lit(2.5).alias("y"))
    assert v.cast(ints, good.withColumn("y", F.lit(1)).schema).first()["y"] == 2
    assert v.numeric_columns(good) == ["y"] and v.categorical_columns(good) == ["group"] and v.stamps_of(good) == ["time"]


def test_continuity_and_days_of_month(spark):
    a, b = series(spark, range(5)), series(spark, range(8)).filter("y >= 5")
    v.check_continuity(a, b, "1d")
    v.check_continuity(a, b.filter("y >= 6"))
    for batch, interval in ((b.filter("y >= 6"), "1d"), (series(spark, range(8)).filter("y >= 4"), "1d"), (a, None)):
        with pytest.raises(ValueError):
            v.check_continuity(a, batch, interval)
    months = lambda days: spark.createDataFrame([("a", dt.datetime(2024, m, d), 1.0) for m, d in days], "group string, time timestamp_ntz, y double")
    assert v.check_day_of_month(months([(1, 31), (2, 29), (3, 31), (4, 30)])) and v.check_day_of_month(months([(1, 15), (2, 15)])) and v.check_day_of_month(months([(1, 30), (2, 29), (3, 30)]))
    assert not v.check_day_of_month(months([(1, 15), (2, 16)]))


def test_panels_and_names(spark):
    y = series(spark, range(4), ("a", "b"))
    v.check_panel_groups_match(y, y)
    with pytest.raises(ValueError):
        v.check_panel_groups_match(y, y.filter("group = 'a'"))
    assert v.check_groups(y, ["a"]).count() == 4
    with pytest.raises(ValueError):
        v.check_groups(y, ["z"])
    v.check_sufficient_rows(y, 4)
    for least, rows in ((5, y), (1, y.limit(0))):
        with pytest.raises(ValueError):
            v.check_sufficient_rows(rows, least)
    long = y.withColumn("member", F.lit("m"))
    v.check_panel_members(long, "member")
    with pytest.raises(ValueError):
        v.check_panel_members(long.union(y.limit(1).withColumn("member", F.lit("n"))), "member")
    v.validate_column_names(["a__x", "plain"])
    for bad in ("a___x", "a__b__c", "__x", "a__"):
        with pytest.raises(ValueError):
            v.validate_column_names([bad])
    assert [v.with_prefix("a__x", "p_"), v.with_suffix("x", "_s"), v.renamed_member("a__x", str.upper)] == ["a__p_x", "x_s", "a__X"]
    wide = spark.createDataFrame([(START, 1.0, 2.0, 3.0)], "time timestamp_ntz, a__x double, b__x double, z double")
    assert v.select_groups(wide, ["a"]).columns == ["time", "a__x", "z"] and v.select_groups(wide, ["a"], False).columns == ["time", "a__x"]


def test_other_checks(spark):
    v.check_horizon(None, allow_none=True)
    for bad in (0, -1, 1.5, True, None):
        with pytest.raises(ValueError):
            v.check_horizon(bad)
    v.check_covariates_given(None, 0)
    with pytest.raises(ValueError):
        v.check_covariates_given(None, 1)
    y = series(spark, range(6))
    assert v.validate_search_data(y, y) == v.check_inputs(y, None)
    with pytest.raises(ValueError):
        v.check_inputs(y, series(spark, range(6), unit="hours"))
    scored = y.withColumns({"component": F.lit("y"), "coverage_rate": F.lit(0.5)})
    assert v.select_scored(scored, ["a"], ["y"], [0.5]).count() == 6
    with pytest.raises(ValueError):
        v.select_scored(scored, rates=[0.9])
    vint = y.withColumn("vintage_time", F.lit(START))
    v.check_vintages(vint)
    for bad in (vint.union(vint), vint.withColumn("vintage_time", F.lit(None).cast("timestamp_ntz"))):
        with pytest.raises(ValueError):
            v.check_vintages(bad)
    assert v.reject_conflicting_forecasts(vint.union(vint), ["y"]).count() == 6
    with pytest.raises(ValueError):
        v.reject_conflicting_forecasts(vint.union(vint.withColumn("y", F.col("y") + 1)), ["y"])
    assert v.merge_forecasts(vint, vint.withColumnRenamed("y", "z")).columns == ["group", "vintage_time", "time", "y", "z"]
    with pytest.raises(ValueError):
        v.merge_forecasts(vint, vint)
    assert v.validate_view(y) == ["y"]
    for bad in (lambda: v.validate_view(y, ["q"]), lambda: v.validate_view(y, least=7), lambda: v.validate_view_options("x", ["y"]), lambda: v.validate_view_options(n_bins=0)):
        with pytest.raises(ValueError):
            bad()
    steps = y.select("group", "time", F.col("y").alias("x_step_1"), (F.col("y") * 2).alias("x_step_2"), F.col("y").alias("z_step_1"), (F.col("y") * F.col("y")).alias("z_step_2"))
    assert v.rank_deficient(steps, ["x", "z"], 2) == ["x"]
    assert [r["x_coverage"] for r in v.step_coverage(steps.withColumn("x_step_2", F.lit(None)), "x", 2).collect()] == [1] * 6


def test_a_contract_holds_later_inputs(spark):
    y = series(spark, range(10))
    c = v.Contract(least=3)
    with pytest.raises(ValueError):
        c.check(y)
    c.fit(y)
    assert c.interval.unit == "d" and c.check(y.select("y", "group", "time")).columns == y.columns
    for bad in (lambda: c.check(y, continues=True), lambda: c.check(y, x=y), lambda: v.Contract(least=11).fit(y), lambda: c.check_inverse(y, None, 1), lambda: c.check_inverse(y, y, 1)):
        with pytest.raises(ValueError):
            bad()
    c.check_inverse(y.filter("y >= 5"), y.filter("y < 5"), 5)


# --- archives and synthetic data ---------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    home = datasets.data_home(str(tmp_path / "data"))
    text = "@attribute series_name string\n@attribute start_timestamp date\n@frequency hourly\n@data\n" + "".join(f"{n}:2020-01-01 00-00-00:{','.join(map(str, x))}\n" for n, x in {"s_aq_PM2.5": [10, 20, 50, "?"], "s_aq_PM10": [1, 2, 3, 4], "s_aq_NO2": [1, 2, 3, 4], "s_aq_CO": [1, 2, 3, 4], "s_aq_O3": [1, 2, 3, 4], "s_aq_SO2": [1, 2, 3, 4], "t_aq_CO": [9, 9, 9, 9]}.items())
    with zipfile.ZipFile(f"{home}/kdd_cup.zip", "w") as z:
        z.writestr("kdd.tsf", text)
    with pytest.raises(FileNotFoundError):
        datasets.fetch(spark, "hospital", home=home)
    with pytest.raises(ValueError):
        datasets.fetch(spark, "nothing", home=home)
    rows = datasets.fetch_kdd_cup(spark, 1, home)
    assert {(r.station, r.measurement) for r in rows.collect()} == {("s_aq", m) for m in datasets.MEASUREMENTS}
    got = datasets.air_quality_classes(spark, home).orderBy("time").collect()
    assert [r.air_quality for r in got] == ["good", "moderate", "unhealthy"] and got[0].pm10 == 1
    with open(f"{home}/electricity_demand.tsf", "w") as f:
        f.write("@attribute series_name string\n@attribute start_timestamp date\n@frequency half_hourly\n@data\nT1:2020-01-01 00-00-00:1,2,3,4,5,6\n")
    assert [r.demand for r in datasets.demand_classes(spark, home=home).orderBy("time").collect()] == ["low"] * 2 + ["medium"] * 2 + ["high"] * 2
    datasets.clear_data_home(home)
    assert datasets.fetch(spark, "electricity_demand", 1, home).count() == 6


def test_synthetic_data(spark):
    b = datasets.exogenous_regression(spark, 72, 6)
    assert b.y.count() == b.actual.count() == b.future.count() == 72 and b.forecasts.count() == sum(min(6, 71 - i) for i in range(6, 72))
    assert b.future.agg(F.sum("is_holiday")).first()[0] == 24  # New Year's Day
    both = b.y.join(b.actual, ["group", "time"]).join(b.future, ["group", "time"])
    assert both.agg(F.max(F.abs(F.col("price") - 50 - 2 * F.col("temperature") - 10 * F.col("is_holiday")))).first()[0] < 1
    c = datasets.exogenous_classification(spark, 72)
    assert {r[0] for r in c.y.select("air_quality").distinct().collect()} <= set(c.classes) == {"good", "moderate", "poor"}


# --- recurrences -------------------------------------------------------------------------------------------------


def ewma(xs, alpha, adjust, ignore):
    out, m, w = [], None, 0.0
    for x in xs:
        old = w * (1 - alpha)
        if x is None:
            w = w if ignore else old
        elif m is None:
            m, w = x, 1.0
        else:
            own = 1.0 if adjust else alpha
            m, w = (old * m + own * x) / (old + own), old + own if adjust else 1.0
        out.append(m)
    return out


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore", [True, False])
def test_smoothing_over_chunks(spark, monkeypatch, adjust, ignore):
    monkeypatch.setattr("tidemark.operators.windows.linear_scan", lambda *a: scan.linear_scan(*a, size=7))
    rng = np.random.default_rng(1)
    xs = [None, None, *(None if rng.random() < 0.3 else float(rng.normal()) for _ in range(60))]
    got = values(ExponentialMovingAverage(alpha=0.3, adjust=adjust, ignore_nulls=ignore).transform(series(spark, xs)), "y_ewma")
    assert got[:2] == [None, None] and np.allclose(got[2:], ewma(xs, 0.3, adjust, ignore)[2:])


def test_clipped_walk_over_chunks(spark):
    errors = (np.random.default_rng(2).random(100) < 0.6).astype(float)
    got = values(scan.clipped_walk(series(spark, errors), 0.2 * (0.3 - F.col("y")), 0.3, 0.05, 0.9, out="alpha", size=9), "alpha")
    a, want = 0.3, []
    for e in errors:
        want.append(a)
        a = min(0.9, max(0.05, a + 0.2 * (0.3 - e)))
    assert np.allclose(got, want)


def slow_filter(x, b, a):
    y = []
    for i in range(len(x)):
        y.append(sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k))
    return y


@pytest.mark.parametrize(("options", "order"), [({"order": 2, "cutoff": 0.2}, 2), ({"design": "chebyshev1", "mode": "highpass", "order": 3, "cutoff": 0.3}, 3), ({"mode": "bandpass", "order": 2, "cutoff": (0.2, 0.4)}, 4)])
def test_filters_over_chunks(spark, options, order, monkeypatch):
    x = np.random.default_rng(3).normal(size=700)
    kind = options.get("design", "butterworth")
    b, a = signal.design(kind, options.get("mode", "lowpass"), options["order"], options["cutoff"])
    assert len(a) == order + 1 and np.abs(np.roots(a)).max() < 1
    got = values(signal.NumericalFilter(**options).transform(series(spark, x)), "y_filtered")
    assert np.allclose(got, slow_filter(x, b, a))
    if order == 2:
        both = values(signal.NumericalFilter(**options, zero_phase=True).transform(series(spark, x)), "y_filtered")
        assert np.allclose(both, slow_filter(slow_filter(x, b, a)[::-1], b, a)[::-1])


def test_designs_have_the_known_response():
    """Half the power at a Butterworth cutoff; the ripple, and no more, in a Chebyshev passband; one at rest or at Nyquist."""
    at = lambda b, a, f: abs(np.polyval(b, np.exp(1j * np.pi * f)) / np.polyval(a, np.exp(1j * np.pi * f)))
    for order in (1, 2, 5):
        low, high = signal.design("butterworth", "lowpass", order, 0.3), signal.design("butterworth", "highpass", order, 0.3)
        assert np.allclose([at(*low, 0.3), at(*high, 0.3)], np.sqrt(0.5)) and np.allclose([at(*low, 0), at(*high, 1)], 1)
    b, a = signal.design("chebyshev1", "lowpass", 4, 0.4, ripple=1.0)
    band = [at(b, a, f) for f in np.linspace(0, 0.4, 200)]
    assert max(band) <= 1 + 1e-9 and np.isclose(min(band), 10 ** (-1 / 20), atol=1e-4)


def test_long_series_take_time_in_proportion(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit("a").alias("group"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("time"), F.sin("id").alias("y"))
        t = time.time()
        out = ExponentialMovingAverage(alpha=0.1).transform(rows).agg(F.count("y_ewma")).first()[0]
        assert out == n
        return time.time() - t

    seconds(1000)
    small, large = seconds(100_000), seconds(1_000_000)
    assert large < 20 * small + 20


def test_window_functions_over_chunks(spark):
    op = SlidingWindowFunction(func=lambda rows: {"s": float(rows["y"].sum())}, window_size=3, schema="s double", chunk=5)
    xs = list(range(17))
    assert values(op.transform(series(spark, xs)), "s") == [sum(xs[i - 2 : i + 1]) for i in range(2, 17)]
    assert op.transform(series(spark, [1, 2])).count() == 0


# --- known cases of queries without SQL ---------------------------------------------------------------------------


def test_neighbours_fill_gaps(spark):
    rows = [("a", START + dt.timedelta(days=i), x, z) for i, (x, z) in enumerate([(1.0, 10.0), (2.0, 20.0), (3.0, 30.0), (None, 21.0), (100.0, 1000.0)])]
    df = spark.createDataFrame(rows, "group string, time timestamp_ntz, y double, z double")
    got = signal.NeighbourImputer(n_neighbors=2).transform(df).orderBy("time").collect()
    assert got[3].y == 2.5 and [r.y for i, r in enumerate(got) if i != 3] == [1, 2, 3, 100]  # nearest by z: 20 and 30


def test_step_components_are_principal_axes(spark):
    x = np.random.default_rng(0).normal(size=(40, 3)) @ np.diag([3.0, 1.0, 0.1])
    df = spark.createDataFrame([("a", START + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(x)], "group string, time timestamp_ntz, y_step_1 double, y_step_2 double, y_step_3 double")
    got = np.array([[r.y_pc_0, r.y_pc_1] for r in signal.StepReducer(bases=("y",)).fit(df).transform(df).orderBy("time").collect()])
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    got = got - got.mean(axis=0)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_quadratic_trend_fourier_and_dirrec(spark):
    t = np.arange(40)
    quadratic = PolynomialTrend(degree=2, pooled=True).fit(series(spark, 3 + 2 * t + 0.5 * t**2))
    assert np.allclose(values(quadratic.predict(3), "y_hat"), [3 + 2 * k + 0.5 * k * k for k in (40, 41, 42)])
    wave = 5 + 2 * np.sin(2 * np.pi * t / 7) - np.cos(2 * np.pi * t / 7)
    fourier = FourierSeasonality(seasonality=7.0).fit(series(spark, wave))
    assert np.allclose(values(fourier.predict(7), "y_hat"), 5 + 2 * np.sin(2 * np.pi * np.arange(40, 47) / 7) - np.cos(2 * np.pi * np.arange(40, 47) / 7))
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=60))
    got = values(Reduction(lags=(0, 1), strategy="dir-rec", horizon=2).fit(series(spark, y)).predict(2), "y_hat")
    x1 = np.column_stack([np.ones(58), y[1:-1], y[:-2]])
    b1 = np.linalg.lstsq(x1, y[2:], rcond=None)[0]
    x2 = np.column_stack([x1[:-1], x1[:-1] @ b1])
    b2 = np.linalg.lstsq(x2, y[3:], rcond=None)[0]
    last = np.array([1, y[-1], y[-2]])
    assert np.allclose(got, [last @ b1, np.append(last, last @ b1) @ b2])


def test_quantile_regressions_and_class_probabilities(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=400))
    df = series(spark, x)
    got = ln.IntervalReduction(lags=(0,), horizon=1, rates=(0.8,)).fit(df).predict_interval(1).first()
    z = 1.2816
    assert abs((got.upper - x[-1]) - z) < 0.35 and abs((x[-1] - got.lower) - z) < 0.35
    rows = df.withColumn("y", F.when(F.dayofweek("time").isin(1, 7), "rest").otherwise("work"))
    p = {r.label: r.p for r in ln.ClassProbaReduction(lags=(0, 1, 2, 3, 4, 5, 6), horizon=1).fit(rows).predict_proba(1).collect()}
    truth = "rest" if (START + dt.timedelta(days=400)).weekday() >= 5 else "work"
    assert abs(sum(p.values()) - 1) < 1e-9 and p[truth] > 0.9


def test_forecasted_features(spark):
    df = series(spark, range(20)).withColumn("x", F.col("y") % 4).withColumn("y", 1 + 3 * F.col("x"))
    got = values(ln.ForecastedFeature(features=("x",), feature_model=SeasonalNaive(seasonality=4)).fit(df).predict(4), "y_hat")
    assert np.allclose(got, [1, 4, 7, 10])


def test_daylight_saving(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 3, d, 12), 1.0) for d in (29, 30, 31)] + [("a", dt.datetime(2024, 4, 1, 12), 1.0)], "group string, time timestamp_ntz, y double")
    out = ft.DaylightSaving(time_zone="Europe/Berlin").transform(rows)
    assert [values(out, f"dst_{c}") for c in ("in_effect", "transition_day", "transition_type")] == [[0, 0, 1, 1], [0, 0, 1, 0], [0, 0, 1, 0]]


def test_quantile_power_and_spline_transforms(spark):
    rng = np.random.default_rng(3)
    df = series(spark, np.exp(rng.normal(size=300)))
    q = np.array(values(sl.QuantileTransformer().fit(df).transform(df), "y"))
    y = np.array(values(df, "y"))
    assert np.allclose(np.sort(q), np.sort(np.argsort(np.argsort(y))) / 299, atol=0.02) and q.min() >= 0 and q.max() <= 1
    p = np.array(values(sl.PowerTransformer().fit(df).transform(df), "y"))
    assert abs(p.mean()) < 1e-6 and abs(p.std() - 1) < 1e-6 and abs(((p - p.mean()) ** 3).mean()) < 0.3
    out = sl.SplineTransformer().fit(df).transform(df)
    names = [c for c in out.columns if c not in ("group", "time", "y")]
    sums = [sum(r[c] for c in names) for r in out.collect()]
    assert np.allclose(sums, 1)  # a partition of unity


# --- models, similarities, memory -------------------------------------------------------------------------------


def test_library_estimators_and_local_panels(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    df = series(spark, [i % 4 for i in range(60)], ("a", "b"))
    tree = ex.ExogenousReduction(lags=(0, 1, 2, 3), horizon=2, estimator=ex.Library(DecisionTreeRegressor(maxDepth=4)))
    assert np.allclose(values(tree.fit(df).predict(2), "y_hat"), [0, 1, 0, 1])
    two = df.withColumn("y", F.when(F.col("group") == "a", F.col("y")).otherwise(-2 * F.col("y")))
    local = ex.LocalPanel(model=ex.ExogenousReduction(lags=(0, 1, 2, 3), horizon=1)).fit(two).predict(1)
    assert np.allclose(values(local, "y_hat"), [0, 0], atol=1e-6)
    with pytest.raises(ValueError):
        ex.LocalPanel(model=ex.ExogenousReduction(), most_series=1).fit(two)
    both = ex.Residual(base=PolynomialTrend(), rest=SeasonalNaive(seasonality=4)).fit(df.withColumn("y", F.col("y") + F.datediff("time", F.lit(START))))
    assert both.predict(2).count() == 4


def test_adaptive_levels_follow_misses(spark):
    rng = np.random.default_rng(0)
    got = ex.Conformal(model=SeasonalNaive(), calibration_size=60, horizon=1).fit(series(spark, rng.normal(size=200))).predict_adaptive(0.2, 0.05).orderBy("time").toPandas()
    a = 0.2
    for level, miss in zip(got["alpha"], got["error"]):
        assert np.isclose(level, a)
        a = min(1.0, max(0.0, a + 0.05 * (0.2 - miss)))
    assert 0.1 < got["error"].iloc[20:].mean() < 0.35


def test_weights_of_calibration_sets(spark):
    assert cf.warn_if_calibration_too_small(100, 0.8, True, 1) is False
    with pytest.warns(UserWarning):
        assert cf.warn_if_calibration_too_small(2, 0.9, True, 1)
    w = spark.createDataFrame([("q", 1, 0.6), ("q", 2, 0.2), ("r", 1, 0.9), ("r", 2, 0.0)], "query string, time int, weight double")
    sizes = {r["query"]: (r.effective_size, r.collapsed) for r in cf.effective_sizes(w, ("query",)).collect()}
    assert np.isclose(sizes["q"][0], 0.64 / 0.4) and sizes["q"][1] and sizes["r"] == (1.0, True)
    with pytest.warns(UserWarning):
        assert cf.warn_if_weights_collapsed(w, ("query",)) == 2
    wide = cf.global_calibration_weights(w.filter("query = 'q'"), 3, ("query",)).orderBy("time", "column").collect()
    raw = np.repeat(np.array([0.6, 0.2]) / 0.2, 3)
    assert np.allclose([r.weight for r in wide], raw / (raw.sum() + 1))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) + rng.normal(size=(50, 1))
    rows = [(str(j), 1, i, float(x[i, j])) for i in range(50) for j in range(4)]
    found = cf.diagnose_global_calibration(spark.createDataFrame(rows, "group string, step int, time int, score double")).first()
    corr = np.corrcoef(x.T)[np.triu_indices(4, 1)].mean()
    low, high = np.percentile(np.abs(x).mean(axis=0), [10, 90])
    assert np.isclose(found.cross_sectional_correlation, corr) and np.isclose(found.effective_gain, 4 / (1 + 3 * corr)) and np.isclose(found.score_heterogeneity, high / low)
    bounds = spark.createDataFrame([(5.0, 6.0, 8.0), (7.0, 6.0, 8.0)], "y double, lower double, upper double")
    assert [r.score for r in cf.QuantileResidual().score(bounds).collect()] == [1, -1] and [r.score for r in cf.AbsoluteQuantileResidual().score(bounds).collect()] == [1, 0]
    moved = cf.QuantileResidual().interval(bounds, F.lit(0.0), F.lit(0.5)).first()
    assert (moved.lower, moved.upper) == (5.5, 8.5)


def test_scorers_by_name_and_weights(spark):
    rows = spark.createDataFrame([("g", "c", dt.datetime(2024, 1, vt), dt.datetime(2024, 1, vt + s), s, 10.0, 10.0 - s * vt, float(s), float(vt)) for vt in (1, 2) for s in (1, 2)], "group string, component string, vintage_time timestamp_ntz, time timestamp_ntz, step int, y double, y_hat double, w double, vw double")
    assert sc.get_scorer("mae").score(rows).first()[0] == (1 + 2 + 2 + 4) / 4
    assert sc.get_scorer("mae").signed(rows).first()[0] == -(1 + 2 + 2 + 4) / 4
    weighted = sc.make_scorer("mae", weight="w").score(rows).first()[0]  # weights 1 and 2, scaled to 2/3 and 4/3
    assert np.isclose(weighted, np.mean([(1 * 2 / 3 + 2 * 4 / 3) / 2, (2 * 2 / 3 + 4 * 4 / 3) / 2]))
    assert np.isclose(sc.make_scorer("mae", vintage_weight="vw").score(rows).first()[0], (1.5 * 1 + 3 * 2) / 3)
    with pytest.raises(ValueError):
        sc.get_scorer("nothing")
    rated = rows.select("*", F.explode(F.array(*map(F.lit, (0.5, 0.8)))).alias("coverage_rate")).withColumns({"lower": F.col("y_hat") - F.col("coverage_rate"), "upper": F.col("y_hat") + F.col("coverage_rate")})
    for f in (sc.crps, sc.calibration_error):
        assert f(rated).first()[0] is not None
        with pytest.raises(ValueError):
            f(rated.filter("coverage_rate = 0.5"))
    weights = sc.trapezoidal_weights([0.5, 0.8])
    assert np.isclose(sum(weights.values()), 1) and np.isclose(weights[0.8], 2 * (0.1 + 0.25) / 2)
    losses = {r: sc.crps(rated.withColumn("coverage_rate", F.when(F.col("coverage_rate") == r, r).otherwise(r + 1e-12)).filter(F.col("lower") == F.col("y_hat") - r).unionByName(rated.filter(F.col("coverage_rate") == r).withColumn("coverage_rate", F.lit(r + 1e-9)))).first()[0] for r in (0.5, 0.8)}
    assert np.isclose(sc.crps(rated, integration="trapezoidal").first()[0], sum(weights[r] * losses[r] for r in weights), rtol=1e-6)


def test_partial_vintages_go(spark):
    def rows(days):
        return spark.createDataFrame([(dt.datetime(2024, 1, d), 1.0) for d in days], "vintage_time timestamp_ntz, y double")

    assert sc.without_partial_vintage(rows([1, 8, 15, 17])).count() == 3
    assert sc.without_partial_vintage(rows([1, 8, 15, 22])).count() == 4
    assert sc.without_partial_vintage(rows([1, 3])).count() == 2 and sc.without_partial_vintage(rows([])).count() == 0


def test_memory_of_operators_and_forecasters(spark):
    df = series(spark, range(12), ("a", "b"))
    op = memory.Observing(Lag(lags=(2,)), 2, "1d").fit(df.filter("y < 6"))
    first = op.observe_transform(df.filter("y between 6 and 8"))
    assert values(first, "y_lag_2") == [4, 5, 6] * 2
    with pytest.raises(ValueError):
        op.observe(df.filter("y >= 10"))
    op.observe(df.filter("y = 9"))
    assert values(op.observe_transform(df.filter("y >= 10")), "y_lag_2") == [8, 9] * 2
    op.rewind(df.filter("y < 3"))
    assert values(op.memory.rows, "y") == [1, 2] * 2
    assert values(op.rewind_transform(df), "y_lag_2") == [*range(10)] * 2
    model = memory.ObservingForecaster(SeasonalNaive(seasonality=3), 3).fit(df.filter("y < 6"))
    assert values(model.predict(2), "y_hat") == [3, 4] * 2
    rolled = model.observe_predict(df.filter("y between 6 and 9"), 1, stride=2)
    assert values(rolled, "y_hat", "vintage_time") == [5, 7] * 2 and values(model.predict(1), "y_hat") == [7] * 2
    assert values(model.rewind(df.filter("y < 4")).predict(1), "y_hat") == [1] * 2


def test_retained_vintages(spark):
    t = lambda d: START + dt.timedelta(days=d)
    f = spark.createDataFrame([("a", t(vt), t(vt + h), 1.0) for vt in (0, 2, 4, 9) for h in (1, 2, 3)], "group string, vintage_time timestamp_ntz, time timestamp_ntz, x double")
    kept = memory.retained_vintages(f, series(spark, range(6)))
    assert {r.vintage_time for r in kept.collect()} == {t(4), t(9)}


# --- selection ----------------------------------------------------------------------------------------------------


def test_cross_validation_by_fold(spark):
    df = series(spark, [i % 3 for i in range(24)], ("a", "b"))
    model = SeasonalNaive(seasonality=3)
    assert {r.mae for r in sv.cross_val_score(model, df, 3, cv=2).collect()} == {0.0}
    plain = sv.cross_val_score(SeasonalNaive(), df, 3, cv=2).orderBy("fold").collect()
    turned = sv.cross_val_score(SeasonalNaive(), df, 3, cv=2, greater_is_better=True).orderBy("fold").collect()
    assert [r.mae for r in plain] == [-r.mae for r in turned] and plain[0].mae > 0
    rows = sv.cross_val_predict(model, df, 3, cv=2)
    assert rows.count() == 2 * 2 * 3 and rows.filter("y_hat is null").count() == 0
    strided = sv.cross_val_predict(model, df, 2, cv=sv.Sliding(n_splits=1, test_size=6, stride=6), stride=2)
    assert strided.groupBy("group", "vintage_time", "time").count().filter("count > 1").count() == 0 and strided.count() > 4
    inter = sv.cross_val_predict(ex.Conformal(model=model, calibration_size=6, horizon=3), df, 3, cv=2, rates=(0.5,))
    assert {"lower", "upper", "coverage_rate"} <= {*inter.columns} and inter.count() == 12
    assert [r.mae for r in sv.cross_val_score(ex.Conformal(model=ex.LocalPanel(model=ex.ExogenousReduction(), most_series=1), calibration_size=3), df, 1, cv=2, error_score=-1.0).collect()] == [-1.0, -1.0]
    best = sv.Search(SeasonalNaive(), [{"seasonality": s} for s in (1, 2, 3)], cv=2, horizon=3).fit(df)
    assert best.best_params == {"seasonality": 3} and values(best.predict(3), "y_hat") == [0, 1, 2] * 2
    assert {r.candidate: r["rank"] for r in best.results.collect()}[2] == 1


def test_splitters(spark):
    assert isinstance(sv.check_cv(3, 2), sv.Expanding) and len(sv.check_cv(3, 2).split(20)) == 3
    given = sv.Expanding(2, 3).split(12)
    assert sv.check_cv(given).split(99) == given
    assert sv.check_cv_alignment(sv.Sliding(3, 10, stride=4), 4) == {"n_vintages": 4, "steps_per_vintage": [4] * 4, "step_counts": dict.fromkeys((1, 2, 3, 4), 4), "is_balanced": False}
    assert sv.check_cv_alignment(sv.Expanding(3, 4), 4)["n_vintages"] == 2 and sv.check_cv_alignment(sv.check_cv(given), 1)["is_balanced"] is None
    nested = sv.fold_table(given, sv.Expanding(1, 2))
    assert (0, None, "test", 6, 9) in nested and (0, 0, "test", 4, 6) in nested
    df = series(spark, range(12))
    from tidemark.selection.search import fold_rows

    f = df.select("group", F.col("time").alias("vintage_time"), "time", "y")
    parts = sv.split_forecasts(f, fold_rows(df, given))
    assert {(r.fold, r.part): r["count"] for r in parts.groupBy("fold", "part").count().collect()} == {(0, "train"): 6, (0, "test"): 3, (1, "train"): 9, (1, "test"): 3}


def test_shared_rounds_of_boosted_trees(spark):
    assert sv.shared_rounds({"m": [([3.0, 1.0, 2.0], False), ([3.0, 2.0, 0.0, 0.0], False)]}) == ({"m": 3}, {"m": True})
    assert sv.shared_rounds({"m": [([1.0, 2.0, 2.0], True)]}) == ({"m": 2}, {"m": False})
    for bad in ({"m": []}, {"m": [([], True)]}, {"m": [([1.0], True), ([1.0], False)]}):
        with pytest.raises(ValueError):
            sv.shared_rounds(bad)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(80).select((F.col("id") / 10).alias("x"), (F.sin(F.col("id") / 10) + 0.3 * F.randn(1)).alias("label")))
    folds = [(rows.filter(f"cast(x * 10 as int) % 4 != {i}"), rows.filter(f"cast(x * 10 as int) % 4 = {i}")) for i in range(2)]
    n, last, cut = sv.evaluate_shared_rounds(GBTRegressor(maxDepth=2, seed=1), sv.GradientBoostedTrees, folds, 4)
    assert 1 <= n <= 4 and last == (n == 4) and cut[0](folds[0][1]).filter("prediction is null").count() == 0


# --- contracts, analytics, streams ------------------------------------------------------------------------------


def test_the_users_own_parts(spark):
    df = series(spark, [1, 2, 3])

    class Double(kinds.SeriesOperator):
        def transform(self, df):
            return df.withColumn("y", F.col("y") * 2)

    class Weekend(kinds.Segmenter):
        def labels(self, time="time"):
            return F.when(F.dayofweek(time).isin(1, 7), F.lit("weekend"))

    class Late(kinds.Weighter):
        def weights(self, time="time"):
            return F.dayofmonth(time).cast("double")

    assert values(Double().fit_transform(df), "y") == [2, 4, 6]
    assert df.select(Weekend().labels().alias("s")).filter("s is null").count() == 3
    assert values(Late().weighted(df), "weight") == [1, 2, 3]
    for bad in (F.lit(None).cast("double"), F.lit(-1.0), F.lit(0.0), F.lit(float("nan"))):
        with pytest.raises(ValueError):
            kinds.validated_weights(df.withColumn("weight", bad))
    kinds.check_homogeneous_kinds({"a": Double(), "b": Lag()}, "Union")
    with pytest.raises(ValueError):
        kinds.check_homogeneous_kinds({"a": Double(), "b": kinds.VintageOperator()}, "Union")
    assert {"forecaster", "splitter"} <= {*kinds.contracts()} and "Lag" in kinds.discovered() and kinds.common_kind({}) == "series"
    w = df.withColumn("weight", F.col("y"))
    assert [values(kinds.window_weights(w, 2, how), "sample_weight")[0] for how in ("first", "last", "mean", "max", "min", "decay")] == [2, 3, 2.5, 3, 2, (2 + 1.5) / 1.5]
    assert values(kinds.window_weights(w, 2), "sample_weight")[1:] == [None, None]
    with pytest.raises(ValueError):
        kinds.StepOperator(least_steps=2).steps(df.withColumn("y_step_1", F.lit(1)), "y")


def test_foreign_stages(spark):
    from pyspark.ml.feature import PCA, MaxAbsScaler

    df = series(spark, [1, -2, 4]).withColumn("z", F.col("y") * 3)
    assert values(kinds.Foreign(stage=MaxAbsScaler()).fit_transform(df), "z") == [0.25, -0.5, 1.0]
    assert kinds.Foreign(stage=PCA(k=1)).fit_transform(df).columns == ["group", "time", "out_0"]


def test_stl_finds_season_and_trend(spark):
    t = np.arange(96)
    season = 3 * np.sin(2 * np.pi * t / 12)
    out = an.stl(series(spark, 10 + 0.1 * t + season, unit="days"), (12,)).orderBy("time").toPandas()
    assert np.abs(out["seasonal_12"] - season).max() < 0.2 and np.abs(out["trend"] - 10 - 0.1 * t).max() < 0.2
    assert np.allclose(out["observed"], out["trend"] + out["seasonal_12"] + out["residual"]) and np.allclose(out["seasonal_adjusted"], out["observed"] - out["seasonal_12"])
    weekly = 2 * np.cos(2 * np.pi * t / 7)
    two = an.stl(series(spark, 10 + season + weekly), (12, 7), robust=False).orderBy("time").toPandas()
    assert np.abs(two["seasonal_12"] - season).max() < 0.8 and np.abs(two["seasonal_7"] - weekly).max() < 0.8
    grown = an.stl(series(spark, (10 + 0.1 * t) * np.exp(season / 10)), (12,), multiplicative=True).toPandas()
    assert np.allclose(grown["observed"], grown["trend"] * grown["seasonal_12"] * grown["residual"])
    with pytest.raises(Exception, match="two cycles"):
        an.stl(series(spark, range(20)), (12,)).collect()


def test_density_and_phase(spark):
    x = np.random.default_rng(0).normal(size=2000)
    got = an.kernel_density(series(spark, x), 41).orderBy("x").toPandas()
    h = x.std(ddof=1) * 2000**-0.2
    want = [np.exp(-(((p - x) / h) ** 2) / 2).sum() / (2000 * h * np.sqrt(2 * np.pi)) for p in got["x"]]
    assert np.allclose(got["density"], want, atol=2e-3)
    y = np.cos(2 * np.pi * np.arange(32) * 4 / 32 + 0.7)
    found = an.spectrum(series(spark, y), unwrap=False).filter("power > 1").collect()
    assert len(found) == 1 and np.isclose(found[0].frequency, 1 / 8) and np.isclose(found[0].phase, 0.7)


def test_counts_above(spark):
    x = np.random.default_rng(0).integers(0, 50, 300)
    rows = spark.createDataFrame([(float(i),) for i in x], "x double")
    got = less_than(rows.filter("x < 10"), rows.withColumnRenamed("x", "y"), "x", "y").collect()
    assert len(got) == (x < 10).sum() and all(r.n_above == (x > r.x).sum() for r in got)
    assert less_than(rows.limit(0), rows.withColumnRenamed("x", "y"), "x", "y").collect() == []


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    minutes = [0, 5, 5, 60, 62, 300]
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), float(m)) for m in minutes]
    for i, part in enumerate((rows[:3], rows[3:], [("a", dt.datetime(2024, 1, 3), 0.0)], [("a", dt.datetime(2024, 1, 1), -1.0)])):
        spark.createDataFrame(part, "group string, time timestamp, y double").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05 * (i < 3))
    stream = lambda: spark.readStream.schema("group string, time timestamp, y double").option("maxFilesPerTrigger", 1).parquet(source)
    once = memory.without_late_rows(stream(), "1 hour")
    query = memory.to_table(once, str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    assert first == 6  # the repeated stamp and the late row are gone
    again = memory.to_table(memory.without_late_rows(stream(), "1 hour"), str(tmp_path / "out"), str(tmp_path / "log"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == first  # nothing twice after a restart
    query = memory.to_table(memory.session_counts(stream(), "30 minutes", "1 hour"), str(tmp_path / "sessions"), str(tmp_path / "log2"))
    query.awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "sessions")).collect()) == [1, 2, 3]


def test_pandas_stays_out_of_the_plans_of_window_operators(spark):
    plan = ExponentialMovingAverage().transform(series(spark, [1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# --- grids, archives of text, pipelines backwards, models rolled ----------------------------------------------------


def test_intervals_of_grids(spark):
    from tidemark.operators.intervals import Interval, inferred, representative

    assert inferred(series(spark, range(4))) == Interval(1, "d") and inferred(series(spark, range(4), unit="hours")) == Interval(1, "h")
    months = spark.createDataFrame([("a", dt.datetime(2024, m, 1)) for m in range(1, 7)], "group string, time timestamp_ntz")
    assert inferred(months) == Interval(1, "mo")
    jitter = spark.range(3000).select(F.lit("a").alias("group"), F.timestamp_micros(F.col("id") * 1_000_000 + F.col("id") * F.col("id") % 997).cast("timestamp_ntz").alias("time"))
    assert abs(inferred(jitter).seconds - 1) < 0.01
    gap = jitter.filter("minute(time) != 20")
    assert abs(inferred(gap).seconds - 1) < 0.01 and abs(representative(gap).seconds - 1) < 0.01  # a minute is within the hour
    with pytest.raises(ValueError):
        inferred(spark.createDataFrame([("a", START + dt.timedelta(days=d)) for d in (0, 1, 5)], "group string, time timestamp_ntz"))
    assert representative(spark.createDataFrame([("a", START + dt.timedelta(hours=h)) for h in (0, 1, 2, 9, 10)], "group string, time timestamp_ntz")) == Interval(1, "h")
    for bad in (series(spark, [1]), series(spark, [1, 2]).withColumn("time", F.lit(START))):
        with pytest.raises(ValueError):
            representative(bad)


def test_text_archives_both_ways(spark, tmp_path):
    from tidemark.sources import tsf

    rows = spark.createDataFrame([("s1", START + dt.timedelta(days=i), x) for i, x in enumerate([1.0, None, 3.5])] + [("s2", START, 7.0)], "series_name string, time timestamp_ntz, value double")
    tsf.write_tsf(rows, str(tmp_path / "x"), "daily")
    got = tsf.read_tsf(spark, str(tmp_path / "x" / "*"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    (tmp_path / "no.tsf").write_text("@attribute series_name string\n")
    with pytest.raises(ValueError):
        tsf.read_tsf(spark, str(tmp_path / "no.tsf"))
    (tmp_path / "plain.tsf").write_text("@attribute series_name string\n@frequency monthly\n@data\na:1,2\nb:3\n")
    plain = tsf.read_tsf(spark, str(tmp_path / "plain.tsf")).orderBy("series_name", "time").collect()
    assert [(r.series_name, r.time.month, r.value) for r in plain] == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)]


def test_pipelines_backwards(spark):
    from tidemark.compose.pipeline import Pipeline
    from tidemark.operators.scalers import StandardScaler
    from tidemark.operators.stationarity import Log, SeasonalDifferencing

    df = series(spark, [2.0 ** (i % 5) + i for i in range(20)])
    both = Pipeline(steps=(StandardScaler(), SeasonalDifferencing(seasonality=5))).fit(df)
    changed = both.transform(df)
    past = df.filter(F.col("time") < F.lit(START + dt.timedelta(days=10)))
    back = both.inverse_transform(changed.filter(F.col("time") >= F.lit(START + dt.timedelta(days=10))), past)
    column = next(c for c in back.columns if c not in ("group", "time"))
    assert np.allclose(values(back, column), values(df, "y")[10:])
    with pytest.raises(ValueError):
        both.inverse_transform(changed)
    logs = Pipeline(steps=(Log(offset=1.0),)).fit(df)
    back = logs.inverse_transform(logs.transform(df))
    assert np.allclose(values(back, next(c for c in back.columns if c not in ("group", "time"))), values(df, "y"))
    with pytest.raises(ValueError):
        Pipeline(steps=(Lag(),)).fit(df).inverse_transform(df)


def test_models_rolled_over_rows(spark):
    from tidemark.models.forecasters import MeanSeasonalNaive, PatternSeasonality

    y = [float(i % 3) + i / 10 for i in range(30)]
    df = series(spark, y, ("a", "b"))
    head = df.filter(F.col("time") < F.lit(START + dt.timedelta(days=24)))
    for model in (SeasonalNaive(seasonality=3), MeanSeasonalNaive(seasonality=3, n_seasons=2), PatternSeasonality(seasonality=3), Reduction(lags=(0, 2), strategy="recursive"), Reduction(lags=(0, 1), strategy="dir-rec"), PolynomialTrend(), ex.ExogenousReduction(lags=(0, 2), strategy="recursive")):
        fitted = model.fit(head)
        at_end = {(r.group, r.step): r.y_hat for r in fitted.predict(2).collect()}
        rolled = ex.rolled(fitted, head, 2, stride=4).collect()
        last = max(r.vintage_time for r in rolled)
        assert last == START + dt.timedelta(days=23) and len(rolled) >= 2 * 2 * 5
        assert all(np.isclose(at_end[r.group, r.step], r.y_hat) for r in rolled if r.vintage_time == last), model
        later = ex.rolled(fitted, df, 1).filter(F.col("vintage_time") == F.lit(START + dt.timedelta(days=26))).first()
        if isinstance(model, MeanSeasonalNaive):
            assert np.isclose(later.y_hat, (y[24] + y[21]) / 2)
        if isinstance(model, SeasonalNaive):
            assert np.isclose(later.y_hat, y[24])


def test_candidates_by_chance():
    from tidemark.selection.search import grid, randomized

    options = {"a": [1, 2, 3], "b": [4, 5]}
    some = randomized(options, 4, seed=3)
    assert len(some) == 4 and some == randomized(options, 4, seed=3) and all(c in list(grid(options)) for c in some) and len(randomized(options, 99)) == 6


def test_weights_from_a_table(spark):
    table = spark.createDataFrame([(START, 2.0), (START + dt.timedelta(days=1), 0.5)], "time timestamp_ntz, weight double")
    assert values(ft.table_weights(series(spark, [1, 2]), table, ["time"]), "weight") == [2.0, 0.5]
    with pytest.raises(Exception, match="no weight"):
        ft.table_weights(series(spark, [1, 2, 3]), table, ["time"]).collect()
