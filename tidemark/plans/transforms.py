"""Queries of the transform operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import resample as rs
from tidemark.operators import reshape as rh
from tidemark.operators import scalers as sc
from tidemark.operators import stationarity as st
from tidemark.operators import windows as wn
from tidemark.plans.registry import BY, DAILY, KEY, MONTHLY, daily, monthly, query, r, table

D = f"WITH {DAILY}"
N = f"{D}, n AS (SELECT *, row_number() OVER ({BY}) - 1 AS rn, count(*) OVER (PARTITION BY g) AS n FROM daily)"


# --- windows -----------------------------------------------------------------------------------------------------


@query(f"{N} SELECT {KEY}, {', '.join(f'lag({c}, {k}) OVER ({BY}) AS {c}_lag_{k}' for c in 'yx' for k in (1, 7))} FROM n QUALIFY rn >= 7")
def lag(spark, d):
    return wn.Lag(lags=(1, 7)).transform(daily(spark, d))


@query(f"{N} SELECT {KEY}, y, x, lag(y, 2) OVER ({BY}) AS y_lag_2, lag(x, 2) OVER ({BY}) AS x_lag_2 FROM n QUALIFY rn >= 2")
def tabularize(spark, d):
    return wn.tabularize(daily(spark, d), (2,))


_FRAME = f"OVER ({BY} ROWS 6 PRECEDING)"
_STATS = {"mean": f"avg(y) {_FRAME}", "std": f"stddev_samp(y) {_FRAME}", "var": f"var_samp(y) {_FRAME}", "min": f"min(y) {_FRAME}", "max": f"max(y) {_FRAME}", "sum": f"sum(y) {_FRAME}", "median": f"median(y) {_FRAME}", "q25": f"list_sort(list(y) {_FRAME})[3]", "q75": f"list_sort(list(y) {_FRAME})[6]"}


@query(f"{N} SELECT {KEY}, {', '.join(r(v, f'y_{k}') for k, v in _STATS.items())} FROM n QUALIFY rn >= 6")
def rolling_statistics(spark, d):
    return wn.RollingStatistics(window_size=7, statistics=tuple(_STATS), columns=("y",)).transform(daily(spark, d))


@query(f"{N} SELECT {KEY}, {r('avg(y) OVER (PARTITION BY g, rn % 7 ORDER BY time ROWS 2 PRECEDING)', 'y_s7_mean')}, {r('max(y) OVER (PARTITION BY g, rn % 7 ORDER BY time ROWS 2 PRECEDING)', 'y_s7_max')} FROM n QUALIFY rn >= 14")
def rolling_seasonal(spark, d):
    return wn.RollingStatistics(window_size=3, statistics=("mean", "max"), seasonality=7, columns=("y",)).transform(daily(spark, d))


@query(f"{N}, p AS (SELECT *, avg(y) OVER (PARTITION BY g, rn % 7 ORDER BY time ROWS 1 PRECEDING) AS m, count(*) OVER (PARTITION BY g, rn % 7 ORDER BY time ROWS 1 PRECEDING) AS c FROM n), q AS (SELECT g, time, rn, CASE WHEN c = 2 THEN m END AS m FROM p) SELECT {KEY}, {', '.join(r(f'lag(m, {7 - h}) OVER ({BY})', f'y_s7_mean_step_{h}') for h in (1, 2, 3))} FROM q QUALIFY rn >= 13")
def horizon_rolling(spark, d):
    return wn.HorizonRollingStatistics(seasonality=7, n_seasons=2, horizon=3, columns=("y",)).transform(daily(spark, d))


@query(f"WITH RECURSIVE {DAILY}, n AS (SELECT *, row_number() OVER ({BY}) - 1 AS rn FROM daily), e AS (SELECT g, time, rn, y::DOUBLE AS m FROM n WHERE rn = 0 UNION ALL SELECT n.g, n.time, n.rn, e.m * 0.7 + n.y * 0.3 FROM e JOIN n ON n.g = e.g AND n.rn = e.rn + 1) SELECT {KEY}, {r('m', 'y_ewma')} FROM e")
def ewma(spark, d):
    return wn.ExponentialMovingAverage(alpha=0.3, adjust=False, columns=("y",)).transform(daily(spark, d))


@query(f"WITH RECURSIVE {DAILY}, n AS (SELECT *, row_number() OVER ({BY}) - 1 AS rn FROM daily), e AS (SELECT g, time, rn, y::DOUBLE AS s, 1.0::DOUBLE AS w FROM n WHERE rn = 0 UNION ALL SELECT n.g, n.time, n.rn, e.s * 0.7 + n.y, e.w * 0.7 + 1 FROM e JOIN n ON n.g = e.g AND n.rn = e.rn + 1) SELECT {KEY}, {r('s / w', 'y_ewma')} FROM e")
def ewma_adjusted(spark, d):
    return wn.ExponentialMovingAverage(alpha=0.3, adjust=True, columns=("y",)).transform(daily(spark, d))


@query(f"{N} SELECT {KEY}, {r(f'max(y) {_FRAME} - min(y) {_FRAME}', 'spread')} FROM n QUALIFY rn >= 6")
def sliding_function(spark, d):
    return wn.SlidingWindowFunction(func=lambda w: {"spread": float(w.y.max() - w.y.min())}, window_size=7, schema="spread double").transform(daily(spark, d))


@query(f"{N} SELECT {KEY}, {r(f'sum(CASE WHEN rn = 0 THEN 0 ELSE (y + before) / 2 * 86400 END) OVER ({BY})', 'y_integrated')} FROM (SELECT *, lag(y) OVER ({BY}) AS before FROM n)")
def integrate_trapezoid(spark, d):
    return wn.Integrator(columns=("y",)).transform(daily(spark, d))


@query(f"{N}, s AS (SELECT *, lag(y) OVER ({BY}) AS b1, lag(y, 2) OVER ({BY}) AS b2, lead(y) OVER ({BY}) AS a1 FROM n) SELECT {KEY}, {r(f'sum(CASE WHEN rn = 0 THEN 0 WHEN rn % 2 = 1 AND a1 IS NOT NULL THEN (1.25 * b1 + 2 * y - 0.25 * a1) / 3 * 3600 ELSE (1.25 * y + 2 * b1 - 0.25 * b2) / 3 * 3600 END) OVER ({BY})', 'y_integrated')} FROM s")
def integrate_simpson(spark, d):
    return wn.Integrator(columns=("y",), method="simpson", seconds=3600.0).transform(daily(spark, d))


@query(f"{N} SELECT {KEY}, {r(f'CASE WHEN rn = 0 THEN (lead(y) OVER ({BY}) - y) / 3600 WHEN rn = n - 1 THEN (y - lag(y) OVER ({BY})) / 3600 ELSE (lead(y) OVER ({BY}) - lag(y) OVER ({BY})) / 7200 END', 'y_differentiated')} FROM n")
def gradient(spark, d):
    return wn.Differentiator(seconds=3600.0, columns=("y",)).transform(daily(spark, d))


_STEPS = [f"lead(y, {h}) OVER ({BY}) AS s{h}" for h in (1, 2, 3)]


@query(f"{D}, s AS (SELECT g, time, {', '.join(_STEPS)} FROM daily) SELECT {KEY}, {r('list_avg(l)', 'y_mean')}, {r('list_min(l)', 'y_min')}, {r('list_max(l)', 'y_max')}, {r('list_sum(l)', 'y_sum')}, {r('CASE WHEN len(l) > 1 THEN list_stddev_samp(l) END', 'y_std')}, len(l)::INTEGER AS y_coverage FROM (SELECT *, list_filter([s1, s2, s3], lambda v: v IS NOT NULL) AS l FROM s)")
def step_aggregate(spark, d):
    rows = daily(spark, d)
    steps = rh.pivoted(rh.actuals_as_forecasts(rows, 3, ("y",)).select("group", F.col("vintage_time").alias("time"), "step", "y"), ["group", "time"], ("y",), 3)
    steps = rows.select("group", "time").join(steps, ["group", "time"], "left")
    return wn.StepAggregator(bases=("y",), aggregations=("mean", "min", "max", "sum", "std"), emit_coverage=True).transform(steps)


# --- stationarity ------------------------------------------------------------------------------------------------


@query(f"{N} SELECT {KEY}, {r(f'y - lag(y, 7) OVER ({BY})', 'diff_7_y')}, {r(f'x - lag(x, 7) OVER ({BY})', 'diff_7_x')} FROM n QUALIFY rn >= 7")
def seasonal_diff(spark, d):
    return st.SeasonalDifferencing(seasonality=7).transform(daily(spark, d))


def _round_trip(op, rows):
    rows = rows.select("group", "time", "y")
    changed = op.transform(rows)
    past = rows.join(changed.select("group", "time"), ["group", "time"], "left_anti")
    return op.inverse_transform(changed, past)


for _op, _name in ((st.SeasonalDifferencing(seasonality=7), "diff"), (st.SeasonalLogDifferencing(seasonality=7, offset=1.0), "log_diff"), (st.SeasonalReturn(seasonality=7, offset=1.0), "return")):
    query(f"{N} SELECT {KEY}, {r('y', 'y')} FROM n WHERE rn >= 7", f"seasonal_{_name}_inverse")(lambda spark, d, op=_op: _round_trip(op, daily(spark, d)))


@query(f"{N} SELECT {KEY}, {r(f'ln(y + 1) - ln(lag(y, 7) OVER ({BY}) + 1)', 'log_diff_7_y')} FROM n QUALIFY rn >= 7")
def seasonal_log_diff(spark, d):
    return st.SeasonalLogDifferencing(seasonality=7, offset=1.0, columns=("y",)).transform(daily(spark, d))


@query(f"{N} SELECT {KEY}, {r(f'(y + 1) / (lag(y) OVER ({BY}) + 1) - 1', 'return_1_y')} FROM n QUALIFY rn >= 1")
def seasonal_return(spark, d):
    return st.SeasonalReturn(seasonality=1, offset=1.0, columns=("y",)).transform(daily(spark, d))


@query(f"{N} SELECT {KEY}, {r(f'y - lag(y) OVER ({BY})', 'abs_return_1_y')} FROM n QUALIFY rn >= 1")
def abs_seasonal_return(spark, d):
    return st.AbsoluteSeasonalReturn(seasonality=1, columns=("y",)).transform(daily(spark, d))


@query(f"{D} SELECT {KEY}, {r('ln(y + 1)', 'log_1_y')} FROM daily")
def log_transform(spark, d):
    return st.Log(offset=1.0, columns=("y",)).transform(daily(spark, d))


@query(f"{D} SELECT {KEY}, {r('(pow(y + 1, 0.5) - 1) / 0.5', 'boxcox_0.5_y')} FROM daily")
def boxcox(spark, d):
    return st.BoxCox(lmbda=0.5, offset=1.0, columns=("y",)).transform(daily(spark, d))


@query(f"{D}, m AS (SELECT g, median(y) AS m FROM daily GROUP BY g), s AS (SELECT g, median(abs(y - m)) AS s FROM daily JOIN m USING (g) GROUP BY g) SELECT {KEY}, {r('asinh((y - m) / (1.4826 * CASE s WHEN 0 THEN 1 ELSE s END))', 'asinh_y')} FROM daily JOIN m USING (g) JOIN s USING (g)")
def asinh(spark, d):
    rows = daily(spark, d)
    return st.ASinh(columns=("y",)).fit(rows).transform(rows)


# --- resampling and imputation -----------------------------------------------------------------------------------

_EVENTS = {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "first": "arg_min(value, ts)", "last": "arg_max(value, ts)", "median": "median(value)", "std": "stddev_samp(value)"}


def _events(spark, d):
    """Distinct stamps of each type, as first and last need."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("group"), F.col("ts").alias("time")).agg(F.max("value").alias("value"))


_E = "WITH e AS (SELECT event_type AS g, ts, max(value) AS value FROM events GROUP BY 1, 2)"
for _a, _sql in _EVENTS.items():
    query(f"{_E} SELECT g AS \"group\", strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS time, {r(_sql, 'value')} FROM e GROUP BY 1, 2", f"downsample_{_a}")(lambda spark, d, a=_a: rs.Downsampler(interval="6h", aggregation=a).transform(_events(spark, d)))


@query(f"{_E} SELECT g AS \"group\", strftime(date_trunc('week', ts - INTERVAL 1 MICROSECOND) + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS time, {r('avg(value)', 'value')} FROM e GROUP BY 1, 2")
def downsample_week_right(spark, d):
    return rs.Downsampler(interval="1w", closed="right", label="right").transform(_events(spark, d))


_GRID = f"{D}, ends AS (SELECT g, min(time) AS a, max(time) AS b FROM daily GROUP BY g), grid AS (SELECT g, unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS time FROM ends), f AS (SELECT grid.g, grid.time, y, row_number() OVER (PARTITION BY grid.g ORDER BY grid.time) AS rn FROM grid LEFT JOIN daily ON daily.g = grid.g AND daily.time = grid.time), z AS (SELECT *, last_value(y IGNORE NULLS) OVER p AS py, last_value(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS pr, first_value(y IGNORE NULLS) OVER q AS qy, first_value(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER q AS qr FROM f WINDOW p AS (PARTITION BY g ORDER BY time ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY g ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
for _m, _sql in {"forward": "py", "backward": "qy", "nearest": "CASE WHEN rn - pr <= qr - rn THEN py ELSE qy END", "linear": "CASE WHEN y IS NOT NULL THEN y ELSE py + (qy - py) * (rn - pr) / (qr - pr) END"}.items():
    query(f"{_GRID} SELECT {KEY}, {r(_sql, 'y')} FROM z", f"upsample_{_m}")(lambda spark, d, m=_m: rs.Upsampler(interval="6h", interpolation=m, columns=("y",)).transform(daily(spark, d)))

_HOLES = "h AS (SELECT g, time, CASE WHEN day(time) % 5 = 0 THEN NULL ELSE y END AS y, rn FROM n)"


def _holes(spark, d):
    return daily(spark, d).select("group", "time", F.when(F.dayofmonth("time") % 5 != 0, F.col("y")).alias("y"))


_FILL = f"{N}, {_HOLES}, z AS (SELECT *, last_value(y IGNORE NULLS) OVER p AS py, last_value(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS pr, last_value(CASE WHEN y IS NOT NULL THEN time END IGNORE NULLS) OVER p AS pt, first_value(y IGNORE NULLS) OVER q AS qy, first_value(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER q AS qr, first_value(CASE WHEN y IS NOT NULL THEN time END IGNORE NULLS) OVER q AS qt FROM h WINDOW p AS (PARTITION BY g ORDER BY time ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY g ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
for _m, _sql in {"linear": "CASE WHEN y IS NOT NULL THEN y ELSE py + (qy - py) * (rn - pr) / (qr - pr) END", "forward": "py", "backward": "qy", "fill_both": "coalesce(py, qy)", "nearest": "CASE WHEN pt IS NULL THEN qy WHEN qt IS NULL OR time - pt <= qt - time THEN py ELSE qy END"}.items():
    query(f"{_FILL} SELECT {KEY}, {r(_sql, 'y')} FROM z", f"impute_{_m}")(lambda spark, d, m=_m: rs.TimeImputer(method=m).transform(_holes(spark, d)))

for _m, _sql in {"mean": "avg", "median": "median"}.items():
    query(f"{N}, {_HOLES}, p AS (SELECT *, date_diff('day', min(time) OVER (PARTITION BY g), time) % 7 AS ph FROM h), f AS (SELECT g, ph, {_sql}(y) AS f FROM p GROUP BY 1, 2) SELECT {KEY}, {r('coalesce(y, f)', 'y')} FROM p JOIN f USING (g, ph)", f"impute_seasonal_{_m}")(lambda spark, d, m=_m: rs.SeasonalImputer(fill_method=f"seasonal_{m}").fit(_holes(spark, d)).transform(_holes(spark, d)))

for _m, _sql in {"mean": "(SELECT avg(y) FROM h)", "median": "(SELECT median(y) FROM h)", "most_frequent": "(SELECT y FROM h WHERE y IS NOT NULL GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)", "constant": "0.0"}.items():
    query(f"{N}, {_HOLES} SELECT {KEY}, {r(f'coalesce(y, {_sql})', 'y')} FROM h", f"impute_simple_{_m}")(lambda spark, d, m=_m: rs.SimpleImputer(strategy=m).fit(_holes(spark, d)).transform(_holes(spark, d)))


# --- features ----------------------------------------------------------------------------------------------------

_CAL = {"year": "year(time)", "month": "month(time)", "week": "week(time)", "day_of_week": "isodow(time)", "day_of_month": "day(time)", "day_of_year": "dayofyear(time)", "hour": "hour(time)", "minute": "minute(time)", "quarter": "quarter(time)", "is_weekend": "isodow(time) >= 6", "is_month_start": "day(time) = 1", "is_month_end": "time::DATE = last_day(time)", "is_quarter_start": "month(time) % 3 = 1 AND day(time) = 1", "is_quarter_end": "month(time) % 3 = 0 AND time::DATE = last_day(time)", "is_year_start": "dayofyear(time) = 1", "is_year_end": "month(time) = 12 AND day(time) = 31"}


@query(f"{D} SELECT {KEY}, {', '.join(f'({v})::INTEGER AS cal_{k}' for k, v in _CAL.items())} FROM daily")
def calendar_features(spark, d):
    return ft.CalendarFeatures().transform(daily(spark, d))


_DAYS = tuple(date(y, m, n) for y in range(1995, 2002) for m, n in ((1, 1), (7, 4), (12, 25)))
_DATES = "[" + ", ".join(f"DATE '{x}'" for x in _DAYS) + "]"


@query(f"{D} SELECT {KEY}, list_contains({_DATES}, time::DATE)::INTEGER AS holiday_indicator, date_diff('day', time::DATE, list_min(list_filter({_DATES}, lambda v: v >= time::DATE)))::INTEGER AS holiday_days_to_next, date_diff('day', list_max(list_filter({_DATES}, lambda v: v <= time::DATE)), time::DATE)::INTEGER AS holiday_days_since_last FROM daily")
def holiday_features(spark, d):
    return ft.HolidayFeatures(holidays=_DAYS).transform(daily(spark, d))


_LOCAL = "timezone('America/Chicago', timezone('UTC', {}))"
_UTC = "timezone('UTC', timezone('America/Chicago', {}))"
_OFFSET = "date_diff('minute', {}, " + _LOCAL + ")"


def _offset(t: str) -> str:
    return _OFFSET.format(t, t)


@query(f"{D}, l AS (SELECT *, date_trunc('day', {_LOCAL.format('time')})::TIMESTAMP AS day FROM daily), u AS (SELECT *, {_UTC.format('day')} AS a, {_UTC.format('(day + INTERVAL 1 DAY)')} AS b, make_timestamp(year(day), 1, 1, 0, 0, 0) AS w, make_timestamp(year(day), 7, 1, 0, 0, 0) AS s FROM l) SELECT {KEY}, ({_offset('time')} > least({_offset('w')}, {_offset('s')}))::INTEGER AS dst_in_effect, ({_offset('a')} <> {_offset('b')})::INTEGER AS dst_transition_day, sign({_offset('b')} - {_offset('a')})::INTEGER AS dst_transition_type FROM u")
def daylight_saving(spark, d):
    return ft.DaylightSaving().transform(daily(spark, d))


@query(f"{D}, t AS (SELECT *, date_diff('day', (SELECT min(time) FROM daily), time)::DOUBLE AS t FROM daily) SELECT {KEY}, {r('t', 'time_index')}, {r('t * t', 'time_index_2')} FROM t")
def time_index(spark, d):
    rows = daily(spark, d)
    return ft.TimeIndex(degree=2).fit(rows).transform(rows)


@query(f"{D}, t AS (SELECT *, date_diff('day', (SELECT min(time) FROM daily), time)::DOUBLE AS t FROM daily) SELECT {KEY}, {', '.join(r(f'{f}(2.0 * {k} * pi() * t / 7.0)', f'fourier_7_{f}_{k}') for k in (1, 2) for f in ('sin', 'cos'))} FROM t")
def fourier_features(spark, d):
    rows = daily(spark, d)
    return ft.FourierFeatures(seasonality=7.0, harmonics=(1, 2)).fit(rows).transform(rows)


for _o, _sql in {"add": "y + x", "sub": "y - x", "mul": "y * x", "div": "y / x"}.items():
    query(f"{D} SELECT {KEY}, {r(_sql, 'arithmetic')} FROM daily", f"arithmetic_{_o}")(lambda spark, d, o=_o: ft.Arithmetic(left="y", right="x", op=o).transform(daily(spark, d)))


@query(f"{D} SELECT {KEY}, {r('y * x', 'reduce')} FROM daily")
def reduce_product(spark, d):
    return ft.Reduce(inputs=("y", "x"), op="prod").transform(daily(spark, d))


@query(f"{D} SELECT {KEY}, {r('least(greatest(y, 500), 2000)', 'y')} FROM daily")
def outlier_threshold(spark, d):
    return ft.OutlierThreshold(low=500, high=2000, columns=("y",)).transform(daily(spark, d))


@query(f"{D} SELECT {KEY}, {r('CASE WHEN isodow(time) NOT IN (6, 7) OR y BETWEEN 500 AND 2000 THEN y END', 'y')} FROM daily")
def outlier_threshold_segment(spark, d):
    return ft.OutlierThreshold(low=500, high=2000, strategy="nan", segment=ft.calendar_segment("day_of_week", (6, 7)), columns=("y",)).transform(daily(spark, d))


@query(f"{D}, b AS (SELECT g, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM daily GROUP BY g) SELECT {KEY}, {r('least(greatest(y, lo), hi)', 'y')} FROM daily JOIN b USING (g)")
def outlier_percentile(spark, d):
    rows = daily(spark, d)
    return ft.OutlierPercentile(low=5, high=95, columns=("y",)).fit(rows).transform(rows)


@query(f"{D}, b AS (SELECT g, isodow(time) AS w, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM daily GROUP BY 1, 2 HAVING count(*) >= 30), a AS (SELECT g, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM daily GROUP BY 1) SELECT daily.{KEY.replace('strftime(time', 'strftime(daily.time')}, {r('least(greatest(y, coalesce(b.lo, a.lo)), coalesce(b.hi, a.hi))', 'y')} FROM daily JOIN a ON a.g = daily.g LEFT JOIN b ON b.g = daily.g AND b.w = isodow(daily.time)")
def outlier_percentile_segment(spark, d):
    rows = daily(spark, d)
    return ft.OutlierPercentile(low=5, high=95, segment=ft.calendar_segment("day_of_week"), by_segment=True, columns=("y",)).fit(rows).transform(rows)


@query(f"{D} SELECT {KEY}, CASE WHEN month(time) IN (6, 7, 8) THEN month(time) END::INTEGER AS summer, (month(time) IN (6, 7, 8) AND isodow(time) >= 6) AS both, (month(time) IN (6, 7, 8) OR isodow(time) >= 6) AS either, (month(time) NOT IN (6, 7, 8)) AS rest FROM daily")
def segments(spark, d):
    summer, weekend, t = ft.calendar_segment("month", (6, 7, 8)), ft.calendar_segment("day_of_week", (6, 7)), F.col("time")
    there = lambda s: s(t).isNotNull()
    return daily(spark, d).select("group", "time", summer(t).alias("summer"), there(ft.intersection(summer, weekend)).alias("both"), there(ft.union(summer, weekend)).alias("either"), there(ft.complement(summer)).alias("rest"))


# --- scalers -----------------------------------------------------------------------------------------------------

for _name, _op, _sql in (
    ("standard", sc.StandardScaler(columns=("y",)), "(y - (SELECT avg(y) FROM daily)) / (SELECT stddev_pop(y) FROM daily)"),
    ("minmax", sc.MinMaxScaler(columns=("y",)), "(y - (SELECT min(y) FROM daily)) / (SELECT max(y) - min(y) FROM daily)"),
    ("robust", sc.RobustScaler(columns=("y",)), "(y - (SELECT median(y) FROM daily)) / (SELECT quantile_cont(y, 0.75) - quantile_cont(y, 0.25) FROM daily)"),
    ("maxabs", sc.MaxAbsScaler(columns=("y",)), "y / (SELECT max(abs(y)) FROM daily)"),
):
    query(f"{D} SELECT {KEY}, {r(_sql, 'y')} FROM daily", f"scale_{_name}")(lambda spark, d, op=_op: op.fit(daily(spark, d)).transform(daily(spark, d)))
    query(f"{D} SELECT {KEY}, {r('y', 'y')} FROM daily", f"scale_{_name}_inverse")(lambda spark, d, op=_op: op.fit(daily(spark, d)).inverse_transform(op.transform(daily(spark, d))))

for _n, _sql in {"l1": "(abs(y) + abs(x))", "l2": "sqrt(y * y + x * x)", "max": "greatest(abs(y), abs(x))"}.items():
    query(f"{D} SELECT {KEY}, {r(f'y / {_sql}', 'y')}, {r(f'x / {_sql}', 'x')} FROM daily", f"normalize_{_n}")(lambda spark, d, n=_n: sc.Normalizer(norm=n).transform(daily(spark, d)))


@query(f"{D} SELECT {KEY}, {r('1.0::DOUBLE', '1')}, {r('y', 'y')}, {r('x', 'x')}, {r('y * y', 'y^2')}, {r('y * x', 'y x')}, {r('x * x', 'x^2')} FROM daily")
def polynomial_features(spark, d):
    return sc.PolynomialFeatures().transform(daily(spark, d))


_LEVELS = ", ".join(f"{i}/999.0::DOUBLE" for i in range(1000))


@query(f"{D}, q AS (SELECT unnest(quantile_cont(y::DOUBLE, [{_LEVELS}])) AS k FROM daily), i AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM q), v AS (SELECT DISTINCT y::DOUBLE AS y FROM daily), b AS (SELECT y, count(*) FILTER (k < y) AS lo, count(*) FILTER (k <= y) AS hi, max(k) FILTER (k < y) AS a, min(k) FILTER (k > y) AS c FROM v CROSS JOIN i GROUP BY y), f AS (SELECT y, CASE WHEN hi > lo THEN (lo + hi - 1) / 2.0 ELSE lo - 1 + (y - a) / (c - a) END / 999.0 AS p FROM b) SELECT {KEY}, {r('p', 'y')} FROM daily JOIN f ON f.y = daily.y::DOUBLE")
def quantile_transform(spark, d):
    rows = daily(spark, d)
    return sc.QuantileTransformer(columns=("y",)).fit(rows).transform(rows)


@query()
def power_transform(spark, d):
    rows = daily(spark, d)
    return sc.PowerTransformer(columns=("y",)).fit(rows).transform(rows)


def _cubic(t: str) -> str:
    """The cardinal cubic B-spline on [0, 4]."""
    return f"CASE WHEN {t} < 0 OR {t} > 4 THEN 0 WHEN {t} < 1 THEN pow({t}, 3) / 6 WHEN {t} < 2 THEN (4 - 12 * {t} + 12 * pow({t}, 2) - 3 * pow({t}, 3)) / 6 WHEN {t} < 3 THEN (-44 + 60 * {t} - 24 * pow({t}, 2) + 3 * pow({t}, 3)) / 6 ELSE pow(4 - {t}, 3) / 6 END"


@query(f"{D}, e AS (SELECT min(y)::DOUBLE AS a, max(y)::DOUBLE AS b FROM daily), u AS (SELECT g, time, (y - a) / ((b - a) / 4) AS u FROM daily, e) SELECT {KEY}, {', '.join(r(_cubic(f'(u - {i - 3})'), f'y_sp_{i}') for i in range(7))} FROM u")
def spline_transform(spark, d):
    rows = daily(spark, d)
    return sc.SplineTransformer(columns=("y",)).fit(rows).transform(rows)


# --- weights -----------------------------------------------------------------------------------------------------

for _name, _op, _sql in (
    ("exponential", ft.ExponentialDecay(half_life=30), "pow(2.0, -date_diff('day', time, max(time) OVER (PARTITION BY g)) / 30.0)"),
    ("exponential_position", ft.ExponentialDecay(half_life=30, scale="position"), "pow(2.0, -(n - 1 - rn) / 30.0)"),
    ("linear", ft.LinearDecay(), "(rn + 1) / n::DOUBLE"),
    ("linear_window", ft.LinearDecay(window_size=10), "CASE WHEN rn + 1 > n - 10 THEN (rn + 1 - (n - 10)) / least(10, n)::DOUBLE ELSE 0.0 END"),
    ("seasonal", ft.SeasonalEmphasis(seasonality=7, emphasis=3.0), "CASE WHEN (n - 1 - rn) % 7 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE"),
    ("segment", ft.SegmentWeights(segment=ft.calendar_segment("day_of_week", (6, 7)), inside=0.5, outside=1.0), "CASE WHEN isodow(time) >= 6 THEN 0.5 ELSE 1.0 END::DOUBLE"),
    ("lookup", ft.LookupWeights(mapping={"A": 2.0, "*": 0.5}), "CASE g WHEN 'A' THEN 2.0 ELSE 0.5 END::DOUBLE"),
    ("composite", ft.CompositeWeights(parts=(ft.LinearDecay(), ft.SeasonalEmphasis(seasonality=7))), "(rn + 1) / n::DOUBLE * CASE WHEN (n - 1 - rn) % 7 = 0 THEN 2.0 ELSE 1.0 END"),
):
    query(f"{N} SELECT {KEY}, {r(_sql, 'weight')} FROM n", f"weights_{_name}")(lambda spark, d, op=_op: op.transform(daily(spark, d)).select("group", "time", "weight"))


@query(f"{N} SELECT {KEY}, {r('(rn + 1) / n::DOUBLE * n / sum((rn + 1) / n::DOUBLE) OVER (PARTITION BY g)', 'weight')} FROM n")
def weights_normalised(spark, d):
    return ft.LinearDecay(normalise=True).transform(daily(spark, d)).select("group", "time", "weight")


# --- reshaping ---------------------------------------------------------------------------------------------------


@query(f"{D} SELECT a.g AS \"group\", strftime(a.time, '%Y-%m-%d %H:%M:%S') AS time, {', '.join(f'b{h}.x AS x_step_{h}' for h in (1, 2, 3))} FROM daily a {' '.join(f'LEFT JOIN daily b{h} ON b{h}.g = a.g AND b{h}.time = a.time + INTERVAL {h} DAY' for h in (1, 2, 3))}")
def window_futures(spark, d):
    rows = daily(spark, d)
    return rh.window_futures(rows, rows, 3, "1d", ("x",))


_V = f"{N}, v AS (SELECT a.g, a.time AS vt, b.time, b.y * 2 AS f FROM n a JOIN n b ON a.g = b.g AND b.rn - a.rn BETWEEN 1 AND 5 WHERE a.rn % 3 = 0)"


def _vintages(spark, d):
    return rh.actuals_as_forecasts(daily(spark, d), 5, ("y",), stride=3).select("group", "vintage_time", "time", (F.col("y") * 2).alias("f"))


@query(f"{_V}, k AS (SELECT DISTINCT g, vt FROM v), o AS (SELECT n.g, n.time, k.vt FROM n ASOF LEFT JOIN k ON n.g = k.g AND n.time >= k.vt) SELECT o.g AS \"group\", strftime(o.time, '%Y-%m-%d %H:%M:%S') AS time, {', '.join(f'v{h}.f AS f_step_{h}' for h in (1, 2))} FROM o {' '.join(f'LEFT JOIN v v{h} ON v{h}.g = o.g AND v{h}.vt = o.vt AND v{h}.time = o.time + INTERVAL {h} DAY' for h in (1, 2))}")
def window_forecasts(spark, d):
    return rh.window_forecasts(_vintages(spark, d), daily(spark, d), 2, "1d", ("f",))


@query(f"{_V} SELECT g AS \"group\", strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, f FROM v")
def actuals_as_forecasts(spark, d):
    return _vintages(spark, d)


@query(f"{_V}, e AS (SELECT g, vt, max(time) AS e FROM v GROUP BY 1, 2 HAVING vt <= TIMESTAMP '1998-06-15' AND max(time) > TIMESTAMP '1998-06-15') SELECT g AS \"group\", 'f' AS \"column\", strftime(max(vt), '%Y-%m-%d %H:%M:%S') AS vintage_time FROM e GROUP BY g")
def retained_vintages(spark, d):
    return rh.retained_vintages(_vintages(spark, d), F.lit("1998-06-15").cast("timestamp_ntz"), ("f",))


_DV = f"{_V}, w AS (SELECT g, vt, time, f, CASE WHEN day(vt) % 2 = 0 THEN f END AS h FROM v)"


@query(f"{_DV}, k AS (SELECT DISTINCT g, vt FROM w), hv AS (SELECT DISTINCT g, vt FROM w WHERE h IS NOT NULL), m AS (SELECT k.g, k.vt, hv.vt AS own FROM k ASOF JOIN hv ON k.g = hv.g AND k.vt >= hv.vt), hh AS (SELECT m.g, m.vt, w.time, w.h FROM m JOIN w ON w.g = m.g AND w.vt = m.own WHERE w.h IS NOT NULL), ff AS (SELECT g, vt, time, f FROM w WHERE f IS NOT NULL) SELECT coalesce(ff.g, hh.g) AS \"group\", strftime(coalesce(ff.vt, hh.vt), '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(coalesce(ff.time, hh.time), '%Y-%m-%d %H:%M:%S') AS time, f, h FROM ff FULL JOIN hh ON ff.g = hh.g AND ff.vt = hh.vt AND ff.time = hh.time")
def densify_vintages(spark, d):
    rows = _vintages(spark, d).withColumn("h", F.when(F.dayofmonth("vintage_time") % 2 == 0, F.col("f")))
    return rh.densify_vintages(rows, ("f", "h"))


@query(f"{D} SELECT strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {', '.join(f'''max(CASE WHEN g = '{g}' THEN {m} END) AS {g.lower()}__{m}''' for g in 'ANR' for m in 'yx')} FROM daily GROUP BY time")
def panel_wide(spark, d):
    rows = daily(spark, d).withColumn("group", F.lower("group"))
    return rh.to_wide(rows, ("a", "n", "r"), ("y", "x"))


@query(f"{D} SELECT lower(a.g) AS \"group\", strftime(t.time, '%Y-%m-%d %H:%M:%S') AS time, y, x FROM (SELECT DISTINCT time FROM daily) t CROSS JOIN (SELECT DISTINCT g FROM daily) a LEFT JOIN daily ON daily.g = a.g AND daily.time = t.time")
def panel_long(spark, d):
    rows = daily(spark, d).withColumn("group", F.lower("group"))
    return rh.to_long(rh.to_wide(rows, ("a", "n", "r"), ("y", "x")))


@query(f"WITH {MONTHLY} SELECT {KEY}, {r(f'y - lag(y, 12) OVER ({BY})', 'diff_12_y')} FROM monthly QUALIFY row_number() OVER ({BY}) > 12")
def monthly_diff(spark, d):
    return st.SeasonalDifferencing(seasonality=12).transform(monthly(spark, d))
