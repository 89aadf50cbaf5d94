"""Queries of the tables behind diagnostic views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import analytics as an
from tidemark.plans.forecasts import _RATED, ROLLED, _rated, rolled
from tidemark.plans.registry import BY, DAILY, KEY, MONTHLY, daily, monthly, query, r

_ACF = f"WITH {DAILY}, c AS (SELECT g, time, y - avg(y) OVER (PARTITION BY g) AS c FROM daily), l AS (SELECT g, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3 FROM c WINDOW w AS (PARTITION BY g ORDER BY time)), s AS (SELECT g, sum(c * c) / count(*) AS r0, sum(c * c1) / (count(*) - 1) AS r1, sum(c * c2) / (count(*) - 2) AS r2, sum(c * c3) / (count(*) - 3) AS r3 FROM l GROUP BY g), p AS (SELECT g, r1 / r0 AS a, r2 / r0 AS b, r3 / r0 AS d FROM s)"


@query(f"{_ACF} SELECT g AS \"group\", k::INTEGER AS lag, {r('CASE k WHEN 0 THEN 1.0 WHEN 1 THEN a WHEN 2 THEN (b - a * a) / (1 - a * a) ELSE (d - 2 * a * b + a * a * a + a * b * b - a * a * d) / (1 - 2 * a * a - b * b + 2 * a * a * b) END', 'pacf')} FROM p CROSS JOIN (SELECT unnest(range(0, 4)) AS k)")
def pacf(spark, d):
    """The third value in the SQL is the quotient of the determinants that Cramer's rule gives."""
    return an.partial_autocorrelation(daily(spark, d), 3)


@query(f"WITH {DAILY} SELECT g AS \"group\", a AS \"left\", b AS \"right\", {r('c', 'r')} FROM (SELECT g, 'y' AS a, 'y' AS b, corr(y, y) AS c FROM daily GROUP BY g UNION ALL SELECT g, 'y', 'x', corr(y, x) FROM daily GROUP BY g UNION ALL SELECT g, 'x', 'x', corr(x, x) FROM daily GROUP BY g)")
def correlation_table(spark, d):
    return an.correlations(daily(spark, d), ["y", "x"], ("group",))


@query(f"WITH {DAILY} SELECT g AS \"group\", isodow(time)::INTEGER AS season, {r('avg(y)', 'mean')}, count(y) AS n FROM daily GROUP BY 1, 2")
def seasonal_profile(spark, d):
    return an.seasonal_profile(daily(spark, d), "day_of_week")


@query(f"WITH {DAILY} SELECT g AS \"group\", month(time)::INTEGER AS season, year(time)::INTEGER AS cycle, {r('avg(y)', 'mean')}, count(y) AS n FROM daily GROUP BY 1, 2, 3")
def seasonal_profile_by_cycle(spark, d):
    return an.seasonal_profile(daily(spark, d), "month", by_cycle=True)


@query(f"WITH {MONTHLY}, p AS (SELECT g, time, k, lag(y, 1) OVER ({BY}) AS a, lag(y, 12) OVER ({BY}) AS b, y FROM monthly CROSS JOIN (SELECT 1 AS k)), e AS (SELECT g, time, 1 AS lag, a AS before, y AS now FROM p UNION ALL SELECT g, time, 12, b, y FROM p) SELECT {KEY}, lag, {r('before', 'before')}, {r('now', 'now')} FROM e WHERE before IS NOT NULL")
def lag_pairs(spark, d):
    return an.lag_pairs(monthly(spark, d), (1, 12))


@query(f"WITH {MONTHLY} SELECT {KEY}, {r('y', 'y')}, CASE WHEN count(*) OVER w = 6 THEN round(avg(y) OVER w, 6) + 0.0 END AS mean, CASE WHEN count(*) OVER w = 6 THEN round(stddev_samp(y) OVER w, 6) + 0.0 END AS std, CASE WHEN count(*) OVER w = 6 THEN min(y) OVER w END AS min, CASE WHEN count(*) OVER w = 6 THEN max(y) OVER w END AS max FROM monthly WINDOW w AS ({BY} ROWS 5 PRECEDING)")
def rolling_profile(spark, d):
    return an.rolling(monthly(spark, d), 6)


@query(f"WITH {DAILY}, h AS (SELECT g, time FROM daily WHERE extract(doy FROM time) % 9 <> 0), e AS (SELECT g, unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS time FROM h GROUP BY g), f AS (SELECT e.g, e.time, h.time IS NULL AS gone FROM e LEFT JOIN h ON h.g = e.g AND h.time = e.time) SELECT g AS \"group\", strftime(date_trunc('month', time)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS time, bool_or(gone) AS is_missing FROM f GROUP BY 1, 2")
def missing_months(spark, d):
    return an.missing(daily(spark, d).filter(F.dayofyear("time") % 9 != 0), "1d", "month")


@query(f"WITH {DAILY}, e AS (SELECT g, min(y) AS lo, (max(y) - min(y)) / 8 AS w, count(*) AS m FROM daily GROUP BY g), b AS (SELECT g, least(floor((y - lo) / w), 7)::INTEGER AS bin, lo, w, m FROM daily JOIN e USING (g)) SELECT g AS \"group\", bin, {r('any_value(lo) + bin * any_value(w)', 'low')}, {r('any_value(lo) + bin * any_value(w) + any_value(w)', 'high')}, count(*) AS n, {r('count(*) / (any_value(m) * any_value(w))', 'density')} FROM b GROUP BY g, bin")
def distribution(spark, d):
    return an.histogram(daily(spark, d), 8)


_DFT = f"WITH {MONTHLY}, c AS (SELECT g, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, y - avg(y) OVER (PARTITION BY g) AS y FROM monthly), k AS (SELECT g, n, k FROM (SELECT DISTINCT g, n FROM c), (SELECT unnest(range(1, 2000)) AS k) WHERE k <= n // 2), p AS (SELECT c.g AS g, c.n AS n, k, (pow(sum(y * cos(2 * pi() * k * i / c.n)), 2) + pow(sum(y * sin(2 * pi() * k * i / c.n)), 2)) / c.n * CASE WHEN 2 * k = c.n THEN 1 ELSE 2 END AS power FROM c JOIN k USING (g) GROUP BY c.g, c.n, k)"


@query(f"{_DFT} SELECT g AS \"group\", {r('k / n', 'frequency')}, round(power, 4) + 0.0 AS power FROM p")
def periodogram(spark, d):
    return an.spectrum(monthly(spark, d)).select("group", "frequency", F.round("power", 4).alias("power"))


@query(f"{_DFT} SELECT g AS \"group\", {r('n / k', 'period')}, row_number() OVER (PARTITION BY g ORDER BY power DESC, k)::INTEGER AS rank FROM p QUALIFY rank <= 3")
def periodogram_peaks(spark, d):
    return an.peaks(an.spectrum(monthly(spark, d))).drop("power")


@query(f"{_RATED}, q AS (SELECT g, round((1 - rate) / 2, 6) AS level, y <= lo AS hit FROM i UNION ALL SELECT g, round((1 + rate) / 2, 6), y <= hi FROM i UNION ALL SELECT g, 0.5, y <= f FROM i) SELECT g AS \"group\", {r('level', 'level')}, {r('avg(hit::INTEGER)', 'share')} FROM q GROUP BY 1, level")
def quantile_coverage(spark, d):
    return an.quantile_coverage(_rated(spark, d), ("group",))


@query(f"{_RATED} SELECT g AS \"group\", {r('rate', 'coverage_rate')}, {r('avg((y BETWEEN lo AND hi)::INTEGER)', 'share')} FROM i GROUP BY 1, rate")
def interval_coverage(spark, d):
    return an.interval_coverage(_rated(spark, d), ("group",))


@query(f"{ROLLED}, e AS (SELECT g, y - f AS e, lag(y - f) OVER (PARTITION BY g ORDER BY time) AS b FROM rolled WHERE step = 1) SELECT g AS \"group\", {r('avg(e)', 'mean')}, {r('stddev_samp(e)', 'std')}, {r('corr(e, b)', 'lag_one')} FROM e GROUP BY g")
def residual_profile(spark, d):
    return an.residuals(rolled(spark, d).filter("step = 1")).drop("skew", "kurtosis")


@query(f"{ROLLED} SELECT step::INTEGER AS step, strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time, {r('avg(abs(y - f))', 'mae')} FROM rolled GROUP BY step, vt")
def score_heatmap(spark, d):
    return an.score_table(rolled(spark, d), "mae", "step", "vintage")


@query(f"{ROLLED}, s AS (SELECT step, avg(e) AS e FROM (SELECT step, g, avg(abs(y - f)) AS e FROM rolled GROUP BY 1, 2) GROUP BY step) SELECT {r('regr_slope(e, step)', 'slope')}, {r('regr_intercept(e, step)', 'start')} FROM s")
def score_trend(spark, d):
    return an.score_trend(rolled(spark, d), "mae")


@query(f"WITH {MONTHLY}, q AS (SELECT g, date_trunc('quarter', time)::TIMESTAMP AS time, sum(y) AS y FROM monthly GROUP BY 1, 2) SELECT {KEY}, {r('y', 'y')}, 'months' AS source FROM monthly UNION ALL SELECT {KEY}, {r('y', 'y')}, 'quarters' FROM q")
def overlay_resampled(spark, d):
    rows = monthly(spark, d)
    quarters = rows.groupBy("group", F.date_trunc("quarter", "time").cast("timestamp_ntz").alias("time")).agg(F.sum("y").alias("y"))
    return an.overlay(months=rows, quarters=quarters)


@query()
def decompose_stl(spark, d):
    return an.stl(monthly(spark, d), (12,))


@query()
def decompose_mstl(spark, d):
    return an.stl(daily(spark, d).select("group", "time", "y"), (7, 30), robust=False)


@query()
def kernel_density(spark, d):
    return an.kernel_density(daily(spark, d), 50)
