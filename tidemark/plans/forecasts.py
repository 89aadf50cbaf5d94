"""Queries of forecasters, scores, intervals, splits and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import analytics as an
from tidemark.metrics import conformity as cf
from tidemark.metrics import scores as sc
from tidemark.models import forecasters as fc
from tidemark.plans.registry import BY, DAILY, KEY, MONTHLY, daily, fitted, monthly, query, r, table
from tidemark.selection import search as se

M = f"WITH {MONTHLY}, mn AS (SELECT *, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY g) AS n, min(time) OVER (PARTITION BY g) AS t0, max(time) OVER (PARTITION BY g) AS t1 FROM monthly)"
ROLLED = f"{M}, rolled AS (SELECT a.g, a.time AS vt, h.h AS step, b.time, c.y AS f, b.y FROM mn a CROSS JOIN (VALUES (1), (2), (3)) h(h) JOIN mn b ON b.g = a.g AND b.rn = a.rn + h JOIN mn c ON c.g = a.g AND c.rn = a.rn - (11 - (h - 1) % 12) WHERE a.rn % 6 = 0)"


def rolled(spark, d):
    """Seasonal-naive forecasts of three months from every sixth month."""
    return fc.rolling_naive(monthly(spark, d), 3, seasonality=12, stride=6).withColumn("component", F.lit("y"))


@query(f"{ROLLED} SELECT g AS \"group\", strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, step::INTEGER AS step, f AS y_hat, y FROM rolled")
def rolling_naive(spark, d):
    return rolled(spark, d).drop("component")


# --- scores ------------------------------------------------------------------------------------------------------

_ERRORS = {
    "mae": ("abs(y - f)", "e"),
    "mse": ("(y - f) * (y - f)", "e"),
    "rmse": ("(y - f) * (y - f)", "sqrt(e)"),
    "mape": ("100 * abs(y - f) / (abs(y) + 1e-8)", "e"),
    "smape": ("100 * abs(y - f) / ((abs(y) + abs(f)) / 2 + 1e-8)", "e"),
    "mase": ("abs(y - f) / greatest(scale, 1e-10)", "e"),
    "rmsse": ("(y - f) * (y - f) / greatest(scale, 1e-10)", "sqrt(e)"),
}
_WHOLE = {
    "median_ae": "median(abs(y - f))",
    "max_ae": "max(abs(y - f))",
    "r2": "CASE WHEN abs(sum(y * y) - sum(y) * sum(y) / count(*)) < 1e-12 THEN 0 ELSE 1 - sum((y - f) * (y - f)) / (sum(y * y) - sum(y) * sum(y) / count(*)) END",
}


def _scale(power: int) -> str:
    return f", s AS (SELECT g, avg(pow(abs(y - b), {power})) AS scale FROM (SELECT g, y, lag(y, 12) OVER ({BY}) AS b FROM monthly) GROUP BY g), q AS (SELECT rolled.*, scale FROM rolled JOIN s USING (g))"


def _prepared(spark, d, name):
    rows = rolled(spark, d)
    if name in ("mase", "rmsse"):
        scale = sc.naive_scale(monthly(spark, d).withColumn("component", F.lit("y")), 12, 2 if name == "rmsse" else 1)
        rows = rows.join(scale, ["group", "component"])
    return rows


for _m, (_e, _t) in _ERRORS.items():
    _q = _scale(2 if _m == "rmsse" else 1) if _m in ("mase", "rmsse") else ", q AS (SELECT * FROM rolled)"
    query(f"{ROLLED}{_q}, a AS (SELECT g, vt, avg({_e}) AS e FROM q GROUP BY 1, 2), b AS (SELECT vt, avg(e) AS e FROM a GROUP BY 1) SELECT {r(f'avg({_t})', _m)} FROM b", f"score_{_m}")(lambda spark, d, m=_m: sc.point_score(_prepared(spark, d, m), m))
    query(f"{ROLLED}{_q} SELECT g AS \"group\", step::INTEGER AS step, {r(_t.replace('e', f'avg({_e})') if _t == 'e' else f'sqrt(avg({_e}))', _m)} FROM q GROUP BY g, step", f"score_{_m}_by_group_step")(lambda spark, d, m=_m: sc.point_score(_prepared(spark, d, m), m, over=("vintage", "component")))
for _m, _e in _WHOLE.items():
    query(f"{ROLLED}, a AS (SELECT g, vt, {_e} AS e FROM rolled GROUP BY 1, 2), b AS (SELECT vt, avg(e) AS e FROM a GROUP BY 1) SELECT {r('avg(e)', _m)} FROM b", f"score_{_m}")(lambda spark, d, m=_m: sc.point_score(rolled(spark, d), m))


@query(f"{ROLLED}, x AS (SELECT *, (sign(y - lag(y) OVER w) = sign(f - lag(f) OVER w))::INTEGER AS e FROM rolled WINDOW w AS (PARTITION BY g, vt ORDER BY time)), a AS (SELECT g, vt, avg(e) AS e FROM x WHERE e IS NOT NULL GROUP BY 1, 2), b AS (SELECT vt, avg(e) AS e FROM a GROUP BY 1) SELECT {r('avg(e)', 'mda')} FROM b")
def score_mda(spark, d):
    return sc.point_score(rolled(spark, d), "mda")


_MODES = {
    "stepwise": (("step", "component"), "g AS \"group\", strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time", "g, vt"),
    "vintagewise": (("vintage", "component"), "g AS \"group\", step::INTEGER AS step", "g, step"),
    "groupwise": (("step", "component", "group"), "strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time", None),
    "components_only": (("step", "vintage", "component"), "g AS \"group\"", None),
}
for _k, (_over, _cols, _by) in _MODES.items():
    if _by:
        _sql = f"{ROLLED} SELECT {_cols}, {r('avg(abs(y - f))', 'mae')} FROM rolled GROUP BY {_by}"
    else:
        _sql = f"{ROLLED}, a AS (SELECT g, vt, avg(abs(y - f)) AS e FROM rolled GROUP BY 1, 2) SELECT {_cols}, {r('avg(e)', 'mae')} FROM a GROUP BY {'vt' if _k == 'groupwise' else 'g'}"
    query(_sql, f"score_mode_{_k}")(lambda spark, d, over=_over: sc.point_score(rolled(spark, d), "mae", over=over))


@query(f"{ROLLED}, a AS (SELECT g, vt, avg(abs(y - f) * step * k) AS e FROM rolled JOIN (SELECT g, count(*) / sum(step) AS k FROM rolled GROUP BY g) USING (g) GROUP BY 1, 2), b AS (SELECT vt, sum(e * CASE left(g, 1) WHEN '1' THEN 2.0 ELSE 1.0 END) / sum(CASE left(g, 1) WHEN '1' THEN 2.0 ELSE 1.0 END) AS e FROM a GROUP BY 1) SELECT {r('avg(e)', 'mae')} FROM b")
def score_weighted(spark, d):
    rows = rolled(spark, d).withColumns({"w": F.col("step"), "group": F.substring("group", 1, 1)})
    return sc.point_score(rows, "mae", weight="w", group_weights={"1": 2.0, "2": 1.0, "3": 1.0, "4": 1.0, "5": 1.0})


_RATED = f"{ROLLED}, i AS (SELECT *, f * (1 - rate * 0.2) AS lo, f * (1 + rate * 0.2) AS hi FROM rolled CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) r(rate))"


def _rated(spark, d):
    rows = rolled(spark, d).withColumn("coverage_rate", F.explode(F.array(F.lit(0.5), F.lit(0.8))))
    return rows.withColumns({"lower": F.col("y_hat") * (1 - F.col("coverage_rate") * 0.2), "upper": F.col("y_hat") * (1 + F.col("coverage_rate") * 0.2)})


def _pin(t: str, b: str) -> str:
    return f"CASE WHEN y >= {b} THEN {t} * (y - {b}) ELSE (1 - {t}) * ({b} - y) END"


_PINBALL = f"({_pin('((1 - rate) / 2)', 'lo')} + {_pin('((1 + rate) / 2)', 'hi')})"
for _m, _e in {"empirical_coverage": "(y BETWEEN lo AND hi)::INTEGER", "mean_interval_width": "abs(hi - lo)", "interval_score": "abs(hi - lo) + CASE WHEN y < lo THEN 2 / rate * (lo - y) ELSE 0 END + CASE WHEN y > hi THEN 2 / rate * (y - hi) ELSE 0 END", "pinball_loss": _PINBALL}.items():
    query(f"{_RATED}, a AS (SELECT g, vt, avg({_e}) AS e FROM i GROUP BY 1, 2), b AS (SELECT vt, avg(e) AS e FROM a GROUP BY 1) SELECT {r('avg(e)', _m)} FROM b", f"score_{_m}")(lambda spark, d, m=_m: sc.interval_score(_rated(spark, d), m))
    query(f"{_RATED}, a AS (SELECT g, vt, rate, avg({_e}) AS e FROM i GROUP BY 1, 2, 3), b AS (SELECT vt, rate, avg(e) AS e FROM a GROUP BY 1, 2) SELECT rate AS coverage_rate, {r('avg(e)', _m)} FROM b GROUP BY rate", f"score_{_m}_by_rate")(lambda spark, d, m=_m: sc.interval_score(_rated(spark, d), m, over=("step", "vintage", "component", "group")))


@query(f"{_RATED}, a AS (SELECT g, rate, abs(avg((y BETWEEN lo AND hi)::INTEGER) - rate) AS e FROM i GROUP BY 1, 2) SELECT g AS \"group\", {r('avg(e)', 'calibration_error')} FROM a GROUP BY g")
def score_calibration(spark, d):
    return sc.calibration_error(_rated(spark, d), ("group",))


@query(f"{_RATED}, a AS (SELECT g, vt, time, avg({_PINBALL} / 2) AS e FROM i GROUP BY 1, 2, 3) SELECT g AS \"group\", {r('avg(e)', 'crps')} FROM a GROUP BY g")
def score_crps(spark, d):
    return sc.crps(_rated(spark, d), ("group",))


_PROBA = "WITH s AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS t, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1, 2), k AS (SELECT t, label FROM (SELECT DISTINCT t FROM s) CROSS JOIN (SELECT DISTINCT label FROM s)), p AS (SELECT k.t, k.label, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.t) AS p FROM k LEFT JOIN s ON s.t = k.t AND s.label = k.label), b AS (SELECT t, label AS y FROM s QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, label) = 1), pr AS (SELECT p.t, p.label, p.p, b.y FROM p JOIN b ON b.t = p.t + INTERVAL 1 MONTH)"


def _probabilities(spark, d):
    """Shares of the order states in a month as the forecast of the next month's most frequent state."""
    from pyspark.sql import Window

    s = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("t"), F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    every = s.select("t").distinct().crossJoin(s.select("label").distinct())  # months by three states
    p = every.join(s, ["t", "label"], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("t"))).drop("n")
    best = s.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("n"), "label"))).filter("_r = 1").select((F.col("t") - F.expr("INTERVAL 1 MONTH")).alias("t"), F.col("label").alias("y"))
    return p.join(best, "t")


@query(f"{_PROBA}, c AS (SELECT *, sum(p) OVER w AS cp, sum((label = y)::INTEGER) OVER w AS ch, row_number() OVER (PARTITION BY t ORDER BY label DESC) AS k, count(*) OVER (PARTITION BY t) AS n FROM pr WINDOW w AS (PARTITION BY t ORDER BY label ROWS UNBOUNDED PRECEDING)), e AS (SELECT t, -ln(greatest(least(max(CASE WHEN label = y THEN p END), 1 - 1e-15), 1e-15)) AS l, sum(pow(p - (label = y)::INTEGER, 2)) AS b, sum(CASE WHEN k > 1 THEN pow(cp - ch, 2) ELSE 0 END) / max(n - 1) AS rp FROM c GROUP BY t) SELECT {r('avg(l)', 'log_loss')}, {r('avg(b)', 'brier_score')}, {r('avg(rp)', 'ranked_probability_score')} FROM e")
def score_probabilities(spark, d):
    return sc.proba_scores(_probabilities(spark, d), ("t",))


@query(f"{_PROBA}, a AS (SELECT t, y, label AS h FROM pr QUALIFY row_number() OVER (PARTITION BY t ORDER BY p DESC, label) = 1), l AS (SELECT y AS label FROM a UNION SELECT h FROM a), st AS (SELECT label, count(*) FILTER (y = label AND h = label) AS tp, count(*) FILTER (y <> label AND h = label) AS fp, count(*) FILTER (y = label AND h <> label) AS fn FROM l CROSS JOIN a GROUP BY label) SELECT {r('(SELECT avg((y = h)::INTEGER) FROM a)', 'accuracy')}, {r('avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END)', 'precision')}, {r('avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END)', 'recall')}, {r('avg(2 * tp / (2 * tp + fn + fp))', 'f_beta')} FROM st")
def score_hard_labels(spark, d):
    return sc.hard_label_scores(sc.hard_labels(_probabilities(spark, d), ("t",)))


@query(f"WITH s AS (SELECT l_linestatus AS g, l_discount AS score, sum((l_returnflag = 'R')::INTEGER)::DOUBLE AS pos, sum((l_returnflag <> 'R')::INTEGER)::DOUBLE AS neg FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT g AS \"group\", {r('sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))', 'roc_auc')}, {r('sum(pos * tp / (tp + fp)) / sum(pos)', 'pr_auc')} FROM c GROUP BY g")
def score_ranking(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("group"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("truth"))
    return sc.ranking_scores(rows, by=("group",))


# --- conformity --------------------------------------------------------------------------------------------------

_F = "f AS (SELECT mn.g, mn.t1 AS vt, h.h AS step, mn.t1 + INTERVAL 1 MONTH * h.h AS time, mn.y AS f FROM mn CROSS JOIN (VALUES (1), (2)) h(h) WHERE mn.rn = mn.n - (11 - (h.h - 1) % 12))"
_CAL = f"{M}, rolled AS (SELECT a.g, h.h AS step, b.time, c.y AS f, b.y FROM mn a CROSS JOIN (VALUES (1), (2)) h(h) JOIN mn b ON b.g = a.g AND b.rn = a.rn + h JOIN mn c ON c.g = a.g AND c.rn = a.rn - (11 - (h - 1) % 12) WHERE b.rn > b.n - 36), {_F}, sd AS (SELECT g, stddev_pop(y - b) AS scale FROM (SELECT g, y, lag(y) OVER ({BY}) AS b, rn, n FROM mn) WHERE rn <= n - 36 GROUP BY g)"
_KINDS = {"residual": "y - f", "absolute": "abs(y - f)", "gamma": "(y - f) / (f + 1e-8)", "absolute_gamma": "abs((y - f) / (f + 1e-8))", "normalized": "(y - f) / greatest(scale, 1e-8)", "absolute_normalized": "abs((y - f) / greatest(scale, 1e-8))"}
for _k, _e in _KINDS.items():
    _unit = "(f + 1e-8)" if "gamma" in _k else "greatest(scale, 1e-8)" if "normalized" in _k else "1.0"
    _hi = "least(len(s), ceil((len(s) + 1) * 0.8))" if _k.startswith("absolute") else "least(len(s), ceil((len(s) + 1) * 0.9 - 1e-9))"
    _lo = f"-s[{_hi}::INTEGER]" if _k.startswith("absolute") else "s[greatest(1, floor((len(s) + 1) * 0.1 + 1e-9))::INTEGER]"
    query(
        f"{_CAL}, c AS (SELECT rolled.g, step, list_sort(list({_e})) AS s FROM rolled JOIN sd USING (g) GROUP BY 1, 2) SELECT f.g AS \"group\", strftime(f.vt, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(f.time, '%Y-%m-%d %H:%M:%S') AS time, f.step::INTEGER AS step, {r('f', 'y_hat')}, 0.8::DOUBLE AS coverage_rate, {r(f'f + {_lo} * {_unit}', 'lower')}, {r(f'f + s[{_hi}::INTEGER] * {_unit}', 'upper')} FROM f JOIN c ON c.g = f.g AND c.step = f.step JOIN sd ON sd.g = f.g",
        f"conformal_{_k}",
    )(lambda spark, d, k=_k: fc.SplitConformal(seasonality=12, interval="1mo", calibration_size=36, kind=k).fit(monthly(spark, d)).predict_interval(2))


@query(f"{ROLLED}, w AS (SELECT g, abs(y - f) AS s, 1.0 / count(*) OVER (PARTITION BY g) AS w FROM rolled), c AS (SELECT g, s, sum(w) OVER (PARTITION BY g ORDER BY s) AS c FROM w) SELECT g AS \"group\", {r('coalesce(min(s) FILTER (c >= 0.8 - 1e-12), max(s))', 'quantile')} FROM c GROUP BY g")
def weighted_quantile(spark, d):
    from pyspark.sql import Window

    rows = rolled(spark, d).select("group", F.abs(F.col("y") - F.col("y_hat")).alias("score"), (1.0 / F.count("*").over(Window.partitionBy("group"))).alias("weight"))
    return cf.weighted_quantile(rows, 0.2, ("group",))


@query(f"WITH RECURSIVE {MONTHLY}, b AS (SELECT g, time, y, lag(y, 12) OVER ({BY}) AS f FROM monthly), e AS (SELECT g, time, (abs(y - f) > 0.1 * f)::INTEGER AS error, row_number() OVER ({BY}) AS rn FROM b WHERE f IS NOT NULL), a AS (SELECT g, rn, 0.2::DOUBLE AS alpha FROM e WHERE rn = 1 UNION ALL SELECT e.g, e.rn + 1, greatest(0.0, least(1.0, alpha + 0.05 * (0.2 - e.error))) FROM a JOIN e ON e.g = a.g AND e.rn = a.rn) SELECT {KEY}, {r('alpha', 'alpha')} FROM a JOIN e USING (g, rn)")
def adaptive_conformal(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("group").orderBy("time")
    rows = monthly(spark, d).withColumn("f", F.lag("y", 12).over(w)).filter("f is not null").select("group", "time", (F.abs(F.col("y") - F.col("f")) > 0.1 * F.col("f")).cast("double").alias("error"))
    return cf.adaptive_levels(rows, 0.2)


# --- forecasters -------------------------------------------------------------------------------------------------

_FKEY = "g AS \"group\", strftime(t1, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(t1 + INTERVAL 1 MONTH * h, '%Y-%m-%d %H:%M:%S') AS time, h::INTEGER AS step"
_ASK = "ask AS (SELECT DISTINCT g, t0, t1, n, h FROM mn CROSS JOIN (SELECT unnest(range(1, 15)) AS h))"
_BACK = f"{M}, {_ASK}, bk AS (SELECT *, n - rn AS b FROM mn)"
_MODELS = {
    "naive": (fc.SeasonalNaive(seasonality=12, interval="1mo"), "SELECT g, b AS k, y::DOUBLE AS v FROM bk WHERE b < 12"),
    "mean_naive": (fc.MeanSeasonalNaive(seasonality=12, n_seasons=3, interval="1mo"), "SELECT g, b % 12 AS k, avg(y) AS v FROM bk WHERE b < 36 GROUP BY 1, 2"),
    "pattern_average": (fc.PatternSeasonality(seasonality=12, interval="1mo"), "SELECT g, b % 12 AS k, avg(y) AS v FROM bk WHERE b < n - n % 12 GROUP BY 1, 2"),
    "pattern_median": (fc.PatternSeasonality(seasonality=12, method="median", interval="1mo"), "SELECT g, b % 12 AS k, median(y) AS v FROM bk WHERE b < n - n % 12 GROUP BY 1, 2"),
    "pattern_naive": (fc.PatternSeasonality(seasonality=12, method="naive", interval="1mo"), "SELECT g, b % 12 AS k, avg(y) AS v FROM bk WHERE b < 12 GROUP BY 1, 2"),
    "pattern_pooled": (fc.PatternSeasonality(seasonality=12, pooled=True, interval="1mo"), "SELECT a.g, k, v FROM (SELECT DISTINCT g FROM mn) a CROSS JOIN (SELECT b % 12 AS k, avg(y) AS v FROM bk WHERE b < n - n % 12 GROUP BY 1)"),
}
for _k, (_model, _sql) in _MODELS.items():
    query(f"{_BACK}, v AS ({_sql}) SELECT {_FKEY.replace('g AS', 'ask.g AS')}, {r('v', 'y_hat')} FROM ask LEFT JOIN v ON v.g = ask.g AND v.k = 11 - (h - 1) % 12", f"forecast_{_k}")(lambda spark, d, m=_model: m.fit(monthly(spark, d)).predict(14))

_LINE = "l AS (SELECT g, regr_slope(y, t) AS s, regr_intercept(y, t) AS i FROM (SELECT g, y, date_diff('month', t0, time) AS t FROM mn) GROUP BY g)"


@query(f"{M}, {_ASK}, {_LINE} SELECT {_FKEY.replace('g AS', 'ask.g AS')}, {r('''i + s * (date_diff('month', t0, t1) + h)''', 'y_hat')} FROM ask JOIN l ON l.g = ask.g")
def forecast_trend(spark, d):
    return fc.PolynomialTrend(interval="1mo").fit(monthly(spark, d)).predict(14)


@query(f"{M}, {_ASK}, p AS (SELECT g, y, date_diff('month', t0, time) AS t FROM mn) SELECT {_FKEY}, {r('''(SELECT regr_intercept(y, t) FROM p) + (SELECT regr_slope(y, t) FROM p) * (date_diff('month', t0, t1) + h)''', 'y_hat')} FROM ask")
def forecast_trend_pooled(spark, d):
    return fc.PolynomialTrend(interval="1mo", pooled=True).fit(monthly(spark, d)).predict(14)


@query(f"{M}, {_ASK}, p AS (SELECT y, date_diff('month', t0, time)::DOUBLE AS t FROM mn), {fitted('q', 'y', 't', 't * t', 'p')} SELECT {_FKEY}, {r("k0 + ka * (date_diff('month', t0, t1) + h) + kb * pow(date_diff('month', t0, t1) + h, 2)", 'y_hat')} FROM ask, q")
def forecast_trend_quadratic(spark, d):
    return fc.PolynomialTrend(interval="1mo", degree=2, pooled=True).fit(monthly(spark, d)).predict(14)


@query()
def forecast_fourier(spark, d):
    return fc.FourierSeasonality(interval="1mo", seasonality=12, harmonics=(1, 2)).fit(monthly(spark, d)).predict(14)


_WAVE = "2 * pi() * {t} / 12"


@query(f"{M}, {_ASK}, p AS (SELECT y, date_diff('month', t0, time)::DOUBLE AS t FROM mn), {fitted('q', 'y', f'sin({_WAVE.format(t='t')})', f'cos({_WAVE.format(t='t')})', 'p')} SELECT {_FKEY}, {r(f"k0 + ka * sin({_WAVE.format(t="(date_diff('month', t0, t1) + h)")}) + kb * cos({_WAVE.format(t="(date_diff('month', t0, t1) + h)")})", 'y_hat')} FROM ask, q")
def forecast_fourier_first_harmonic(spark, d):
    return fc.FourierSeasonality(interval="1mo", seasonality=12, harmonics=(1,)).fit(monthly(spark, d)).predict(14)


_DIRECT = f"{M}, ld AS (SELECT g, y, rn, n, {', '.join(f'lead(y, {h}) OVER ({BY}) AS a{h}' for h in (1, 2, 3))} FROM mn), cf AS ({' UNION ALL '.join(f'SELECT {h} AS h, regr_slope(a{h}, y) AS s, regr_intercept(a{h}, y) AS i FROM ld WHERE a3 IS NOT NULL' for h in (1, 2, 3))}), lst AS (SELECT g, t0, t1, y FROM mn WHERE rn = n)"


@query(f"{_DIRECT} SELECT {_FKEY}, {r('i + s * y', 'y_hat')} FROM lst CROSS JOIN cf")
def forecast_reduction(spark, d):
    return fc.Reduction(lags=(0,), interval="1mo").fit(monthly(spark, d)).predict(3)


@query(f"{_DIRECT.replace('WHERE a3 IS NOT NULL', '')} SELECT {_FKEY}, {r('i + s * y', 'y_hat')} FROM lst CROSS JOIN cf")
def forecast_reduction_direct(spark, d):
    return fc.Reduction(lags=(0,), strategy="direct", interval="1mo").fit(monthly(spark, d)).predict(3)


@query(f"{_DIRECT.replace('WHERE a3 IS NOT NULL', '')}, c1 AS (SELECT s, i FROM cf WHERE h = 1) SELECT {_FKEY}, {r('CASE h WHEN 1 THEN i + s * y WHEN 2 THEN i + s * (i + s * y) ELSE i + s * (i + s * (i + s * y)) END', 'y_hat')} FROM lst CROSS JOIN c1 CROSS JOIN (VALUES (1), (2), (3)) v(h)")
def forecast_reduction_recursive(spark, d):
    return fc.Reduction(lags=(0,), strategy="recursive", interval="1mo").fit(monthly(spark, d)).predict(3)


@query()
def forecast_reduction_dirrec(spark, d):
    return fc.Reduction(lags=(0, 1, 11), strategy="dir-rec", interval="1mo").fit(monthly(spark, d)).predict(3)


_RES = f"{M}, {_ASK}, {_LINE}, rs AS (SELECT mn.g, n, n - rn AS b, y - (i + s * date_diff('month', t0, time)) AS e FROM mn JOIN l ON l.g = mn.g), pt AS (SELECT g, b % 12 AS k, avg(e) AS v FROM rs WHERE b < n - n % 12 GROUP BY 1, 2)"


@query(f"{_RES} SELECT {_FKEY.replace('g AS', 'ask.g AS')}, {r('''i + s * (date_diff('month', t0, t1) + h) + v''', 'y_hat')} FROM ask JOIN l ON l.g = ask.g JOIN pt ON pt.g = ask.g AND pt.k = 11 - (h - 1) % 12")
def forecast_decomposition(spark, d):
    return fc.Decomposition(interval="1mo", parts=(fc.PolynomialTrend(), fc.PatternSeasonality(seasonality=12))).fit(monthly(spark, d)).predict(14)


_MEMBERS = f"{_BACK}, {_LINE}, a1 AS ({_MODELS['naive'][1]}), a2 AS ({_MODELS['pattern_average'][1]}), m AS (SELECT ask.*, a1.v AS v1, a2.v AS v2, i + s * (date_diff('month', t0, t1) + h) AS v3 FROM ask JOIN a1 ON a1.g = ask.g AND a1.k = 11 - (h - 1) % 12 JOIN a2 ON a2.g = ask.g AND a2.k = 11 - (h - 1) % 12 JOIN l ON l.g = ask.g)"
_PARTS = (fc.SeasonalNaive(seasonality=12), fc.PatternSeasonality(seasonality=12), fc.PolynomialTrend())
for _k, (_opts, _sql) in {"mean": ({}, "(v1 + v2 + v3) / 3"), "median": ({"method": "median"}, "list_median([v1, v2, v3])"), "weighted": ({"weights": (2.0, 1.0, 1.0)}, "(2 * v1 + v2 + v3) / 4")}.items():
    query(f"{_MEMBERS} SELECT {_FKEY}, {r(_sql, 'y_hat')} FROM m", f"ensemble_{_k}")(lambda spark, d, o=_opts: fc.Ensemble(members=_PARTS, interval="1mo", **o).fit(monthly(spark, d)).predict(14))

for _k, (_lo, _hi) in {"envelope": ("min", "max"), "mean": ("avg", "avg"), "median": ("median", "median")}.items():
    query(f"{_RATED} SELECT g AS \"group\", strftime(vt, '%Y-%m-%d %H:%M:%S') AS vintage_time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {r(f'{_lo}(lo)', 'lower')}, {r(f'{_hi}(hi)', 'upper')} FROM i GROUP BY g, vt, time", f"ensemble_interval_{_k}")(lambda spark, d, k=_k: fc.interval_ensemble(_rated(spark, d), k, ("group", "vintage_time", "time")))


@query("WITH v AS (SELECT c_custkey % 100 AS id, o_orderstatus AS label, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1")
def vote_hard(spark, d):
    votes = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_custkey") % 100).alias("id"), F.col("o_orderstatus").alias("label"))
    return fc.majority_vote(votes, ("id",))


@query(f"{_PROBA} SELECT label, {r('avg(p)', 'p')} FROM pr GROUP BY label")
def vote_soft(spark, d):
    return fc.soft_vote(_probabilities(spark, d).drop("t"), ())


# --- selection ---------------------------------------------------------------------------------------------------


def _folds(expanding: bool):
    return se.expanding_window(78, 3, 6) if expanding else se.sliding_window(78, 3, 6, 48)


for _k in ("expanding", "sliding"):
    _f = ", ".join(f"({f.fold}, {f.train_start}, {f.train_end}, {f.test_end})" for f in _folds(_k == "expanding"))
    query(f"{M}, fd(fold, a, b, c) AS (VALUES {_f}), x AS (SELECT fold, te.g, abs(te.y - nv.y) AS e FROM fd JOIN mn te ON te.rn > b AND te.rn <= c JOIN mn nv ON nv.g = te.g AND nv.rn = b - 11 + (te.rn - b - 1) % 12), q AS (SELECT fold, g, avg(e) AS e FROM x GROUP BY 1, 2) SELECT {r('avg(e)', 'mae')}, fold::INTEGER AS fold FROM q GROUP BY fold", f"cv_{_k}")(lambda spark, d, k=_k: se.cross_validate(fc.SeasonalNaive(seasonality=12, interval="1mo"), monthly(spark, d), _folds(k == "expanding")))


@query(f"{M}, fd(fold, a, b, c) AS (VALUES {', '.join(f'({f.fold}, {f.train_start}, {f.train_end}, {f.test_end})' for f in _folds(True))}), cand(cand, s) AS (VALUES (0, 1), (1, 6), (2, 12)), x AS (SELECT cand, s, fold, te.g, abs(te.y - nv.y) AS e FROM cand CROSS JOIN fd JOIN mn te ON te.rn > b AND te.rn <= c JOIN mn nv ON nv.g = te.g AND nv.rn = b - s + 1 + (te.rn - b - 1) % s), q AS (SELECT cand, s, fold, g, avg(e) AS e FROM x GROUP BY ALL), f AS (SELECT cand, s, fold, avg(e) AS e FROM q GROUP BY ALL), z AS (SELECT cand, s, avg(e) AS m, stddev_pop(e) AS sd FROM f GROUP BY ALL) SELECT cand::INTEGER AS candidate, '{{''seasonality'': ' || s || '}}' AS params, {r('m', 'mean')}, {r('sd', 'std')}, rank() OVER (ORDER BY m)::INTEGER AS rank FROM z")
def grid_search(spark, d):
    return se.search(fc.SeasonalNaive(interval="1mo"), monthly(spark, d), _folds(True), list(se.grid({"seasonality": [1, 6, 12]})))


@query(f"{M} SELECT {KEY}, y FROM mn WHERE rn > n - ceil(n * 0.25)")
def split_tail(spark, d):
    return se.train_test_split(monthly(spark, d), 0.25)[1]


# --- analytics ---------------------------------------------------------------------------------------------------

_D = f"WITH {DAILY}, c AS (SELECT g, time, y, x, y - avg(y) OVER (PARTITION BY g) AS a, x - avg(x) OVER (PARTITION BY g) AS b FROM daily)"


@query(f"{_D}, l AS (SELECT g, {', '.join(f'coalesce(a * lag(a, {k}) OVER ({BY}), 0) AS p{k}' for k in range(4))} FROM c), s AS (SELECT g, {', '.join(f'sum(p{k}) AS s{k}' for k in range(4))} FROM l GROUP BY g) {' UNION ALL '.join(f'''SELECT g AS "group", {k}::INTEGER AS lag, {r(f's{k} / s0', 'acf')} FROM s''' for k in range(4))}")
def acf(spark, d):
    return an.autocorrelation(daily(spark, d), 3)


@query(f"{_D}, l AS (SELECT g, a, b, {', '.join(f'coalesce(a * lag(b, {k}) OVER ({BY}), 0) AS p{k}' for k in range(3))} FROM c), s AS (SELECT g, sqrt(sum(a * a) * sum(b * b)) AS s, {', '.join(f'sum(p{k}) AS s{k}' for k in range(3))} FROM l GROUP BY g) {' UNION ALL '.join(f'''SELECT g AS "group", {k}::INTEGER AS lag, {r(f's{k} / s', 'ccf')} FROM s''' for k in range(3))}")
def ccf(spark, d):
    return an.cross_correlation(daily(spark, d), "y", "x", 2)


@query(f"WITH {DAILY} SELECT g AS \"group\", year(time)::INTEGER AS row, {', '.join(r(f'avg(y) FILTER (month(time) = {m})', f'm{m}') for m in range(1, 13))} FROM daily GROUP BY 1, 2")
def seasonal_heatmap(spark, d):
    return an.seasonal_table(daily(spark, d), "year(time)", list(range(1, 13)))


@query(f"WITH {DAILY}, q AS (SELECT g, min(y) AS low, quantile_cont(y, 0.25) AS q1, median(y) AS mid, quantile_cont(y, 0.75) AS q3, max(y) AS high FROM daily GROUP BY g) SELECT q.g AS \"group\", {r('low', 'low')}, {r('q1', 'q1')}, {r('mid', 'mid')}, {r('q3', 'q3')}, {r('high', 'high')}, {r('q1 - 1.5 * (q3 - q1)', 'fence_low')}, {r('q3 + 1.5 * (q3 - q1)', 'fence_high')}, (SELECT count(*) FROM daily WHERE daily.g = q.g AND (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))) AS beyond FROM q")
def boxplot_statistics(spark, d):
    return an.box_statistics(daily(spark, d))


@query(f"WITH {DAILY} SELECT {KEY}, (abs(y - avg(y) OVER (PARTITION BY g)) > 3 * stddev_samp(y) OVER (PARTITION BY g)) AS is_outlier FROM daily")
def outlier_flags(spark, d):
    return an.outlier_flags(daily(spark, d)).select("group", "time", "is_outlier")


@query(f"{M}, t AS (SELECT g, time, y, rn, CASE WHEN rn > 6 AND rn <= n - 6 THEN (sum(y) OVER (PARTITION BY g ORDER BY time ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(y, 6) OVER ({BY}) + lead(y, 6) OVER ({BY})) / 2) / 12 END AS trend FROM mn), s AS (SELECT g, (rn - 1) % 12 AS p, avg(y - trend) AS s FROM t GROUP BY 1, 2), m AS (SELECT g, avg(s) AS m FROM s GROUP BY 1) SELECT {KEY.replace('g AS', 't.g AS')}, y, {r('trend', 'trend')}, {r('s - m', 'seasonal')}, {r('y - trend - (s - m)', 'residual')} FROM t JOIN s ON s.g = t.g AND s.p = (rn - 1) % 12 JOIN m ON m.g = t.g")
def decompose_additive(spark, d):
    return an.decompose(monthly(spark, d), 12)
