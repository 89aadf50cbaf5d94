"""Autocorrelation, seasonal tables, box statistics, outlier flags and classical decomposition of long panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(keys, time):
    return Window.partitionBy(*keys).orderBy(time)


def autocorrelation(df: DataFrame, lags: int, keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y") -> DataFrame:
    """(keys, lag, acf) for lags 0..lags: covariances at a lag over the variance, both by the whole series' mean."""
    centred = df.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    w = _by(keys, time)
    rows = centred.select(*keys, *(F.coalesce(F.col("_c") * F.lag("_c", k).over(w), F.lit(0.0)).alias(f"_{k}") for k in range(lags + 1)))
    sums = rows.groupBy(*keys).agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in range(lags + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_{k}"), F.col("_0")).alias("acf")) for k in range(lags + 1)))
    return sums.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*")


def cross_correlation(df: DataFrame, left: str, right: str, lags: int, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """(keys, lag, ccf): left at t with right at t - lag, for lags 0..lags."""
    whole, w = Window.partitionBy(*keys), _by(keys, time)
    c = df.select(*keys, time, (F.col(left) - F.avg(left).over(whole)).alias("_a"), (F.col(right) - F.avg(right).over(whole)).alias("_b"))
    rows = c.select(*keys, (F.col("_a") * F.col("_a")).alias("_aa"), (F.col("_b") * F.col("_b")).alias("_bb"), *(F.coalesce(F.col("_a") * F.lag("_b", k).over(w), F.lit(0.0)).alias(f"_{k}") for k in range(lags + 1)))
    sums = rows.groupBy(*keys).agg(F.sqrt(F.sum("_aa") * F.sum("_bb")).alias("_s"), *(F.sum(f"_{k}").alias(f"_{k}") for k in range(lags + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_{k}"), F.col("_s")).alias("ccf")) for k in range(lags + 1)))
    return sums.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*")


def seasonal_table(df: DataFrame, rows: str, columns: list[int], keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y") -> DataFrame:
    """Mean values by a row expression and the month (as columns), by one conditional aggregate."""
    return df.groupBy(*keys, F.expr(rows).alias("row")).agg(*(F.avg(F.when(F.month(time) == m, F.col(value))).alias(f"m{m}") for m in columns))


def box_statistics(df: DataFrame, by: tuple[str, ...] = ("group",), value: str = "y") -> DataFrame:
    """Quartiles, fences at 1.5 interquartile ranges, and the number of values beyond them."""
    q = df.groupBy(*by).agg(F.min(value).alias("low"), F.percentile(value, F.lit(0.25)).alias("q1"), F.median(value).alias("mid"), F.percentile(value, F.lit(0.75)).alias("q3"), F.max(value).alias("high"))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    q = q.withColumns({"fence_low": F.col("q1") - spread, "fence_high": F.col("q3") + spread})
    beyond = df.join(q, list(by)).groupBy(*by).agg(F.count_if((F.col(value) < F.col("fence_low")) | (F.col(value) > F.col("fence_high"))).alias("beyond"))
    return q.join(beyond, list(by))


def outlier_flags(df: DataFrame, keys: tuple[str, ...] = ("group",), value: str = "y", limit: float = 3.0) -> DataFrame:
    """df with is_outlier: more than limit deviations from the series' mean."""
    w = Window.partitionBy(*keys)
    return df.withColumn("is_outlier", F.abs(F.col(value) - F.avg(value).over(w)) > limit * F.stddev_samp(value).over(w))


def decompose(df: DataFrame, period: int, keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y") -> DataFrame:
    """trend, seasonal and residual of an additive classical decomposition: a centred mean over a period, then centred phase means."""
    w = _by(keys, time)
    half = period // 2
    rows = df.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    if period % 2:
        trend = F.avg(value).over(w.rowsBetween(-half, half))
    else:  # half weights at both ends
        trend = (F.sum(value).over(w.rowsBetween(-half, half)) - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2) / period
    rows = rows.withColumn("trend", F.when((F.col("_rn") >= half) & (F.col("_rn") < F.col("_n") - half), trend))
    rows = rows.withColumn("_phase", F.col("_rn") % period)
    phase = Window.partitionBy(*keys, "_phase")
    rows = rows.withColumn("_s", F.avg(F.col(value) - F.col("trend")).over(phase))
    means = rows.select(*keys, "_phase", "_s").distinct().groupBy(*keys).agg(F.avg("_s").alias("_m"))
    rows = rows.join(means, list(keys)).withColumn("seasonal", F.col("_s") - F.col("_m"))
    return rows.select(*keys, time, value, "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"))


def partial_autocorrelation(df: DataFrame, lags: int, keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y", adjusted: bool = True) -> DataFrame:
    """(keys, lag, pacf) for lags 0..lags by the Yule-Walker equations, solved by Levinson-Durbin for all series of a batch at
    once. adjusted: autocovariances are divided by the number of their products. Only lags + 2 numbers a series are moved."""
    w, whole = _by(keys, time), Window.partitionBy(*keys)
    c = df.withColumn("_c", F.col(value) - F.avg(value).over(whole))
    rows = c.select(*keys, *(F.coalesce(F.col("_c") * F.lag("_c", k).over(w), F.lit(0.0)).alias(f"_{k}") for k in range(lags + 1)))
    n = F.count("*")
    sums = rows.groupBy(*keys).agg(F.array(*(F.sum(f"_{k}") / (n - k if adjusted else n) for k in range(lags + 1))).alias("_r"))

    @F.pandas_udf("array<double>")
    def solved(found: pd.Series) -> pd.Series:
        r = np.stack([np.asarray(x, float) for x in found])
        with np.errstate(divide="ignore", invalid="ignore"):
            r = r / r[:, :1]
            out, phi = np.ones_like(r), np.zeros((len(r), 0))
            for k in range(1, lags + 1):
                top = r[:, k] - (phi * r[:, k - 1 : 0 : -1]).sum(axis=1)
                own = top / (1 - (phi * r[:, 1:k]).sum(axis=1))
                phi = np.concatenate([phi - own[:, None] * phi[:, ::-1], own[:, None]], axis=1)
                out[:, k] = own
        return pd.Series(list(out))

    return sums.select(*keys, F.posexplode(solved("_r")).alias("lag", "pacf"))


def correlations(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, left, right, r) of all pairs of columns, by one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    each = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(a, b).alias("r")) for a, b in pairs))
    return df.groupBy(*by).agg(each.alias("_e")).select(*by, F.explode("_e").alias("_e")).select(*by, "_e.*")


#: Calendar seasons: the place in the season, and the cycle it belongs to.
SEASONS = {
    "month": ("month(time)", "year(time)"),
    "quarter": ("quarter(time)", "year(time)"),
    "day_of_week": ("weekday(time) + 1", "date_trunc('week', time)"),
    "day": ("day(time)", "date_trunc('month', time)"),
    "hour": ("hour(time)", "date_trunc('day', time)"),
}


def seasonal_profile(df: DataFrame, season: str = "month", keys: tuple[str, ...] = ("group",), value: str = "y", by_cycle: bool = False) -> DataFrame:
    """(keys, season, [cycle,] mean, n): means of a calendar season, over all cycles or in each."""
    place, cycle = SEASONS[season]
    more = [F.expr(cycle).alias("cycle")] if by_cycle else []
    return df.groupBy(*keys, F.expr(place).cast("int").alias("season"), *more).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def lag_pairs(df: DataFrame, lags: tuple[int, ...], keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y") -> DataFrame:
    """(keys, time, lag, before, now) for every row that has a row so far back."""
    w = _by(keys, time)
    each = F.array(*(F.struct(F.lit(k).alias("lag"), F.lag(value, k).over(w).alias("before")) for k in lags))
    rows = df.select(*keys, time, F.col(value).alias("now"), each.alias("_e"))
    return rows.withColumn("_e", F.explode("_e")).filter("_e.before is not null").select(*keys, time, "_e.lag", "_e.before", "now")


def rolling(df: DataFrame, window: int, keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y") -> DataFrame:
    """df with mean, std, min and max of the last `window` rows, null until there are so many."""
    w = _by(keys, time).rowsBetween(1 - window, 0)
    full = F.count("*").over(w) == window
    return df.withColumns({name: F.when(full, f(value).over(w)) for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))})


def missing(df: DataFrame, interval: str | None = None, period: str | None = None, keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y") -> DataFrame:
    """(keys, time, is_missing): of each row; with interval on the full grid; with period whether any row of it is missing."""
    from tidemark.operators.base import Operator
    from tidemark.operators.resample import on_grid

    rows = df.select(*keys, time, value)
    rows = on_grid(rows, interval, Operator(keys=keys, time=time)) if interval else rows
    gone = F.col(value).isNull()
    if not period:
        return rows.select(*keys, time, gone.alias("is_missing"))
    return rows.groupBy(*keys, F.date_trunc(period, time).cast("timestamp_ntz").alias(time)).agg(F.bool_or(gone).alias("is_missing"))


def histogram(df: DataFrame, bins: int, by: tuple[str, ...] = ("group",), value: str = "y", density: bool = True) -> DataFrame:
    """(by, bin, low, high, n, density): equal bins between the least and the largest value of a group; the last one has both ends."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_all"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    rows = df.filter(F.col(value).isNotNull()).join(ends, list(by)).withColumn("_w", width)
    rows = rows.withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int"))
    out = rows.groupBy(*by, "bin").agg(F.first("_lo").alias("_lo"), F.first("_w").alias("_w"), F.first("_all").alias("_all"), F.count("*").alias("n"))
    low = F.col("_lo") + F.col("bin") * F.col("_w")
    return out.select(*by, "bin", low.alias("low"), (low + F.col("_w")).alias("high"), "n", *([(F.col("n") / (F.col("_all") * F.col("_w"))).alias("density")] if density else []))


def kernel_density(df: DataFrame, points: int = 200, by: tuple[str, ...] = ("group",), value: str = "y", bins: int = 2000) -> DataFrame:
    """(by, x, density): a Gaussian kernel of Scott's width at equally spaced points. The values are binned first (into far more
    bins than points), so that the work does not grow with the rows."""
    binned = histogram(df, bins, by, value, density=False)
    spread = df.groupBy(*by).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = spread.withColumn("_h", F.greatest(F.coalesce("_sd", F.lit(0.0)) * F.pow("_n", F.lit(-0.2)), F.lit(1e-12)))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    grid = spread.select(*by, "_n", "_h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"), F.col("_lo"), step.alias("_st")).withColumn("x", F.col("_lo") + F.col("_i") * F.col("_st"))
    z = (F.col("x") - (F.col("low") + F.col("high")) / 2) / F.col("_h")
    rows = grid.join(binned.select(*by, "low", "high", "n"), list(by)) if by else grid.crossJoin(binned.select("low", "high", "n"))  # points by bins
    return rows.groupBy(*by, "x").agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / F.first(F.col("_n") * F.col("_h") * F.lit(float(np.sqrt(2 * np.pi))))).alias("density"))


def spectrum(df: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y", unwrap: bool = True) -> DataFrame:
    """(keys, frequency, power, phase): the periodogram of the centred series (one-sided density, a row as unit of time) and the
    phase of the series itself, for all frequencies but zero. One series is one Arrow batch: n numbers and a fast transform."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", frequency double, power double, phase double"

    def run(name: tuple, own: pd.DataFrame) -> pd.DataFrame:
        y = own.sort_values(time)[value].to_numpy(float)
        n = len(y)
        power = np.abs(np.fft.rfft(y - y.mean())) ** 2 / n
        power[1 : None if n % 2 else -1] *= 2
        phase = np.angle(np.fft.rfft(y))
        phase = np.unwrap(phase) if unwrap else phase
        return pd.DataFrame({**dict(zip(keys, name)), "frequency": np.fft.rfftfreq(n)[1:], "power": power[1:], "phase": phase[1:]})

    return df.filter(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def peaks(found: DataFrame, n: int = 3, keys: tuple[str, ...] = ("group",)) -> DataFrame:
    """(keys, period, power, rank) of the n largest powers of a spectrum."""
    w = Window.partitionBy(*keys).orderBy(F.desc("power"), "frequency")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(*keys, (1 / F.col("frequency")).alias("period"), "power", "rank")


def quantile_coverage(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, level, share): how often y is at or below each quantile that the bounds of an interval table stand for, and the
    point forecast (level 0.5), where there is one."""
    rate = F.col("coverage_rate")
    each = [F.struct(F.round((1 - rate) / 2, 6).alias("level"), F.col("lower").alias("q")), F.struct(F.round((1 + rate) / 2, 6).alias("level"), F.col("upper").alias("q"))]
    if "y_hat" in rows.columns:
        each.append(F.struct(F.lit(0.5).alias("level"), F.col("y_hat").cast("double").alias("q")))
    return rows.withColumn("_e", F.explode(F.array(*each))).groupBy(*by, F.col("_e.level").alias("level")).agg(F.avg((F.col("y") <= F.col("_e.q")).cast("double")).alias("share"))


def interval_coverage(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, coverage_rate, share): how often y is inside."""
    return rows.groupBy(*by, "coverage_rate").agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("share"))


def residuals(rows: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, mean, std, skew, kurtosis, lag one correlation) of y - y_hat in order of time."""
    e = rows.withColumn("_e", F.col("y") - F.col("y_hat"))
    e = e.withColumn("_b", F.lag("_e").over(Window.partitionBy(*by).orderBy("time")))
    return e.groupBy(*by).agg(F.avg("_e").alias("mean"), F.stddev_samp("_e").alias("std"), F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurtosis"), F.corr("_e", "_b").alias("lag_one"))


def overlay(**tables: DataFrame) -> DataFrame:
    """Tables of one kind on top of each other, with the name of each in `source`: truth and forecasts, or a series and its
    resampled form."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("source", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def score_table(rows: DataFrame, metric: str, x: str, y: str | None = None) -> DataFrame:
    """(x, [y,] metric): point scores by one or two of group, component, vintage, step."""
    from tidemark.metrics.scores import EVERY, point_score

    return point_score(rows, metric, over=tuple(d for d in EVERY if d not in (x, y))).drop("time")


def score_trend(rows: DataFrame, metric: str) -> DataFrame:
    """(slope, start): the least-squares line of a score by step."""
    by_step = score_table(rows, metric, "step")
    return by_step.agg(F.regr_slope(metric, "step").alias("slope"), F.regr_intercept(metric, "step").alias("start"))


def _loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray | None = None, degree: int = 1) -> np.ndarray:
    """Local regression with tricube weights of the `span` nearest rows (a wider reach where span is more than there are)."""
    n, x = len(y), np.arange(len(y), dtype=float)
    q = min(span, n)
    first = np.clip(np.searchsorted(x, at) - q // 2, 0, n - q)
    while True:  # the window of q rows whose farthest one is nearest
        right = np.minimum(first + q, n - 1)
        better = (first + q < n) & (np.abs(x[right] - at) < np.abs(x[first] - at))
        if not better.any():
            break
        first = first + better
    while True:
        better = (first > 0) & (np.abs(x[np.maximum(first - 1, 0)] - at) < np.abs(x[first + q - 1] - at))
        if not better.any():
            break
        first = first - better
    i = first[:, None] + np.arange(q)
    d = np.abs(x[i] - at[:, None])
    reach = d.max(axis=1) + max(0, (span - n) // 2)
    w = np.clip(1 - (d / np.maximum(reach, 1e-12)[:, None]) ** 3, 0, None) ** 3
    if weights is not None:
        w = w * weights[i]
    total = w.sum(axis=1)
    w = np.where(total[:, None] > 0, w, 1.0)
    w = w / w.sum(axis=1, keepdims=True)
    mean = (w * x[i]).sum(axis=1)
    out = (w * y[i]).sum(axis=1)
    if degree:
        centred = x[i] - mean[:, None]
        var = (w * centred**2).sum(axis=1)
        slope = np.where(var > 1e-9 * max(1, n) ** 2, (w * centred * y[i]).sum(axis=1) / np.maximum(var, 1e-300), 0.0)
        out = out + slope * (at - mean)
    return out


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], y]))
    return (c[n:] - c[:-n]) / n


def _odd(n: float) -> int:
    n = int(np.ceil(n))
    return n + 1 - n % 2


def stl_parts(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend of one series by local regression (Cleveland et al. 1990): the seasonal from smoothed cycle
    subseries less their low pass, the trend from the rest, with robustness weights between outer rounds."""
    n, at = len(y), np.arange(len(y), dtype=float)
    trend_span, low_span = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1 if period % 2 == 0 else period)
    trend, weights, season = np.zeros(n), None, np.zeros(n)
    for outer in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            rest, cycle = y - trend, np.empty(n + 2 * period)
            for p in range(period):
                own = rest[p::period]
                cycle[p::period] = _loess(own, seasonal, np.arange(-1, len(own) + 1, dtype=float), None if weights is None else weights[p::period])
            low = _moving(_moving(_moving(cycle, period), period), 3)
            season = cycle[period:-period] - _loess(low, low_span, at)
            trend = _loess(y - season, trend_span, at, weights)
        if robust and outer < 14:
            r = np.abs(y - season - trend)
            h = 6 * np.median(r)
            weights = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / max(h, 1e-300)) ** 2) ** 2, 0.0)) if h > 0 else np.ones(n)
    return season, trend


def stl(df: DataFrame, periods: tuple[int, ...], robust: bool = True, multiplicative: bool = False, keys: tuple[str, ...] = ("group",), time: str = "time", value: str = "y", rounds: int = 2) -> DataFrame:
    """(keys, time, observed, trend, seasonal_{p}..., residual, seasonal_adjusted) of each series; of several periods the shorter
    one is taken out first, in `rounds` passes, with longer seasonal windows for longer ones. Missing values are interpolated.

    multiplicative: on logarithms, shifted where a value is not positive. A series of less than two cycles of a period is an
    error. One series is one Arrow batch.
    """
    periods = tuple(sorted(periods))
    index = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, time))
    names = ["observed", "trend", *(f"seasonal_{p}" for p in periods), "residual", "seasonal_adjusted"]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(time)
        y = own[value].astype(float).interpolate(limit_direction="both").to_numpy()
        if len(y) < 2 * periods[-1]:
            raise ValueError(f"{len(y)} rows are less than two cycles of {periods[-1]}")
        shift = 0.0
        if multiplicative:
            shift = abs(y.min()) + 1e-8 if y.min() <= 0 else 0.0
            y = np.log(y + shift)
        seasons, trend = {p: np.zeros(len(y)) for p in periods}, np.zeros(len(y))
        for _ in range(rounds if len(periods) > 1 else 1):
            for i, p in enumerate(periods):
                rest = y - sum(s for q, s in seasons.items() if q != p)
                seasons[p], trend = stl_parts(rest, p, 7 + 4 * (i + (len(periods) > 1)), robust)
        residual, every = y - trend - sum(seasons.values()), sum(seasons.values())
        out = {"observed": y, "trend": trend, **{f"seasonal_{p}": s for p, s in seasons.items()}, "residual": residual, "seasonal_adjusted": y - every}
        if multiplicative:
            out = {k: np.exp(v) for k, v in out.items()} | {"observed": np.exp(y) - shift}
            out["seasonal_adjusted"] = out["observed"] / np.exp(every)
        return pd.concat([own[[*keys, time]].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(run, index + "".join(f", {n} double" for n in names))
