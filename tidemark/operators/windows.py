"""Window operators: lags, rolling statistics, seasonal profiles, smoothing, signal operators. Warm-up rows are dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.base import Operator, numbered
from tidemark.operators.scan import linear_scan


@dataclass
class Lag(Operator):
    """{c}_lag_{k} of every value column; the first max(lags) rows of a series are dropped."""

    lags: tuple[int, ...] = (1,)
    drop: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        w = self.by_time()
        lags = [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in self.values(df) for k in self.lags]
        out = numbered(df, self).select(*self.index(), *lags, "_rn")
        return (out.filter(F.col("_rn") >= max(self.lags)) if self.drop else out).drop("_rn")


def tabularize(df: DataFrame, lags: tuple[int, ...], keep: bool = True, **options) -> DataFrame:
    """df's columns with all lags beside them, without the first max(lags) rows."""
    op = Lag(lags=lags, **options)
    w = op.by_time()
    out = numbered(df, op).select("*", *(F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in op.values(df) for k in lags))
    return out.filter(F.col("_rn") >= max(lags)).drop("_rn", *([] if keep else op.values(df)))


def _nearest(c: str, q: float, w: WindowSpec, size: int) -> Column:
    """The order statistic nearest to quantile q of a full window."""
    return F.element_at(F.array_sort(F.collect_list(c).over(w)), int((size - 1) * q + 0.5) + 1)


STATISTICS: dict[str, Callable[[str, WindowSpec, int], Column]] = {
    "mean": lambda c, w, n: F.avg(c).over(w),
    "std": lambda c, w, n: F.stddev_samp(c).over(w),
    "var": lambda c, w, n: F.var_samp(c).over(w),
    "min": lambda c, w, n: F.min(c).over(w),
    "max": lambda c, w, n: F.max(c).over(w),
    "sum": lambda c, w, n: F.sum(c).over(w),
    "median": lambda c, w, n: F.percentile(c, F.lit(0.5)).over(w),
    "q25": lambda c, w, n: _nearest(c, 0.25, w, n),
    "q75": lambda c, w, n: _nearest(c, 0.75, w, n),
}


@dataclass
class RollingStatistics(Operator):
    """Trailing statistics over `window_size` values, `seasonality` rows apart; null unless all of them are there.

    Names: {c}_{stat}, or {c}_s{k}_{stat} with a seasonality over 1. The first (window_size - 1) * seasonality rows are dropped.
    """

    window_size: int = 7
    statistics: tuple[str, ...] = ("mean",)
    seasonality: int = 1

    def transform(self, df: DataFrame) -> DataFrame:
        df = numbered(df, self).withColumn("_phase", F.col("_rn") % self.seasonality)
        w = self.by_time("_phase").rowsBetween(1 - self.window_size, 0)
        tag = f"s{self.seasonality}_" if self.seasonality > 1 else ""
        made = [F.when(F.count(c).over(w) == self.window_size, STATISTICS[s](c, w, self.window_size)).alias(f"{c}_{tag}{s}") for c in self.values(df.drop("_rn", "_phase")) for s in self.statistics]
        return df.select(*self.index(), *made, "_rn").filter(F.col("_rn") >= (self.window_size - 1) * self.seasonality).drop("_rn")


@dataclass
class HorizonRollingStatistics(Operator):
    """For each step h of a horizon, the statistic of the last n_seasons values of that step's phase: {c}_s{k}_{stat}_step_{h}."""

    seasonality: int = 7
    n_seasons: int = 2
    statistics: tuple[str, ...] = ("mean",)
    horizon: int = 3

    def transform(self, df: DataFrame) -> DataFrame:
        k, n = self.seasonality, self.n_seasons
        df = numbered(df, self).withColumn("_phase", F.col("_rn") % k)
        w = self.by_time("_phase").rowsBetween(1 - n, 0)
        columns = self.values(df.drop("_rn", "_phase"))
        df = df.select(*self.index(), "_rn", *(F.when(F.count(c).over(w) == n, STATISTICS[s](c, w, n)).alias(f"{c}_s{k}_{s}") for c in columns for s in self.statistics))
        made = [F.lag(f"{c}_s{k}_{s}", k * -(-h // k) - h).over(self.by_time()).alias(f"{c}_s{k}_{s}_step_{h}") for c in columns for s in self.statistics for h in range(1, self.horizon + 1)]
        return df.select(*self.index(), *made, "_rn").filter(F.col("_rn") >= n * k - 1).drop("_rn")


@dataclass
class ExponentialMovingAverage(Operator):
    """{c}_ewma, by a recurrence over chunks in the JVM; adjust weighs by the decayed sum of weights.

    A null keeps the last value; with ignore_nulls=False it also lets weights decay.
    """

    alpha: float = 0.5
    adjust: bool = True
    ignore_nulls: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        w, columns, scans = self.by_time(), self.values(df), {}
        rows = df.select(*self.index(), *columns)
        for i, c in enumerate(columns):
            x, keep = F.col(c).cast("double"), F.lit(1 - self.alpha)
            there, own = x.isNotNull(), F.lit(1.0 if self.adjust else self.alpha)
            rows = rows.withColumn(f"_n{i}", F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            first = there & (F.col(f"_n{i}") == 1)
            if self.adjust or self.ignore_nulls:  # a weighted mean: sums of weighted values and of weights decay alike
                decay = F.when(there | F.lit(not self.ignore_nulls), keep).otherwise(1.0)
                weight = F.when(~there, 0.0).when(first, 1.0).otherwise(own)
                scans[f"_v{i}"], scans[f"_w{i}"] = (decay, F.coalesce(weight * x, F.lit(0.0))), (decay, weight)
            else:  # weights begin anew at every value, after what the nulls before it took away
                rows = rows.withColumn(f"_at{i}", F.row_number().over(w))
                last = F.last(F.when(there, F.col(f"_at{i}")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
                rows = rows.withColumn(f"_gap{i}", F.col(f"_at{i}") - last)
                old = F.pow(keep, F.col(f"_gap{i}").cast("double"))
                share = F.when(~there, 1.0).when(first, 0.0).otherwise(old / (old + self.alpha))
                scans[f"_v{i}"] = (F.coalesce(share, F.lit(1.0)), F.when(there, F.when(first, x).otherwise((1 - share) * x)).otherwise(0.0))
        made = linear_scan(rows, scans, self.keys, self.time)
        if f"_w{0}" in scans:
            return made.select(*self.index(), *(F.try_divide(f"_v{i}", f"_w{i}").alias(f"{c}_ewma") for i, c in enumerate(columns)))
        seen = made.join(rows.select(*self.index(), *(f"_n{i}" for i in range(len(columns)))), self.index())
        return seen.select(*self.index(), *(F.when(F.col(f"_n{i}") > 0, F.col(f"_v{i}")).alias(f"{c}_ewma") for i, c in enumerate(columns)))


@dataclass
class SlidingWindowFunction(Operator):
    """func(frame of the last window_size rows) -> dict, for any Python function.

    Rows go to Python in chunks of `chunk` ends, each with the rows before it that its windows need, so that a long series
    is many tasks' work and no task holds more than chunk + window_size rows of it.
    """

    func: Callable[[pd.DataFrame], dict] = field(default=lambda rows: {})
    window_size: int = 1
    schema: str = ""
    chunk: int = 4096

    def transform(self, df: DataFrame) -> DataFrame:
        n, time, func, keys, chunk = self.window_size, self.time, self.func, list(self.keys), max(self.chunk, self.window_size)
        rows = numbered(df, self).withColumn("_part", F.floor(F.col("_rn") / chunk))
        near = F.when(F.col("_rn") % chunk >= chunk - n + 1, F.array(F.col("_part"), F.col("_part") + 1)).otherwise(F.array("_part"))
        rows = rows.withColumn("_part", F.explode(near))
        names = [x.split()[0] for x in self.schema.split(",")]

        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(time)
            first = int(own["_part"].iloc[0]) * chunk
            begin = int(own["_rn"].iloc[0])
            shown, made = own.drop(columns=["_rn", "_part"]), []
            for i in range(max(n - 1, first - begin), len(own)):
                made.append({**{k: own[k].iloc[i] for k in (*keys, time)}, **func(shown.iloc[i - n + 1 : i + 1])})
            return pd.DataFrame(made, columns=[*keys, time, *names])

        index = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in self.index())
        return rows.groupBy(*keys, "_part").applyInPandas(run, f"{index}, {self.schema}")


@dataclass
class Integrator(Operator):
    """{c}_integrated: the cumulative integral with the grid's step in seconds, by trapezoids, or by parabolas through three
    rows each ("simpson": intervals of even place with the two rows that follow, the others with the one before)."""

    seconds: float = 86400.0
    method: str = "trapezoid"

    def transform(self, df: DataFrame) -> DataFrame:
        w, out = self.by_time(), numbered(df, self).withColumn("_n", F.count("*").over(self.whole()))
        for c in self.values(df):
            at = lambda k, c=c: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
            area = (F.col(c) + at(-1)) / 2  # of the interval that ends at the row
            if self.method == "simpson":
                ahead, behind = (1.25 * at(-1) + 2 * F.col(c) - 0.25 * at(1)) / 3, (1.25 * F.col(c) + 2 * at(-1) - 0.25 * at(-2)) / 3
                parabola = F.when((F.col("_rn") % 2 == 1) & (F.col("_rn") < F.col("_n") - 1), ahead).otherwise(behind)
                area = F.when(F.col("_n") >= 3, parabola).otherwise(area)
            out = out.withColumn(f"_{c}", F.when(F.col("_rn") == 0, 0.0).otherwise(F.coalesce(area * self.seconds, F.lit(0.0))))
        return out.select(*self.index(), *(F.sum(f"_{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}_integrated") for c in self.values(df)))


@dataclass
class Differentiator(Operator):
    """{c}_differentiated: central differences, one-sided ones of first or second order at the ends."""

    seconds: float = 86400.0
    order: int = 1

    def transform(self, df: DataFrame) -> DataFrame:
        w, dt = self.by_time(), self.seconds

        def one(c: str) -> Column:
            at = lambda k: F.lead(c, k).over(w)
            x = F.col(c)
            first = (at(1) - x) / dt if self.order == 1 else (-3 * x + 4 * at(1) - at(2)) / (2 * dt)
            last = (x - F.lag(c, 1).over(w)) / dt if self.order == 1 else (3 * x - 4 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)) / (2 * dt)
            inner = (at(1) - F.lag(c, 1).over(w)) / (2 * dt)
            return F.when(F.col("_rn") == 0, first).when(F.col("_rn") == F.col("_n") - 1, last).otherwise(inner).alias(f"{c}_differentiated")

        columns = self.values(df)
        return numbered(df, self).withColumn("_n", F.count("*").over(self.whole())).select(*self.index(), *map(one, columns))


@dataclass
class StepAggregator(Operator):
    """Row-wise statistics over the {base}_step_{h} columns of each base: {base}_{stat}, and {base}_coverage on request.

    null_policy "ignore" leaves nulls out; "propagate" makes the result null if any step is.
    """

    bases: tuple[str, ...] = ()
    aggregations: tuple[str, ...] = ("mean",)
    null_policy: str = "ignore"
    emit_coverage: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        made = []
        for base in self.bases:
            steps = sorted((c for c in df.columns if c.startswith(f"{base}_step_") and c.rsplit("_", 1)[1].isdigit()), key=lambda c: int(c.rsplit("_", 1)[1]))
            every = F.array(*(F.col(c).cast("double") for c in steps))
            xs = F.filter(every, lambda x: x.isNotNull())
            n = F.size(xs)
            total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
            mean = F.when(n > 0, total / n)
            squares = F.aggregate(F.transform(xs, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
            known = {"mean": mean, "sum": F.when(n > 0, total), "min": F.array_min(xs), "max": F.array_max(xs), "std": F.when(n > 1, F.sqrt(squares / (n - 1)))}
            for a in self.aggregations:
                value = known[a]
                made.append((value if self.null_policy == "ignore" else F.when(n == len(steps), value)).alias(f"{base}_{a}"))
            if self.emit_coverage:
                made.append(n.alias(f"{base}_coverage"))
        return df.select(*self.index(), *made)
