"""Forecasters. fit() keeps lazy tables or a few coefficients; predict(horizon) gives (keys, vintage_time, time, step, y_hat).

The vintage is a series' last stamp. Everything is keyed by (keys, time); series are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import Operator, numbered
from tidemark.operators.intervals import Interval


@dataclass
class Forecaster(Operator):
    target: str = "y"
    interval: str = "1d"

    def fit(self, df: DataFrame) -> Forecaster:
        self.train = df
        self.ends = df.groupBy(*self.keys).agg(F.max(self.time).alias("vintage_time"), F.min(self.time).alias("_first"), F.count("*").cast("int").alias("_n"))
        self.learn(df)
        return self

    def learn(self, df: DataFrame) -> None:
        pass

    def future(self, horizon: int) -> DataFrame:
        """(keys, vintage_time, _first, _n, step, time) of the next stamps of every series."""
        steps = self.ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        return steps.withColumn(self.time, Interval.parse(self.interval).after(F.col("vintage_time"), F.col("step")))

    def predict(self, horizon: int) -> DataFrame:
        raise NotImplementedError

    def fitted(self) -> DataFrame:
        """(keys, time, y_hat) on the training rows, for models that have such values."""
        raise NotImplementedError

    def shaped(self, df: DataFrame, value: Column) -> DataFrame:
        return df.select(*self.keys, "vintage_time", self.time, "step", value.alias("y_hat"))


@dataclass
class SeasonalNaive(Forecaster):
    """Repeats the last `seasonality` observations."""

    seasonality: int = 1

    def predict(self, horizon: int) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(F.desc(self.time))
        last = self.train.select(*self.keys, F.col(self.target).alias("_y"), (F.row_number().over(w) - 1).alias("_back")).filter(F.col("_back") < self.seasonality)
        asked = self.future(horizon).withColumn("_back", F.lit(self.seasonality - 1) - F.pmod(F.col("step") - 1, F.lit(self.seasonality)))
        return self.shaped(asked.join(last, [*self.keys, "_back"], "left"), F.col("_y").cast("double"))


@dataclass
class MeanSeasonalNaive(Forecaster):
    """The mean of the last n_seasons observations of a step's phase."""

    seasonality: int = 1
    n_seasons: int = 2

    def predict(self, horizon: int) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(F.desc(self.time))
        s = self.seasonality
        last = self.train.select(*self.keys, F.col(self.target).alias("_y"), (F.row_number().over(w) - 1).alias("_b")).filter(F.col("_b") < s * self.n_seasons)
        mean = last.groupBy(*self.keys, (F.col("_b") % s).alias("_back")).agg(F.avg("_y").alias("_y"))
        asked = self.future(horizon).withColumn("_back", F.lit(s - 1) - F.pmod(F.col("step") - 1, F.lit(s)))
        return self.shaped(asked.join(mean, [*self.keys, "_back"], "left"), F.col("_y"))

    def rolled(self, df: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
        """Forecasts from every stride-th row of df as vintage, counted back from the end."""
        w, s = self.by_time(), self.seasonality
        past = F.array(*(F.lag(F.col(self.target).cast("double"), k).over(w) for k in range(s * self.n_seasons)))
        rows = numbered(df, self).withColumn("_past", past).withColumn("_last", F.max("_rn").over(self.whole()))
        rows = rows.filter((F.col("_last") - F.col("_rn")) % stride == 0).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        own = F.filter("_past", lambda x, i: (i % s == s - 1 - F.pmod(F.col("step") - 1, F.lit(s))) & x.isNotNull())
        mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(own) > 0, F.size(own))
        at = Interval.parse(self.interval).after(F.col(self.time), F.col("step"))
        return rows.select(*self.keys, F.col(self.time).alias("vintage_time"), at.alias(self.time), "step", mean.alias("y_hat"))


@dataclass
class PatternSeasonality(Forecaster):
    """The naive, average or median pattern by phase, over whole cycles counted back from the end. pooled: over all series."""

    seasonality: int = 7
    method: str = "average"
    pooled: bool = False

    def learn(self, df: DataFrame) -> None:
        w = Window.partitionBy(*self.keys).orderBy(F.desc(self.time))
        s = self.seasonality
        rows = df.join(self.ends, list(self.keys)).withColumn("_b", F.row_number().over(w) - 1)
        whole = rows.filter(F.col("_b") < F.col("_n") - F.col("_n") % s)
        if self.method == "naive":
            whole = whole.filter(F.col("_b") < s)
        own = F.median(self.target) if self.method == "median" else F.avg(self.target)
        self.by = [] if self.pooled else list(self.keys)
        self.pattern = whole.groupBy(*self.by, (F.col("_b") % s).cast("int").alias("_back")).agg(own.alias("_y"))

    def predict(self, horizon: int) -> DataFrame:
        asked = self.future(horizon).withColumn("_back", F.lit(self.seasonality - 1) - F.pmod(F.col("step") - 1, F.lit(self.seasonality)))
        return self.shaped(asked.join(self.pattern, [*self.by, "_back"], "left"), F.col("_y"))

    def fitted(self) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(F.desc(self.time))
        rows = self.train.withColumn("_back", ((F.row_number().over(w) - 1) % self.seasonality).cast("int"))
        return rows.join(self.pattern, [*self.by, "_back"], "left").select(*self.keys, self.time, F.col("_y").alias("y_hat"))

    def rolled(self, df: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
        """The pattern, as fitted, at the stamps after every stride-th row of df, counted back from the end."""
        i = Interval.parse(self.interval)
        rows = numbered(df, self).withColumn("_last", F.max("_rn").over(self.whole()))
        rows = rows.filter((F.col("_last") - F.col("_rn")) % stride == 0).select(*self.keys, F.col(self.time).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
        rows = rows.withColumn(self.time, i.after(F.col("_v"), F.col("step"))).join(self.ends, list(self.keys))
        beyond = i.between(F.col("vintage_time"), F.col(self.time))  # intervals after the end of the fitted rows
        rows = rows.withColumn("_back", (self.seasonality - 1 - F.pmod(beyond - 1, F.lit(self.seasonality))).cast("int"))
        return rows.join(self.pattern, [*self.by, "_back"], "left").select(*self.keys, F.col("_v").alias("vintage_time"), self.time, "step", F.col("_y").alias("y_hat"))


def least_squares(df: DataFrame, x: list[Column], y: list[Column], ridge: float = 0.0) -> np.ndarray:
    """Coefficients (an intercept and one for each x, by each y) of all rows without nulls, from one aggregate of products.

    What reaches the driver are the (p + 1) (p + q + 1) sums, whatever the rows.
    """
    columns = [F.lit(1.0), *(c.cast("double") for c in x)]
    names = [f"_x{i}" for i in range(len(columns))]
    rows = df.select(*(c.alias(n) for c, n in zip(columns, names)), *(c.cast("double").alias(f"_y{j}") for j, c in enumerate(y))).na.drop()
    p, q = len(columns), len(y)
    sums = rows.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(F.col(names[i]) * F.col(f"_y{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(q))).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    moment = np.array([[sums[f"m{i}_{j}"] or 0.0 for j in range(q)] for i in range(p)])
    unit = np.sqrt(np.maximum(np.diag(gram), 1e-300))  # columns of one size, for the sake of the solution's precision
    penalty = np.diag([0.0, *[ridge] * (p - 1)])
    return np.linalg.lstsq((gram + penalty) / unit[:, None] / unit[None, :], moment / unit[:, None], rcond=None)[0] / unit[:, None]


def _linear(coefficients: np.ndarray, x: list[Column]) -> Column:
    out = F.lit(float(coefficients[0]))
    for b, c in zip(coefficients[1:], x):
        out = out + F.lit(float(b)) * c
    return out


@dataclass
class PolynomialTrend(Forecaster):
    """Least squares (ridge on request) on powers of the time index. pooled: one curve for all series; else one line each (degree 1)."""

    degree: int = 1
    ridge: float = 0.0
    pooled: bool = False

    def powers(self, t: Column) -> list[Column]:
        return [F.pow(t.cast("double"), F.lit(float(d))) for d in range(1, self.degree + 1)]

    def index_at(self) -> Column:
        return Interval.parse(self.interval).between(F.col("_first"), F.col(self.time))

    def learn(self, df: DataFrame) -> None:
        self.rows = df.join(self.ends, list(self.keys)).withColumn("_t", self.index_at())
        if self.pooled:
            self.coefficients = least_squares(self.rows, self.powers(F.col("_t")), [F.col(self.target)], self.ridge)[:, 0]
        elif self.degree == 1:
            self.lines = self.rows.groupBy(*self.keys).agg(F.regr_slope(self.target, "_t").alias("_slope"), F.regr_intercept(self.target, "_t").alias("_start"))
        else:
            raise ValueError("a trend of a degree over 1 is pooled")

    def _valued(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        if self.pooled:
            return rows, _linear(self.coefficients, self.powers(F.col("_t")))
        return rows.join(self.lines, list(self.keys)), F.col("_start") + F.col("_slope") * F.col("_t")

    def predict(self, horizon: int) -> DataFrame:
        rows, value = self._valued(self.future(horizon).withColumn("_t", self.index_at()))
        return self.shaped(rows, value)

    def fitted(self) -> DataFrame:
        rows, value = self._valued(self.rows)
        return rows.select(*self.keys, self.time, value.alias("y_hat"))


@dataclass
class FourierSeasonality(Forecaster):
    """Least squares on sines and cosines of the time index, over all series."""

    seasonality: float = 7.0
    harmonics: tuple[int, ...] = (1,)

    def waves(self) -> list[Column]:
        t = Interval.parse(self.interval).between(F.col("_first"), F.col(self.time))
        return [f(F.lit(2.0 * k) * F.pi() * t / self.seasonality) for k in self.harmonics for f in (F.sin, F.cos)]

    def learn(self, df: DataFrame) -> None:
        self.rows = df.join(self.ends, list(self.keys))
        self.coefficients = least_squares(self.rows, self.waves(), [F.col(self.target)])[:, 0]

    def predict(self, horizon: int) -> DataFrame:
        return self.shaped(self.future(horizon), _linear(self.coefficients, self.waves()))

    def fitted(self) -> DataFrame:
        return self.rows.select(*self.keys, self.time, _linear(self.coefficients, self.waves()).alias("y_hat"))


@dataclass
class Reduction(Forecaster):
    """Forecasts as regressions on lags: "multi-output" and "direct" fit all steps on the lags at the vintage, "dir-rec" adds the
    predictions of earlier steps, "recursive" feeds the first step's prediction back.

    One model for all series, from one pass of sums per step; training_stride keeps every k-th row in the vintage's phase.
    """

    lags: tuple[int, ...] = (0, 1, 2)
    strategy: str = "multi-output"
    horizon: int = 3
    ridge: float = 0.0
    training_stride: int = 1

    def _lagged(self, df: DataFrame) -> DataFrame:
        w = self.by_time()
        y = F.col(self.target).cast("double")
        known = range(max(self.lags) + 1) if self.strategy == "recursive" else self.lags  # the recursion needs those between
        df = numbered(df, self).withColumns({f"_l{k}": F.lag(y, k).over(w) for k in known} | {f"_a{h}": F.lead(y, h).over(w) for h in range(1, self.horizon + 1)})
        return df.withColumn("_last", F.max("_rn").over(self.whole()))

    def learn(self, df: DataFrame) -> None:
        rows = self._lagged(df)
        rows = rows.filter((F.col("_last") - F.col("_rn")) % self.training_stride == 0)
        x = [F.col(f"_l{k}") for k in self.lags]
        if self.strategy in ("multi-output", "recursive"):
            steps = [1] if self.strategy == "recursive" else range(1, self.horizon + 1)
            b = least_squares(rows, x, [F.col(f"_a{h}") for h in steps], self.ridge)
            self.models = [b[:, i] for i in range(b.shape[1])]
        else:
            self.models = []
            for h in range(1, self.horizon + 1):
                self.models.append(least_squares(rows, x, [F.col(f"_a{h}")], self.ridge)[:, 0])
                if self.strategy == "dir-rec":
                    rows = rows.withColumn(f"_p{h}", _linear(self.models[-1], x))
                    x = [*x, F.col(f"_p{h}")]

    def predict(self, horizon: int) -> DataFrame:
        return self._stepped(self._lagged(self.train).filter("_rn = _last"), horizon)

    def rolled(self, df: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
        """Forecasts from every stride-th row of df (counted back from the end) as vintage, by the fitted models."""
        return self._stepped(self._lagged(df).filter((F.col("_last") - F.col("_rn")) % stride == 0), horizon)

    def _stepped(self, rows: DataFrame, horizon: int) -> DataFrame:
        x, made = [F.col(f"_l{k}") for k in self.lags], []
        if self.strategy == "recursive":
            at = {-k: F.col(f"_l{k}") for k in range(max(self.lags) + 1)}
            for h in range(1, horizon + 1):
                rows = rows.withColumn(f"_p{h}", _linear(self.models[0], [at[h - 1 - k] for k in self.lags]))
                at[h] = F.col(f"_p{h}")
                made.append(at[h])
        else:
            for h, b in enumerate(self.models[:horizon], 1):
                rows = rows.withColumn(f"_p{h}", _linear(b, x))
                made.append(F.col(f"_p{h}"))
                if self.strategy == "dir-rec":
                    x = [*x, F.col(f"_p{h}")]
        steps = rows.select(*self.keys, F.col(self.time).alias("vintage_time"), F.explode(F.array(*(F.struct(F.lit(h).alias("step"), p.alias("y_hat")) for h, p in enumerate(made, 1)))).alias("_s"))
        return steps.select(*self.keys, "vintage_time", Interval.parse(self.interval).after(F.col("vintage_time"), F.col("_s.step")).alias(self.time), F.col("_s.step").alias("step"), F.col("_s.y_hat").alias("y_hat"))


def rolling_naive(df: DataFrame, horizon: int, seasonality: int = 1, stride: int = 1, keys: tuple[str, ...] = ("group",), time: str = "time", target: str = "y") -> DataFrame:
    """Seasonal-naive forecasts from every (stride-th) row as vintage, with their truth: (keys, vintage_time, time, step, y_hat, y)."""
    w = Window.partitionBy(*keys).orderBy(time)
    steps = [F.struct(F.lit(h).alias("step"), F.lead(time, h).over(w).alias("time"), F.lag(target, seasonality - 1 - (h - 1) % seasonality).over(w).cast("double").alias("y_hat"), F.lead(target, h).over(w).cast("double").alias("y")) for h in range(1, horizon + 1)]
    rows = df.withColumn("_rn", F.row_number().over(w)).withColumn("_s", F.array(*steps)).filter(F.col("_rn") % stride == 0)
    return rows.select(*keys, F.col(time).alias("vintage_time"), F.explode("_s").alias("_s")).select(*keys, "vintage_time", "_s.*").filter("y is not null and y_hat is not null")


@dataclass
class Decomposition(Forecaster):
    """Components fitted one after the other on the residuals of those before; their forecasts add up."""

    parts: tuple[Forecaster, ...] = ()

    def learn(self, df: DataFrame) -> None:
        self.models, rows = [], df.select(*self.index(), F.col(self.target).cast("double").alias("y"))
        for i, part in enumerate(self.parts):
            model = replace(part, keys=self.keys, time=self.time, interval=self.interval, target="y").fit(rows)
            self.models.append(model)
            if i < len(self.parts) - 1:
                rows = rows.join(model.fitted(), self.index()).select(*self.index(), (F.col("y") - F.col("y_hat")).alias("y"))

    def predict(self, horizon: int) -> DataFrame:
        out = self.models[0].predict(horizon)
        for m in self.models[1:]:
            out = out.union(m.predict(horizon))
        return out.groupBy(*self.keys, "vintage_time", self.time, "step").agg(F.sum("y_hat").alias("y_hat"))


@dataclass
class Ensemble(Forecaster):
    """The (weighted) mean, or the median, of members' forecasts."""

    members: tuple[Forecaster, ...] = ()
    method: str = "mean"
    weights: tuple[float, ...] | None = None

    def learn(self, df: DataFrame) -> None:
        self.models = [replace(m, keys=self.keys, time=self.time, interval=self.interval, target=self.target).fit(df) for m in self.members]

    def predict(self, horizon: int) -> DataFrame:
        weights, out = self.weights or (1.0,) * len(self.models), None
        for m, w in zip(self.models, weights):
            one = m.predict(horizon).withColumn("_w", F.lit(float(w)))
            out = one if out is None else out.union(one)
        value = F.median("y_hat") if self.method == "median" else F.sum(F.col("y_hat") * F.col("_w")) / F.sum("_w")
        return out.groupBy(*self.keys, "vintage_time", self.time, "step").agg(value.alias("y_hat"))


def interval_ensemble(members: DataFrame, strategy: str = "envelope", by: tuple[str, ...] = ("group", "time", "coverage_rate")) -> DataFrame:
    """lower and upper of all members' intervals: their envelope, means or medians."""
    low, high = {"envelope": (F.min("lower"), F.max("upper")), "mean": (F.avg("lower"), F.avg("upper")), "median": (F.median("lower"), F.median("upper"))}[strategy]
    return members.groupBy(*by).agg(low.alias("lower"), high.alias("upper"))


def majority_vote(votes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, label): the most frequent label, ties to the smallest."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "label")
    return votes.groupBy(*by, "label").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "label")


def soft_vote(probabilities: DataFrame, by: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """(by, label, p): the (weighted) mean of members' probabilities."""
    w = F.col(weight) if weight else F.lit(1.0)
    return probabilities.groupBy(*by, "label").agg((F.sum(F.col("p") * w) / F.sum(w)).alias("p"))


@dataclass
class SplitConformal(Forecaster):
    """Intervals around rolling seasonal-naive forecasts: scores of the last `calibration_size` rows, per series and step."""

    seasonality: int = 1
    calibration_size: int = 100
    kind: str = "absolute"
    rates: tuple[float, ...] = (0.8,)
    options: dict = field(default_factory=dict)

    def predict_interval(self, horizon: int) -> DataFrame:
        from tidemark.metrics.conformity import conformity, difference_scale, intervals

        rolled = rolling_naive(self.train, horizon, self.seasonality, keys=self.keys, time=self.time, target=self.target)
        w = Window.partitionBy(*self.keys).orderBy(F.desc("time"))
        held = self.train.select(*self.keys, F.col(self.time).alias("time"), F.row_number().over(w).alias("_b")).filter(F.col("_b") <= self.calibration_size)
        first = held.groupBy(*self.keys).agg(F.min("time").alias("_from"))
        rolled = rolled.join(first, list(self.keys)).filter(F.col("time") >= F.col("_from")).drop("_from")
        future = SeasonalNaive(keys=self.keys, time=self.time, target=self.target, interval=self.interval, seasonality=self.seasonality).fit(self.train).predict(horizon)
        if "normalized" in self.kind:
            head = self.train.join(first, list(self.keys)).filter(F.col(self.time) < F.col("_from"))
            scale = difference_scale(head.withColumn("y", F.col(self.target)), self.keys, self.time)
            rolled, future = rolled.join(scale, list(self.keys)), future.join(scale, list(self.keys))
        scores = rolled.withColumn("score", conformity(self.kind))
        return intervals(scores, future, self.kind, self.rates, (*self.keys, "step")).drop("scale")
