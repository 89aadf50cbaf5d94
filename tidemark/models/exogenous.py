"""Reduction with exogenous columns and any estimator, conformal intervals around any forecaster, similarity weights.

Three kinds of exogenous columns: `actual` ones are known up to the vintage and enter by lags; `future` ones are known in
advance and enter by their value at the target stamp; `forecasts` are a table of vintages (keys, vintage_time, time, value)
and enter by the newest vintage that is not after the row. All are joined by keys and stamps; as-of vintages by one window.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.metrics.conformity import conformity, difference_scale, intervals, unit, weighted_quantile
from tidemark.models.forecasters import Forecaster, _linear, least_squares
from tidemark.operators.base import numbered
from tidemark.operators.intervals import Interval


class Estimator:
    """What fits one column on others. fitted(rows, x, y) gives a model whose apply(rows, x, out) adds a prediction column."""

    def fitted(self, rows: DataFrame, x: list[str], y: str) -> Estimator:
        raise NotImplementedError

    def apply(self, rows: DataFrame, x: list[str], out: str) -> DataFrame:
        raise NotImplementedError


@dataclass
class Linear(Estimator):
    """Least squares with an intercept, ridge on request: one aggregate to fit, a column expression to predict."""

    ridge: float = 0.0
    coefficients: np.ndarray | None = None

    def fitted(self, rows: DataFrame, x: list[str], y: str) -> Linear:
        return replace(self, coefficients=least_squares(rows, [F.col(c) for c in x], [F.col(y)], self.ridge)[:, 0])

    def apply(self, rows: DataFrame, x: list[str], out: str) -> DataFrame:
        return rows.withColumn(out, _linear(self.coefficients, [F.col(c) for c in x]))


@dataclass
class Library(Estimator):
    """Any regressor of pyspark.ml (trees, boosting, generalised linear models). Rows with a null feature get no prediction."""

    regressor: object = None
    model: object = None

    def _vectors(self, rows: DataFrame, x: list[str]) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        filled = rows.withColumns({f"_f_{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(x)})
        return VectorAssembler(inputCols=[f"_f_{i}" for i in range(len(x))], outputCol="_features").transform(filled).drop(*(f"_f_{i}" for i in range(len(x))))

    def fitted(self, rows: DataFrame, x: list[str], y: str) -> Library:
        whole = rows.select(*x, F.col(y).cast("double").alias("_label")).na.drop()
        own = self.regressor.copy({self.regressor.featuresCol: "_features", self.regressor.labelCol: "_label", self.regressor.predictionCol: "_prediction"})
        return replace(self, model=own.fit(self._vectors(whole, x)))

    def apply(self, rows: DataFrame, x: list[str], out: str) -> DataFrame:
        known = None
        for c in x:
            known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
        made = self.model.transform(self._vectors(rows, x))
        return made.withColumn(out, F.when(known, F.col("_prediction")) if known is not None else F.col("_prediction")).drop("_features", "_prediction")


def newest_vintage(rows: DataFrame, forecasts: DataFrame, value: str, steps: int, interval: str, keys: tuple[str, ...], time: str) -> DataFrame:
    """rows with {value}_step_{h}: the value for h intervals on, by the newest vintage at or before the row that has that stamp.

    One shuffle: the vintages' values and what rows ask for are one table, ordered by vintage within (keys, target stamp).
    """
    i = Interval.parse(interval)
    asked = rows.select(*keys, F.col(time).alias("_origin"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_h"))
    asked = asked.select(*keys, i.after(F.col("_origin"), F.col("_h")).alias("_at"), F.col("_origin").alias("_v"), F.lit(1).alias("_ask"), "_h", F.lit(None).cast("double").alias("_x"))
    given = forecasts.select(*keys, F.col(time).alias("_at"), F.col("vintage_time").alias("_v"), F.lit(0).alias("_ask"), F.lit(None).cast("int").alias("_h"), F.col(value).cast("double").alias("_x"))
    w = Window.partitionBy(*keys, "_at").orderBy("_v", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = given.union(asked).withColumn("_x", F.last("_x", ignorenulls=True).over(w)).filter("_ask = 1")
    wide = both.groupBy(*keys, F.col("_v").alias(time)).agg(*(F.max(F.when(F.col("_h") == h, F.col("_x"))).alias(f"{value}_step_{h}") for h in range(1, steps + 1)))
    return rows.join(wide, [*keys, time], "left")


@dataclass
class ExogenousReduction(Forecaster):
    """Regression of future values on lags of the target and on exogenous columns.

    strategy: "multi-output" (each step on all that is known at the vintage, the steps of future columns included), "direct"
    (each step on the columns of its own step), "dir-rec" (and on the predictions of the steps before), "recursive" (one model
    for one step; predictions take the target's place, and actual columns stay at their last value). One model for all series.
    """

    lags: tuple[int, ...] = (0,)
    actual: dict[str, tuple[int, ...]] = field(default_factory=dict)
    future: DataFrame | None = None
    forecasts: DataFrame | None = None
    strategy: str = "direct"
    horizon: int = 2
    estimator: Estimator = field(default_factory=Linear)

    def _names(self, table: DataFrame | None) -> list[str]:
        return [] if table is None else [c for c in table.columns if c not in (*self.keys, self.time, "vintage_time")]

    def rows(self, df: DataFrame) -> DataFrame:
        """One row per origin: lags, future columns and forecasts by step, and the truth by step (null beyond the end)."""
        w, y = self.by_time(), F.col(self.target).cast("double")
        i = Interval.parse(self.interval)
        made = {f"y_lag_{k}": F.lag(y, k).over(w) for k in self.lags} | {f"{c}_lag_{k}": F.lag(F.col(c).cast("double"), k).over(w) for c, ks in self.actual.items() for k in ks} | {f"_a{h}": F.lead(y, h).over(w) for h in range(1, self.horizon + 1)}
        out = numbered(df, self).withColumns(made).withColumn("_last", F.max("_rn").over(self.whole())).select(*self.index(), "_rn", "_last", *made)
        if self.future is not None:
            names = self._names(self.future)
            steps = out.select(*self.index(), F.explode(F.sequence(F.lit(1), F.lit(self.horizon))).alias("_h")).withColumn("_at", i.after(F.col(self.time), F.col("_h")))
            joined = steps.join(self.future.withColumnRenamed(self.time, "_at"), [*self.keys, "_at"], "left")
            wide = joined.groupBy(*self.index()).agg(*(F.max(F.when(F.col("_h") == h, F.col(c).cast("double"))).alias(f"{c}_step_{h}") for c in names for h in range(1, self.horizon + 1)))
            out = out.join(wide, self.index(), "left")
        for c in self._names(self.forecasts):
            out = newest_vintage(out, self.forecasts, c, self.horizon, self.interval, self.keys, self.time)
        return out

    def _known(self) -> list[str]:
        return [f"y_lag_{k}" for k in self.lags] + [f"{c}_lag_{k}" for c, ks in self.actual.items() for k in ks]

    def _at_step(self, h: int) -> list[str]:
        return [f"{c}_step_{h}" for c in self._names(self.future) + self._names(self.forecasts)]

    def learn(self, df: DataFrame) -> None:
        rows, self.models, known = self.rows(df), [], self._known()
        if self.strategy == "recursive":
            self.models = [self.estimator.fitted(rows, known + self._at_step(1), "_a1")]
            return
        every = [c for h in range(1, self.horizon + 1) for c in self._at_step(h)]
        for h in range(1, self.horizon + 1):
            x = known + (every if self.strategy == "multi-output" else self._at_step(h)) + ([f"_p{j}" for j in range(1, h)] if self.strategy == "dir-rec" else [])
            self.models.append(self.estimator.fitted(rows, x, f"_a{h}"))
            if self.strategy == "dir-rec":
                rows = self.models[-1].apply(rows, x, f"_p{h}")

    def _stepped(self, rows: DataFrame, horizon: int) -> DataFrame:
        known = self._known()
        if self.strategy == "recursive":
            model = self.models[0]
            for h in range(1, horizon + 1):
                moved = {}
                for k in self.lags:  # the lag that step h sees: a prediction, or what was known
                    moved[f"_x_y_{k}"] = F.col(f"_p{h - 1 - k}") if h - 1 - k >= 1 else F.col(f"y_lag_{k - h + 1}") if f"y_lag_{k - h + 1}" in rows.columns else F.lit(None).cast("double")
                now = rows.withColumns(moved)
                x = [f"_x_y_{k}" for k in self.lags] + [f"{c}_lag_{k}" for c, ks in self.actual.items() for k in ks] + self._at_step(h)
                rows = model.apply(now, x, f"_p{h}").drop(*moved)
            return rows
        every = [c for h in range(1, self.horizon + 1) for c in self._at_step(h)]
        for h in range(1, horizon + 1):
            x = known + (every if self.strategy == "multi-output" else self._at_step(h)) + ([f"_p{j}" for j in range(1, h)] if self.strategy == "dir-rec" else [])
            rows = self.models[h - 1].apply(rows, x, f"_p{h}")
        return rows

    def _long(self, rows: DataFrame, horizon: int) -> DataFrame:
        made = F.explode(F.array(*(F.struct(F.lit(h).alias("step"), F.col(f"_p{h}").alias("y_hat")) for h in range(1, horizon + 1))))
        out = rows.select(*self.keys, F.col(self.time).alias("vintage_time"), made.alias("_s"))
        return out.select(*self.keys, "vintage_time", Interval.parse(self.interval).after(F.col("vintage_time"), F.col("_s.step")).alias(self.time), "_s.step", "_s.y_hat")

    def predict(self, horizon: int) -> DataFrame:
        return self._long(self._stepped(self._whole_lags(self.train).filter("_rn = _last"), horizon), horizon)

    def rolled(self, df: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
        """Forecasts from every stride-th row of df (counted back from the end) as vintage, by the fitted models."""
        rows = self._whole_lags(df).filter((F.col("_last") - F.col("_rn")) % stride == 0)
        return self._long(self._stepped(rows, horizon), horizon)

    def _whole_lags(self, df: DataFrame) -> DataFrame:
        """rows(), with all lags up to the largest where the recursion needs those between."""
        if self.strategy != "recursive" or not self.lags:
            return self.rows(df)
        wider = copy.copy(self)
        wider.lags = tuple(range(max(self.lags) + 1))
        return wider.rows(df)


def rolled(model: Forecaster, df: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
    """(keys, vintage_time, time, step, y_hat) from every stride-th row of df as vintage, counted back from the end, by a fitted
    model: its own rolled() where it has one, or, for models of time alone, what they say of the target stamps."""
    if hasattr(model, "rolled"):
        return model.rolled(df, horizon, stride)
    from tidemark.models.forecasters import FourierSeasonality, PolynomialTrend, SeasonalNaive

    w = model.by_time()
    rows = numbered(df, model).withColumn("_last", F.max("_rn").over(model.whole()))
    back = (F.col("_last") - F.col("_rn")) % stride == 0
    at = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    i = Interval.parse(model.interval)
    if isinstance(model, SeasonalNaive):
        s = model.seasonality
        past = F.array(*(F.lag(F.col(model.target).cast("double"), k).over(w) for k in range(s)))
        out = rows.withColumn("_past", past).filter(back).withColumn("step", at)
        out = out.withColumn("y_hat", F.element_at("_past", (s - F.pmod(F.col("step") - 1, F.lit(s))).cast("int")))
        return out.select(*model.keys, F.col(model.time).alias("vintage_time"), i.after(F.col(model.time), F.col("step")).alias(model.time), "step", "y_hat")
    if isinstance(model, (PolynomialTrend, FourierSeasonality)):
        out = rows.filter(back).select(*model.keys, F.col(model.time).alias("vintage_time"), at.alias("step"))
        out = out.withColumn(model.time, i.after(F.col("vintage_time"), F.col("step"))).join(model.ends.select(*model.keys, "_first"), list(model.keys))
        if isinstance(model, FourierSeasonality):
            return out.select(*model.keys, "vintage_time", model.time, "step", _linear(model.coefficients, model.waves()).alias("y_hat"))
        valued, value = model._valued(out.withColumn("_t", model.index_at()))
        return valued.select(*model.keys, "vintage_time", model.time, "step", value.alias("y_hat"))
    raise TypeError(f"{type(model).__name__} does not forecast from given rows")


@dataclass
class Conformal(Forecaster):
    """Split-conformal intervals around any forecaster that can be rolled.

    The last calibration_size rows of a series are held out: the model is fitted on the rest, its forecasts from the rows
    before each held-out row are scored, and the order statistics of the scores are the intervals' reach, by series and step
    or, pooled, by step for all series. The forecast itself starts from the last row, by the same model.
    """

    model: Forecaster = field(default_factory=Forecaster)
    calibration_size: int = 24
    kind: str = "absolute"
    rates: tuple[float, ...] = (0.8,)
    pooled: bool = False
    horizon: int = 2

    def learn(self, df: DataFrame) -> None:
        w = Window.partitionBy(*self.keys).orderBy(F.desc(self.time))
        rows = df.withColumn("_b", F.row_number().over(w))
        self.held = rows.filter(F.col("_b") <= self.calibration_size).select(*self.keys, self.time, F.col(self.target).cast("double").alias("y"))
        head = rows.filter(F.col("_b") > self.calibration_size).drop("_b")
        self.fitted_model = replace(self.model, keys=self.keys, time=self.time, interval=self.interval, target=self.target).fit(head)
        self.forecasts = rolled(self.fitted_model, df, self.horizon)
        self.scale = difference_scale(head.withColumn("y", F.col(self.target)), self.keys, self.time) if "normalized" in self.kind else None

    def scores(self) -> DataFrame:
        """(keys, vintage_time, time, step, y_hat, y, score) on the held-out rows."""
        own = self.forecasts.filter("y_hat is not null").join(self.held, [*self.keys, self.time])
        own = own.join(self.scale, list(self.keys)) if self.scale is not None else own
        return own.withColumn("score", conformity(self.kind))

    def predict(self, horizon: int) -> DataFrame:
        return self.forecasts.filter(F.col("step") <= horizon).join(self.ends.select(*self.keys, "vintage_time"), [*self.keys, "vintage_time"], "left_semi")

    def predict_interval(self, horizon: int) -> DataFrame:
        future = self.predict(horizon)
        future = future.join(self.scale, list(self.keys)) if self.scale is not None else future
        return intervals(self.scores(), future, self.kind, self.rates, ("step",) if self.pooled else (*self.keys, "step")).drop("scale")

    def predict_weighted(self, horizon: int, weights: DataFrame) -> DataFrame:
        """The same with weights (keys, time, weight) of the held-out stamps for a symmetric kind; they are to sum to less than
        one, as those of similarities do."""
        if not self.kind.startswith("absolute"):
            raise ValueError("weights are for scores without a sign")
        future = self.predict(horizon)
        future = future.join(self.scale, list(self.keys)) if self.scale is not None else future
        weighted = self.scores().join(weights.select(*self.keys, self.time, "weight"), [*self.keys, self.time])
        out = None
        for rate in self.rates:
            reach = weighted_quantile(weighted, 1 - rate, (*self.keys, "step")).withColumn("coverage_rate", F.lit(rate))
            out = reach if out is None else out.union(reach)
        rows = future.join(out, [*self.keys, "step"])
        reach = F.col("quantile") * unit(self.kind)
        return rows.withColumns({"lower": F.col("y_hat") - reach, "upper": F.col("y_hat") + reach}).drop("quantile", "scale")

    def predict_adaptive(self, target: float = 0.2, step_size: float = 0.05) -> DataFrame:
        """(keys, vintage_time, time, step, y_hat, y, alpha, lower, upper, error): the held-out rows one after the other. Each
        one's interval comes from the scores before it at the level that the errors so far have led to, per series and step.

        A state machine over one series' held-out rows, of which there are calibration_size: one Arrow batch each.
        """
        import pandas as pd

        scored = self.scores().select(*self.keys, "vintage_time", self.time, "step", "y_hat", "y", "score")
        types = {n: t for n, t in scored.dtypes}
        schema = ", ".join(f"{n} {types[n]}" for n in [*self.keys, "vintage_time", self.time, "step", "y_hat", "y"]) + ", alpha double, lower double, upper double, error double"
        time, symmetric = self.time, self.kind == "absolute"
        if not symmetric:
            raise ValueError("levels are adapted for absolute residuals")

        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(time).reset_index(drop=True)
            alpha, level, low, high, error = target, [], [], [], []
            for i, (f, y) in enumerate(zip(own["y_hat"], own["y"])):
                past = np.sort(own["score"].to_numpy()[:i])
                k = int(np.ceil((i + 1) * (1 - alpha) - 1e-9))
                reach = np.inf if k > i else past[max(k, 1) - 1] if i else np.inf
                miss = float(abs(y - f) > reach)
                level.append(alpha), low.append(f - reach), high.append(f + reach), error.append(miss)
                alpha = min(1.0, max(0.0, alpha + step_size * (target - miss)))
            return own.drop(columns="score").assign(alpha=level, lower=low, upper=high, error=error)

        return scored.groupBy(*self.keys, "step").applyInPandas(run, schema)


class Similarity:
    """distances(calibration, queries) gives (keys, query_time, time, distance); weights() turns these into kernel weights."""

    bandwidth: float = 1.0

    def distances(self, calibration: DataFrame, queries: DataFrame, keys: tuple[str, ...], time: str) -> DataFrame:
        raise NotImplementedError

    def weights(self, calibration: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
        """(keys, query_time, time, weight): exp(-distance / bandwidth) with the nearest row as one, divided by their sum and one,
        which is the mass held back for the query itself."""
        w = Window.partitionBy(*keys, "query_time")
        d = self.distances(calibration, queries, keys, time).withColumn("_d", F.col("distance") / self.bandwidth)
        d = d.withColumn("_k", F.exp(F.min("_d").over(w) - F.col("_d")))
        return d.select(*keys, "query_time", time, (F.col("_k") / (F.sum("_k").over(w) + 1)).alias("weight"))


def _met(calibration: DataFrame, queries: DataFrame, features: list[str], keys: tuple[str, ...], time: str) -> DataFrame:
    """Each query with the calibration rows of its series, whose number the caller bounds; {feature}_q are the query's."""
    a = calibration.select(*keys, time, *features)
    b = queries.select(*keys, F.col(time).alias("query_time"), *(F.col(c).alias(f"{c}_q") for c in features))
    return a.join(b, list(keys))


def _euclidean(pairs: DataFrame, features: list[str], keys: tuple[str, ...], time: str) -> DataFrame:
    square = F.lit(0.0)
    for c in features:
        square = square + (F.col(c) - F.col(f"{c}_q")) * (F.col(c) - F.col(f"{c}_q"))
    return pairs.select(*keys, "query_time", time, F.sqrt(square).alias("distance"))


@dataclass
class DistanceSimilarity(Similarity):
    """Euclidean distances of features scaled by their deviation over the calibration rows."""

    features: tuple[str, ...] = ()
    bandwidth: float = 1.0

    def distances(self, calibration, queries, keys=("group",), time="time"):
        scale = calibration.groupBy(*keys).agg(*(F.greatest(F.stddev_pop(c), F.lit(1e-12)).alias(f"_s_{c}") for c in self.features))
        scaled = lambda df: df.join(scale, list(keys)).withColumns({c: F.col(c) / F.col(f"_s_{c}") for c in self.features})
        return _euclidean(_met(scaled(calibration), scaled(queries), list(self.features), keys, time), list(self.features), keys, time)


@dataclass
class SeasonalSimilarity(Similarity):
    """Distances of phases: sines and cosines of the place in the season, for some harmonics. place: the row's number in its
    series' grid, a column."""

    seasonality: float = 12.0
    harmonics: tuple[int, ...] = (1,)
    bandwidth: float = 0.5
    place: str = "place"

    def distances(self, calibration, queries, keys=("group",), time="time"):
        angle = lambda k: F.lit(2.0 * k) * F.pi() * F.col(self.place) / F.lit(float(self.seasonality))
        made = {f"_{n}{k}": f(angle(k)) for k in self.harmonics for n, f in (("sin", F.sin), ("cos", F.cos))}
        return _euclidean(_met(calibration.withColumns(made), queries.withColumns(made), list(made), keys, time), list(made), keys, time)


@dataclass
class CompositeSimilarity(Similarity):
    """Weights of several similarities: their (weighted) mean, or their product, for which each one's held-back mass is undone
    first and held back again at the end."""

    similarities: tuple[Similarity, ...] = ()
    combination: str = "multiply"
    shares: tuple[float, ...] | None = None

    def weights(self, calibration, queries, keys=("group",), time="time"):
        shares = self.shares or (1.0,) * len(self.similarities)
        by, out = [*keys, "query_time", time], None
        w = Window.partitionBy(*keys, "query_time")
        for i, s in enumerate(self.similarities):
            one = s.weights(calibration, queries, keys, time).withColumnRenamed("weight", f"_w{i}")
            out = one if out is None else out.join(one, by)
        if self.combination == "mean":
            value = sum((F.col(f"_w{i}") * float(s) for i, s in enumerate(shares)), F.lit(0.0)) / float(sum(shares))
            return out.select(*by, value.alias("weight"))
        product = F.lit(1.0)
        for i, s in enumerate(shares):
            total = F.sum(f"_w{i}").over(w)
            product = product * F.pow(F.col(f"_w{i}") / (1 - total), F.lit(float(s)))
        out = out.withColumn("_p", product)
        return out.select(*by, (F.col("_p") / (F.sum("_p").over(w) + 1)).alias("weight"))


@dataclass
class LocalPanel(Forecaster):
    """A model of its own for each series, where the model otherwise pools them: one fit a series, driven from here. For models
    that already fit by key (naive, patterns, lines), which need no loop, `model` is fitted once for all of them."""

    model: Forecaster = field(default_factory=Forecaster)
    most_series: int = 1000

    def learn(self, df: DataFrame) -> None:
        own = replace(self.model, keys=self.keys, time=self.time, interval=self.interval, target=self.target)
        if not (isinstance(own, (ExogenousReduction,)) or getattr(own, "pooled", False) or type(own).__name__ in ("Reduction", "FourierSeasonality")):
            self.models = [own.fit(df)]
            return
        names = df.select(*self.keys).distinct().limit(self.most_series + 1).collect()
        if len(names) > self.most_series:
            raise ValueError(f"more than {self.most_series} series; raise most_series, or fit one model for all")
        self.models = []
        for n in names:
            hit = F.lit(True)
            for k in self.keys:
                hit = hit & F.col(k).eqNullSafe(F.lit(n[k]))
            self.models.append(replace(own).fit(df.filter(hit)))

    def predict(self, horizon: int) -> DataFrame:
        out = self.models[0].predict(horizon)
        for m in self.models[1:]:
            out = out.union(m.predict(horizon))
        return out


@dataclass
class Residual(Forecaster):
    """A base model and a second one on what it leaves: both forecasts are added."""

    base: Forecaster = field(default_factory=Forecaster)
    rest: Forecaster = field(default_factory=Forecaster)

    def learn(self, df: DataFrame) -> None:
        own = dict(keys=self.keys, time=self.time, interval=self.interval)
        self.first = replace(self.base, target=self.target, **own).fit(df)
        left = df.join(self.first.fitted(), self.index()).select(*self.index(), (F.col(self.target) - F.col("y_hat")).alias("y"))
        self.second = replace(self.rest, target="y", **own).fit(left)

    def predict(self, horizon: int) -> DataFrame:
        on = [*self.keys, "vintage_time", self.time, "step"]
        a, b = self.first.predict(horizon), self.second.predict(horizon).withColumnRenamed("y_hat", "_r")
        return a.join(b, on).select(*on, (F.col("y_hat") + F.col("_r")).alias("y_hat"))


def class_columns(column: Column, labels: list[str], prefix: str) -> dict[str, Column]:
    """One 0/1 column for each label."""
    return {f"{prefix}_{i}": (column == label).cast("double") for i, label in enumerate(labels)}
