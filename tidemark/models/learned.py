"""Learned interval and class-probability forecasters, forecast features, and similarity weights."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.models.forecasters import Forecaster, Reduction, _linear
from tidemark.operators.base import numbered
from tidemark.operators.intervals import Interval


def quantile_regression(df: DataFrame, x: list[Column], y: Column, tau: float, rounds: int = 12) -> np.ndarray:
    """Coefficients for the tau quantile, by reweighted least squares: each round is one aggregate of p * p sums."""
    p = len(x) + 1
    rows = df.select(F.lit(1.0).alias("_x0"), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(x, 1)), y.cast("double").alias("_y")).na.drop()
    b, scale = None, 1.0
    for _ in range(rounds):
        residual = F.lit(0.0) if b is None else F.col("_y") - _linear(b, [F.col(f"_x{i}") for i in range(1, p)])
        w = F.lit(1.0) if b is None else F.when(residual >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(residual), F.lit(1e-6 * scale))
        s = rows.withColumn("_w", w).agg(F.stddev_pop("_y").alias("sd"), *(F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(F.col("_w") * F.col(f"_x{i}") * F.col("_y")).alias(f"m{i}") for i in range(p))).first()
        scale = s["sd"] or 1.0
        gram = np.array([[s[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        b = np.linalg.lstsq(gram, np.array([s[f"m{i}"] for i in range(p)]), rcond=None)[0]
    return b


@dataclass
class IntervalReduction(Reduction):
    """(keys, vintage_time, time, step, coverage_rate, lower, upper): quantile regressions on lags for each step and bound."""

    rates: tuple[float, ...] = (0.8,)

    def learn(self, df: DataFrame) -> None:
        rows, x = self._lagged(df), [F.col(f"_l{k}") for k in self.lags]
        self.bounds = {(h, rate): tuple(quantile_regression(rows, x, F.col(f"_a{h}"), t) for t in ((1 - rate) / 2, (1 + rate) / 2)) for h in range(1, self.horizon + 1) for rate in self.rates}

    def predict_interval(self, horizon: int) -> DataFrame:
        last = self._lagged(self.train).filter("_rn = _last").join(self.ends, list(self.keys))
        x = [F.col(f"_l{k}") for k in self.lags]
        made = [F.struct(F.lit(h).alias("step"), F.lit(rate).alias("coverage_rate"), F.least(_linear(a, x), _linear(b, x)).alias("lower"), F.greatest(_linear(a, x), _linear(b, x)).alias("upper")) for (h, rate), (a, b) in self.bounds.items() if h <= horizon]
        rows = last.withColumn("_s", F.explode(F.array(*made)))
        return rows.select(*self.keys, "vintage_time", Interval.parse(self.interval).after(F.col("vintage_time"), F.col("_s.step")).alias(self.time), "_s.*")


@dataclass
class ClassProbaReduction(Forecaster):
    """(keys, vintage_time, time, step, label, p): a multinomial logistic regression for each step on the last labels and covariates."""

    lags: tuple[int, ...] = (0, 1)
    features: tuple[str, ...] = ()
    horizon: int = 2
    regularisation: float = 1e-3

    def _table(self, df: DataFrame) -> DataFrame:
        w = self.by_time()
        df = numbered(df, self).withColumns({f"_i_{k}_{j}": (F.lag(self.target, k).over(w) == name).cast("double") for k in self.lags for j, name in enumerate(self.labels)})
        return df.withColumns({f"_a{h}": F.lead(self.target, h).over(w) for h in range(1, self.horizon + 1)} | {"_last": F.max("_rn").over(self.whole())})

    def learn(self, df: DataFrame) -> None:
        self.labels = [r[0] for r in df.select(self.target).distinct().orderBy(self.target).collect()]
        columns = [f"_i_{k}_{j}" for k in self.lags for j in range(len(self.labels))] + list(self.features)
        self.assembler = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip")
        rows = self.assembler.transform(self._table(df))
        self.models = []
        for h in range(1, self.horizon + 1):
            own = rows.filter(F.col(f"_a{h}").isNotNull())
            indexer = StringIndexer(inputCol=f"_a{h}", outputCol="_label", stringOrderType="alphabetAsc").fit(own)
            self.models.append((indexer.labels, LogisticRegression(featuresCol="_v", labelCol="_label", regParam=self.regularisation, probabilityCol="_p").fit(indexer.transform(own))))

    def predict_proba(self, horizon: int) -> DataFrame:
        last = self.assembler.transform(self._table(self.train).filter("_rn = _last")).join(self.ends, list(self.keys))
        out = None
        for h, (labels, model) in enumerate(self.models[:horizon], 1):
            p = vector_to_array("_p")
            rows = model.transform(last).withColumn("_s", F.explode(F.array(*(F.struct(F.lit(name).alias("label"), p[i].alias("p")) for i, name in enumerate(labels)))))
            rows = rows.select(*self.keys, "vintage_time", Interval.parse(self.interval).after(F.col("vintage_time"), F.lit(h)).alias(self.time), F.lit(h).alias("step"), "_s.*")
            out = rows if out is None else out.union(rows)
        return out


@dataclass
class ForecastedFeature(Forecaster):
    """A regression of the target on covariates of the same stamp; the covariates' own forecasts stand in beyond the end."""

    features: tuple[str, ...] = ()
    feature_model: Forecaster = field(default_factory=Forecaster)

    def learn(self, df: DataFrame) -> None:
        from tidemark.models.forecasters import least_squares

        self.coefficients = least_squares(df, [F.col(c) for c in self.features], [F.col(self.target)])[:, 0]
        self.models = {c: replace(self.feature_model, keys=self.keys, time=self.time, interval=self.interval, target=c).fit(df) for c in self.features}

    def predict(self, horizon: int) -> DataFrame:
        on, rows = [*self.keys, "vintage_time", self.time, "step"], None
        for c, m in self.models.items():
            one = m.predict(horizon).withColumnRenamed("y_hat", c)
            rows = one if rows is None else rows.join(one, on)
        return rows.select(*on, _linear(self.coefficients, [F.col(c) for c in self.features]).alias("y_hat"))


def similarity_weights(calibration: DataFrame, queries: DataFrame, features: tuple[str, ...], bandwidth: float = 1.0, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """(keys, query_time, time, weight): Gaussian kernels of scaled distances, divided by their sum and one.

    Each query is compared with the calibration rows of its series, whose number the caller bounds.
    """
    scale = calibration.groupBy(*keys).agg(*(F.greatest(F.stddev_pop(c), F.lit(1e-12)).alias(f"_s_{c}") for c in features))
    a = calibration.select(*keys, time, *features).join(scale, list(keys))
    b = queries.select(*keys, F.col(time).alias("query_time"), *(F.col(c).alias(f"_q_{c}") for c in features))
    square = None
    for c in features:
        one = F.pow((F.col(c) - F.col(f"_q_{c}")) / F.col(f"_s_{c}"), F.lit(2.0))
        square = one if square is None else square + one
    rows = a.join(b, list(keys)).withColumn("_d", F.sqrt(square) / bandwidth)
    w = Window.partitionBy(*keys, "query_time")
    rows = rows.withColumn("_k", F.exp(-(F.col("_d") - F.min("_d").over(w))))
    return rows.select(*keys, "query_time", time, (F.col("_k") / (F.sum("_k").over(w) + 1)).alias("weight"))
