"""Conformity scores and the order statistics that turn them into intervals."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import clipped_walk

EPSILON = 1e-8


def conformity(kind: str, epsilon: float = EPSILON) -> Column:
    """Of (y, y_hat, and scale for the normalised kinds): residual, absolute, gamma, absolute_gamma, normalized, absolute_normalized."""
    r = F.col("y") - F.col("y_hat")
    value = r / (F.col("y_hat") + epsilon) if "gamma" in kind else r / F.greatest(F.col("scale"), F.lit(epsilon)) if "normalized" in kind else r
    return F.abs(value) if kind.startswith("absolute") else value


def unit(kind: str, epsilon: float = EPSILON) -> Column:
    """What a score is multiplied with to be a distance from y_hat."""
    return F.col("y_hat") + epsilon if "gamma" in kind else F.greatest(F.col("scale"), F.lit(epsilon)) if "normalized" in kind else F.lit(1.0)


def _at(scores: Column, k: Column) -> Column:
    n = F.size(scores)
    return F.element_at(scores, F.greatest(F.lit(1), F.least(k.cast("int"), n)))


def order_bounds(scores: Column, rate: float, symmetric: bool) -> tuple[Column, Column]:
    """(low, high) order statistics of a sorted array: ceil((n+1) rate) for symmetric scores, both tails otherwise, clamped to the array."""
    n = F.size(scores) + 1
    if symmetric:
        high = _at(scores, F.ceil(n * F.lit(rate) - 1e-9))
        return -high, high
    alpha = 1 - rate
    if rate == 0:
        middle = _at(scores, F.floor(n / F.lit(2.0)))
        return middle, middle
    return _at(scores, F.floor(n * F.lit(alpha / 2) + 1e-9)), _at(scores, F.ceil(n * F.lit(1 - alpha / 2) - 1e-9))


def intervals(scores: DataFrame, forecast: DataFrame, kind: str, rates: tuple[float, ...], by: tuple[str, ...] = ("group", "step")) -> DataFrame:
    """forecast with one row per coverage rate: lower and upper from the sorted calibration scores of its `by` group."""
    table = scores.groupBy(*by).agg(F.array_sort(F.collect_list("score")).alias("_scores"))
    rows = []
    for rate in rates:
        low, high = order_bounds(F.col("_scores"), rate, kind.startswith("absolute"))
        rows.append(F.struct(F.lit(rate).alias("coverage_rate"), (F.col("y_hat") + low * unit(kind)).alias("lower"), (F.col("y_hat") + high * unit(kind)).alias("upper")))
    return forecast.join(table, list(by)).withColumn("_r", F.explode(F.array(*rows))).select(*forecast.columns, "_r.*")


def weighted_quantile(rows: DataFrame, upper_mass: float, by: tuple[str, ...], score: str = "score", weight: str = "weight") -> DataFrame:
    """The smallest score whose cumulative weight reaches 1 - upper_mass; the largest if none does."""
    w = Window.partitionBy(*by).orderBy(score).rangeBetween(Window.unboundedPreceding, 0)
    cumulative = rows.withColumn("_c", F.sum(weight).over(w))
    return cumulative.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_c") >= 1 - upper_mass - 1e-12, F.col(score))), F.max(score)).alias("quantile"))


def required_calibration_size(rate: float, symmetric: bool) -> int:
    """The least number of scores for which the wanted order statistic exists."""
    n = 1
    while True:
        k = math.ceil((n + 1) * rate - 1e-9) if symmetric else math.ceil((n + 1) * (1 + rate) / 2 - 1e-9)
        if k <= n and (symmetric or math.floor((n + 1) * (1 - rate) / 2 + 1e-9) >= 1):
            return n
        n += 1


def difference_scale(train: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """(keys, scale): the population deviation of first differences of y."""
    w = Window.partitionBy(*keys).orderBy(time)
    return train.withColumn("_d", F.col("y") - F.lag("y").over(w)).groupBy(*keys).agg(F.stddev_pop("_d").alias("scale"))


def adaptive_levels(errors: DataFrame, target: float, step_size: float = 0.05, epsilon: float = 0.0, by: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """(by, time, alpha): alpha + step_size * (target - error), clipped to [epsilon, 1 - epsilon], before each observation."""
    return clipped_walk(errors, step_size * (target - F.col("error")), target, epsilon, 1 - epsilon, by, time, "alpha")


def warn_if_calibration_too_small(n_scores: int, rate: float, symmetric: bool, step: int) -> bool:
    """Warns, and says so, where so few scores cannot express a coverage rate: the interval ends at the scores' own span."""
    need = required_calibration_size(rate, symmetric) if rate < 1 else 0
    if n_scores >= need:
        return False
    warnings.warn(f"a coverage of {rate} at step {step} needs {need} calibration scores a series, there are {n_scores}: the interval will cover less", UserWarning, stacklevel=2)
    return True


def effective_sizes(weights: DataFrame, by: tuple[str, ...], weight: str = "weight") -> DataFrame:
    """(by, effective_size, collapsed): the squared sum of weights by the sum of their squares; collapsed below two."""
    found = weights.groupBy(*by).agg(F.coalesce(F.try_divide(F.pow(F.sum(weight), F.lit(2.0)), F.sum(F.col(weight) * F.col(weight))), F.lit(0.0)).alias("effective_size"))
    return found.withColumn("collapsed", F.col("effective_size") < 2)


def warn_if_weights_collapsed(weights: DataFrame, by: tuple[str, ...], weight: str = "weight") -> int:
    """Warns where queries lean on almost a single calibration row, and says how many do."""
    n = effective_sizes(weights, by, weight).filter("collapsed").count()
    if n:
        warnings.warn(f"the similarity weights of {n} queries rest on fewer than two calibration rows; a larger bandwidth spreads them", UserWarning, stacklevel=2)
    return n


def global_calibration_weights(weights: DataFrame, n_columns: int, by: tuple[str, ...], weight: str = "weight") -> DataFrame:
    """weights, one row for each of n_columns ("column"), over the scores of all columns together.

    A query's weights w sum to less than one, as they hold back the mass of the query itself: w / (1 - sum w) undoes that
    for one column, and the mass is held back again from the combined set.
    """
    w = Window.partitionBy(*by)
    total = F.sum(weight).over(w)
    raw = weights.withColumn("_raw", F.when(total >= 1, F.col(weight)).otherwise(F.col(weight) / (1 - total)))
    raw = raw.withColumn(weight, F.col("_raw") / (F.sum("_raw").over(w) * n_columns + 1)).drop("_raw")
    return raw.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(n_columns - 1))))


def diagnose_global_calibration(scores: DataFrame, step: int = 1, time: str = "time") -> DataFrame:
    """One row: whether scores (group, step, time, score) of several series may be calibrated together.

    cross_sectional_correlation: the mean correlation of two series' scores at the same time; effective_gain: how many
    series' worth of scores they are then; score_heterogeneity: the 90th over the 10th percentile of mean absolute scores;
    n_columns, n_times. The correlations' mean comes from sums over times, not from pairs: of unit-variance scores z, the sum
    over pairs at a time is ((sum z)^2 - sum z^2) / 2. Scores are taken to be there for all series and times.
    """
    own = scores.filter(F.col("step") == step)
    by = Window.partitionBy("group")
    z = own.withColumn("_z", F.try_divide(F.col("score") - F.avg("score").over(by), F.stddev_pop("score").over(by)))
    at = z.groupBy(time).agg(F.sum("_z").alias("_s"), F.sum(F.col("_z") * F.col("_z")).alias("_q"), F.count("_z").alias("_n"))
    pairs = at.agg((F.sum((F.col("_s") * F.col("_s") - F.col("_q"))) / F.sum(F.col("_n") * (F.col("_n") - 1))).alias("cross_sectional_correlation"), F.count("*").alias("n_times"))
    size = own.groupBy("group").agg(F.avg(F.abs("score")).alias("_m"))
    spread = size.agg(F.try_divide(F.percentile("_m", F.lit(0.9)), F.percentile("_m", F.lit(0.1))).alias("score_heterogeneity"), F.count("*").alias("n_columns"))
    rho = F.greatest(F.col("cross_sectional_correlation"), F.lit(0.0))
    both = pairs.crossJoin(spread)  # one row each
    return both.withColumn("effective_gain", F.col("n_columns") / (1 + (F.col("n_columns") - 1) * rho))


class QuantileConformity:
    """The contract of conformity scores of interval forecasts: score(rows) and interval(rows, low, high) are the user's."""

    symmetric = False

    def score(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def interval(self, rows: DataFrame, low: Column, high: Column) -> DataFrame:
        raise NotImplementedError


class QuantileResidual(QuantileConformity):
    """How far y is beyond the nearer bound, below zero inside: max(lower - y, y - upper); bounds move out by it."""

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.greatest(F.col("lower") - F.col("y"), F.col("y") - F.col("upper")))

    def interval(self, rows: DataFrame, low: Column, high: Column) -> DataFrame:
        return rows.withColumns({"lower": F.col("lower") - high, "upper": F.col("upper") + high})


class AbsoluteQuantileResidual(QuantileResidual):
    """The same without credit for y inside the bounds."""

    symmetric = True

    def score(self, rows: DataFrame) -> DataFrame:
        return super().score(rows).withColumn("score", F.greatest("score", F.lit(0.0)))
