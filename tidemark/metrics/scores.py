"""Scorers: align, row errors, weights, and one collapse over steps, components, groups and vintages.

Aligned tables are long: (group, component, vintage_time, time, step, y, y_hat), interval tables add coverage_rate, lower
and upper. A dimension that is collapsed is averaged away, in the order rates, rows, components, groups, transform,
vintages; without vintages in the table a single one is assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.intervals import Interval

EVERY = ("step", "vintage", "component", "group", "rate")


def aligned(truth: DataFrame, forecast: DataFrame, interval: str = "1d", keys: tuple[str, ...] = ("group", "component"), time: str = "time") -> DataFrame:
    """forecast rows with their truth (inner), and the step since the vintage."""
    step = Interval.parse(interval).between(F.col("vintage_time"), F.col(time))
    return forecast.join(truth, [*keys, time]).withColumn("step", step)


def without_partial_vintage(rows: DataFrame) -> DataFrame:
    """Drops the last of at least three vintages if it comes sooner after the one before than vintages mostly do (ties: the
    smaller gap). Lazy: the distinct vintages, one aggregate row and a join; rows are scanned once more, never collected."""
    vintages = rows.select("vintage_time").distinct().groupBy().agg(F.array_sort(F.collect_list(F.unix_micros(F.col("vintage_time").cast("timestamp")))).alias("_v"))
    gaps = F.transform(F.sequence(F.lit(2), F.greatest(F.size("_v"), F.lit(2))), lambda i: F.try_element_at("_v", i) - F.try_element_at("_v", i - 1))
    found = vintages.filter(F.size("_v") >= 3).select(F.try_element_at("_v", F.lit(-1)).alias("_last"), gaps.alias("_g"))
    often = found.select("_last", F.try_element_at("_g", F.lit(-1)).alias("_gap"), F.explode("_g").alias("_g")).groupBy("_last", "_gap", "_g").agg(F.count("*").alias("_n"))
    often = often.groupBy("_last", "_gap").agg(F.max(F.struct("_n", (-F.col("_g")).alias("_g"))).alias("_m"))
    partial = often.filter(F.col("_gap") < -F.col("_m._g")).select(F.timestamp_micros("_last").cast(rows.schema["vintage_time"].dataType).alias("vintage_time"))
    return rows.join(partial, "vintage_time", "left_anti")


def _y() -> tuple[Column, Column]:
    return F.col("y"), F.col("y_hat")


def pinball(tau: Column, y: Column, q: Column) -> Column:
    return F.when(y >= q, tau * (y - q)).otherwise((1 - tau) * (q - y))


@dataclass(frozen=True)
class Metric:
    """error: of a row. transform: of the mean after components and groups. whole: an aggregate over a vintage instead of a mean of errors."""

    name: str
    error: Callable[[], Column]
    transform: Callable[[Column], Column] = lambda c: c
    whole: Callable[[], Column] | None = None
    lower_is_better: bool = True


_EPS = 1e-8


def _scaled(power: int) -> Callable[[], Column]:
    return lambda: F.pow(F.abs(F.col("y") - F.col("y_hat")), F.lit(float(power))) / F.greatest(F.col("scale"), F.lit(1e-10))


def _covered() -> Column:
    return ((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double")


def _interval_score() -> Column:
    y, lower, upper, rate = (F.col(c) for c in ("y", "lower", "upper", "coverage_rate"))
    return F.abs(upper - lower) + F.when(y < lower, 2 / rate * (lower - y)).otherwise(0.0) + F.when(y > upper, 2 / rate * (y - upper)).otherwise(0.0)


def _pinballs() -> Column:
    rate = F.col("coverage_rate")
    return pinball((1 - rate) / 2, F.col("y"), F.col("lower")) + pinball((1 + rate) / 2, F.col("y"), F.col("upper"))


def _r2() -> Column:
    y, h = _y()
    residual = F.sum((y - h) * (y - h))
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")
    return F.when(F.abs(total) < 1e-12, 0.0).otherwise(1 - residual / F.when(F.abs(total) >= 1e-12, total))


POINT = {
    m.name: m
    for m in (
        Metric("mae", lambda: F.abs(F.col("y") - F.col("y_hat"))),
        Metric("mse", lambda: F.pow(F.col("y") - F.col("y_hat"), F.lit(2.0))),
        Metric("rmse", lambda: F.pow(F.col("y") - F.col("y_hat"), F.lit(2.0)), F.sqrt),
        Metric("mape", lambda: 100 * F.abs(F.col("y") - F.col("y_hat")) / (F.abs("y") + _EPS)),
        Metric("smape", lambda: 100 * F.abs(F.col("y") - F.col("y_hat")) / ((F.abs("y") + F.abs("y_hat")) / 2 + _EPS)),
        Metric("mase", _scaled(1)),
        Metric("rmsse", _scaled(2), F.sqrt),
        Metric("median_ae", lambda: F.lit(None), whole=lambda: F.median(F.abs(F.col("y") - F.col("y_hat")))),
        Metric("max_ae", lambda: F.lit(None), whole=lambda: F.max(F.abs(F.col("y") - F.col("y_hat")))),
        Metric("r2", lambda: F.lit(None), whole=_r2, lower_is_better=False),
        Metric("mda", lambda: F.col("same_direction"), lower_is_better=False),
    )
}
INTERVAL = {
    m.name: m
    for m in (
        Metric("empirical_coverage", _covered, lower_is_better=False),
        Metric("mean_interval_width", lambda: F.abs(F.col("upper") - F.col("lower"))),
        Metric("interval_score", _interval_score),
        Metric("pinball_loss", _pinballs),
    )
}


def naive_scale(train: DataFrame, seasonality: int = 1, power: int = 1, keys: tuple[str, ...] = ("group", "component"), time: str = "time") -> DataFrame:
    """(keys, scale): the mean of |y_t - y_{t-s}| ** power on training rows."""
    w = Window.partitionBy(*keys).orderBy(time)
    return train.withColumn("_d", F.pow(F.abs(F.col("y") - F.lag("y", seasonality).over(w)), F.lit(float(power)))).groupBy(*keys).agg(F.avg("_d").alias("scale"))


def with_directions(rows: DataFrame) -> DataFrame:
    """same_direction: whether y and y_hat move alike from a vintage's row before; vintages of one row are left out."""
    w = Window.partitionBy("group", "component", "vintage_time").orderBy("time")
    same = F.signum(F.col("y") - F.lag("y").over(w)) == F.signum(F.col("y_hat") - F.lag("y_hat").over(w))
    return rows.withColumn("same_direction", same.cast("double")).filter("same_direction is not null")


def normalised_weight(weight: Column, rows: WindowSpec) -> Column:
    """weight scaled to a mean of one over the rows of a window."""
    return weight * F.count(weight).over(rows) / F.sum(weight).over(rows)


def _by_name(weights: dict[str, float] | None, name: str) -> Column:
    """The weight of a name; one without weights, none for names that have none."""
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))), F.col(name)), F.lit(0.0))


@dataclass
class Collapse:
    """Which dimensions are averaged away, with optional weights.

    weight: columns of row weights (by time, by step); each is scaled to a mean of one over the rows of its group, component
    and rate before it multiplies the errors. vintage_weight: a column, constant in a vintage, for the mean over vintages.
    rate_weights: of coverage rates (name -> weight; one for rates without). group_weights, component_weights: by name.
    """

    over: tuple[str, ...] = EVERY
    group_weights: dict[str, float] | None = None
    component_weights: dict[str, float] | None = None
    weight: str | tuple[str, ...] | None = field(default=None)
    vintage_weight: str | None = None
    rate_weights: dict[float, float] | None = None

    def apply(self, rows: DataFrame, metric: Metric) -> DataFrame:
        keep = [c for c in ("group", "component", "vintage_time", "step", "time", "coverage_rate") if c in rows.columns]
        step, vintage = "step" in self.over, "vintage" in self.over
        value = metric.error()
        own = Window.partitionBy(*(c for c in ("group", "component", "coverage_rate") if c in keep))
        for w in (self.weight,) if isinstance(self.weight, str) else self.weight or ():
            value = value * normalised_weight(F.col(w).cast("double"), own)
        extra = [self.vintage_weight] if self.vintage_weight and "vintage_time" in keep else []
        if "coverage_rate" in keep and "rate" in self.over:
            w = F.lit(1.0) if not self.rate_weights else F.coalesce(_by_name({str(k): v for k, v in self.rate_weights.items()}, "_rate"), F.lit(1.0))
            rows = rows.withColumns({"_e": value, "_rate": F.col("coverage_rate").cast("string")}).withColumn("_cw", w)
            keep.remove("coverage_rate")
            rows, value = rows.groupBy(*keep, *extra).agg((F.sum(F.col("_e") * F.col("_cw")) / F.sum(F.when(F.col("_e").isNotNull(), F.col("_cw")))).alias("_e")), F.col("_e")
        elif self.weight:
            rows, value = rows.withColumn("_e", value), F.col("_e")
        gone = {"time"} | ({"step"} if step else {"vintage_time"} if vintage else set()) if step or vintage else set()
        keep = [c for c in keep if c not in gone]
        extra = extra if "vintage_time" in keep else []
        out = rows.groupBy(*keep).agg((F.avg(value) if metric.whole is None else metric.whole()).alias("_v"), *(F.first(c).alias(c) for c in extra))
        for name, weights in (("component", self.component_weights), ("group", self.group_weights)):
            if name in self.over and name in keep:
                keep.remove(name)
                w = _by_name(weights, name)
                out = out.groupBy(*keep).agg((F.sum(F.col("_v") * w) / F.sum(w)).alias("_v"), *(F.first(c).alias(c) for c in extra))
        out = out.withColumn("_v", metric.transform(F.col("_v")))
        if vintage and "vintage_time" in keep:
            keep.remove("vintage_time")
            w = F.col(extra[0]) if extra else F.lit(1.0)
            out = out.groupBy(*keep).agg((F.sum(F.col("_v") * w) / F.sum(w)).alias("_v"))
        return out.drop(*extra).withColumnRenamed("_v", metric.name)


def point_score(rows: DataFrame, name: str, over: tuple[str, ...] = EVERY, **options) -> DataFrame:
    return Collapse(over, **options).apply(with_directions(rows) if name == "mda" else rows, POINT[name])


def interval_score(rows: DataFrame, name: str, over: tuple[str, ...] = EVERY, **options) -> DataFrame:
    return Collapse(over, **options).apply(rows, INTERVAL[name])


def _rates(rows: DataFrame) -> list[float]:
    """The coverage rates of a table, in order: at most a few hundred by what they are."""
    rates = sorted(r[0] for r in rows.select("coverage_rate").distinct().collect())
    if len(rates) < 2:
        raise ValueError(f"at least two coverage rates are needed; there are {len(rates)}")
    return rates


def calibration_error(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean over rates (two at least) of |share covered - rate|."""
    _rates(rows)
    rates = rows.groupBy(*by, "coverage_rate").agg(F.abs(F.avg(_covered()) - F.col("coverage_rate")).alias("_e"))
    return rates.groupBy(*by).agg(F.avg("_e").alias("calibration_error"))


def trapezoidal_weights(rates: list[float]) -> dict[float, float]:
    """Of each rate: the widths of the cells around its two quantile levels, cells being cut halfway between neighbours in [0, 1]."""
    levels = sorted([(1 - r) / 2 for r in rates] + [(1 + r) / 2 for r in rates])
    edges = [0.0, *((a + b) / 2 for a, b in zip(levels, levels[1:])), 1.0]
    width = {t: edges[i + 1] - edges[i] for i, t in enumerate(levels)}
    return {r: width[(1 - r) / 2] + width[(1 + r) / 2] for r in rates}


def crps(rows: DataFrame, by: tuple[str, ...] = (), integration: str = "mean") -> DataFrame:
    """The mean over rates (two at least; integration "trapezoidal": weighted by their cells), then rows, of half the pinball losses."""
    rates = _rates(rows)
    weights = dict.fromkeys(rates, 1.0) if integration == "mean" else trapezoidal_weights(rates)
    w = F.element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))), F.col("coverage_rate"))
    per_row = rows.groupBy("group", "component", "vintage_time", "time").agg((F.sum(_pinballs() / 2 * w) / F.sum(w)).alias("_e"))
    return per_row.groupBy(*by).agg(F.avg("_e").alias("crps"))


#: Names of scorers, and whether less is better.
SCORERS = {m.name: m.lower_is_better for m in (*POINT.values(), *INTERVAL.values())} | {"calibration_error": True, "crps": True, "log_loss": True, "brier_score": True, "ranked_probability_score": True, "accuracy": False, "precision": False, "recall": False, "f_beta": False, "roc_auc": False, "pr_auc": False}


@dataclass(frozen=True)
class Scorer:
    """A scorer by name, with its options: score(rows) gives its one-row (or by dimension) table, signed() so that more is better."""

    name: str
    options: dict = field(default_factory=dict)

    def score(self, rows: DataFrame) -> DataFrame:
        if self.name in POINT:
            return point_score(rows, self.name, **self.options)
        if self.name in INTERVAL:
            return interval_score(rows, self.name, **self.options)
        if self.name in ("calibration_error", "crps"):
            return {"calibration_error": calibration_error, "crps": crps}[self.name](rows, **self.options)
        family = proba_scores if self.name in ("log_loss", "brier_score", "ranked_probability_score") else ranking_scores if self.name.endswith("auc") else hard_label_scores
        found = family(rows, **self.options)
        others = {"log_loss", "brier_score", "ranked_probability_score", "accuracy", "precision", "recall", "f_beta", "roc_auc", "pr_auc"} - {self.name}
        return found.drop(*others)

    def signed(self, rows: DataFrame) -> DataFrame:
        out = self.score(rows)
        return out.withColumn(self.name, -F.col(self.name)) if SCORERS[self.name] else out


def get_scorer(name: str) -> Scorer:
    """The scorer of a name with its default options; a name without a scorer is an error that lists them."""
    return make_scorer(name)


def make_scorer(name: str, **options) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"no scorer {name!r}; there are {', '.join(sorted(SCORERS))}")
    return Scorer(name, options)


# --- class probabilities: long rows (id..., label, p, y) with y the true label -----------------------------------


def proba_scores(rows: DataFrame, ids: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """log_loss, brier_score and ranked_probability_score (labels in their own order)."""
    hit = (F.col("label") == F.col("y")).cast("double")
    w = Window.partitionBy(*ids).orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_hit": hit, "_cp": F.sum("p").over(w), "_ch": F.sum(hit).over(w), "_k": F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("label")))})
    per = rows.groupBy(*{*ids, *by}).agg(
        (-F.log(F.greatest(F.least(F.max(F.when(F.col("_hit") == 1, F.col("p"))), F.lit(1 - 1e-15)), F.lit(1e-15)))).alias("l"),
        F.sum(F.pow(F.col("p") - F.col("_hit"), F.lit(2.0))).alias("b"),
        (F.sum(F.when(F.col("_k") > 1, F.pow(F.col("_cp") - F.col("_ch"), F.lit(2.0))).otherwise(0.0)) / F.greatest(F.count("*") - 1, F.lit(1))).alias("r"),
    )
    return per.groupBy(*by).agg(F.avg("l").alias("log_loss"), F.avg("b").alias("brier_score"), F.avg("r").alias("ranked_probability_score"))


def hard_labels(rows: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """(ids, y, y_hat): the label of the largest probability, ties to the first label."""
    w = Window.partitionBy(*ids).orderBy(F.desc("p"), "label")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*ids, "y", F.col("label").alias("y_hat"))


def hard_label_scores(rows: DataFrame, beta: float = 1.0, zero_division: float = 0.0) -> DataFrame:
    """accuracy, and macro precision, recall and f_beta over all labels that are true or predicted somewhere."""
    total = rows.agg(F.avg((F.col("y") == F.col("y_hat")).cast("double")).alias("accuracy"))
    counted = rows.groupBy("y", "y_hat").agg(F.count("*").alias("n"))
    each = counted.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("y") == F.col("y_hat"), 0).otherwise(F.col("n")).alias("fn"), F.lit(0).cast("bigint").alias("fp")), F.struct(F.col("y_hat").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fn"), F.when(F.col("y") == F.col("y_hat"), 0).otherwise(F.col("n")).alias("fp")))).alias("e")).select("e.*")
    sums = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    ratio = lambda a, b: F.when(b == 0, zero_division).otherwise(a / F.when(b != 0, b))
    tp, fn, fp, b2 = F.col("tp"), F.col("fn"), F.col("fp"), beta * beta
    macro = sums.agg(F.avg(ratio(tp, tp + fp)).alias("precision"), F.avg(ratio(tp, tp + fn)).alias("recall"), F.avg(ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)).alias("f_beta"))
    return total.crossJoin(macro)  # one row each


def ranking_scores(rows: DataFrame, score: str = "score", truth: str = "truth", by: tuple[str, ...] = ()) -> DataFrame:
    """roc_auc (ties count half) and average precision of a 0/1 truth, from counts per distinct score: only those are windowed."""
    counts = rows.groupBy(*by, score).agg(F.sum(truth).cast("double").alias("pos"), F.sum(1 - F.col(truth)).cast("double").alias("neg"))
    down = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("pos") * F.sum("neg"))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.when(F.sum("pos") > 0, F.sum("pos"))
    return counts.groupBy(*by).agg(F.coalesce(auc, F.lit(0.0)).alias("roc_auc"), F.coalesce(ap, F.lit(0.0)).alias("pr_auc"))
