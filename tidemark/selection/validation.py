"""Splitters as objects, scores and predictions by fold, searches that can be asked again, and rounds of boosted models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.metrics.scores import SCORERS, Scorer, make_scorer
from tidemark.models.exogenous import Conformal, rolled
from tidemark.models.forecasters import Forecaster
from tidemark.operators.validation import check_horizon, validate_search_data
from tidemark.selection.search import Fold, expanding_window, fold_rows, sliding_window


class Splitter:
    """split(n) gives the folds of series of n rows. The user's own splitters need no more than that."""

    n_splits: int = 3

    def split(self, n: int) -> list[Fold]:
        raise NotImplementedError


@dataclass
class Expanding(Splitter):
    n_splits: int = 3
    test_size: int | None = None
    max_train_size: int | None = None

    def split(self, n: int) -> list[Fold]:
        return expanding_window(n, self.n_splits, self.test_size, self.max_train_size)


@dataclass
class Sliding(Splitter):
    n_splits: int = 3
    test_size: int = 10
    train_size: int | None = None
    stride: int | None = None

    def split(self, n: int) -> list[Fold]:
        return sliding_window(n, self.n_splits, self.test_size, self.train_size, self.stride)


def check_cv(cv: int | Splitter | Iterable[Fold] = 5, horizon: int = 1) -> Splitter:
    """A splitter: a number stands for so many expanding folds that test one horizon each."""
    if isinstance(cv, Splitter):
        return cv
    if isinstance(cv, int):
        return Expanding(cv, horizon)
    given = list(cv)

    class Given(Splitter):
        n_splits = len(given)

        def split(self, n: int) -> list[Fold]:
            return given

    return Given()


def check_cv_alignment(cv: Splitter, horizon: int) -> dict:
    """How a splitter's test blocks meet a horizon: n_vintages a fold (one forecast, and one for each stride observed after it),
    steps_per_vintage, step_counts, and is_balanced, whether strides fill the block. None for splitters of the user's own."""
    if isinstance(cv, Sliding):
        size, stride = cv.test_size, cv.stride or cv.test_size
    elif isinstance(cv, Expanding):
        size = stride = cv.test_size or horizon
    else:
        return dict.fromkeys(("n_vintages", "steps_per_vintage", "step_counts", "is_balanced"))
    n = 1 + math.ceil(size / stride)
    return {"n_vintages": n, "steps_per_vintage": [horizon] * n, "step_counts": {h: n for h in range(1, horizon + 1)}, "is_balanced": size % stride == 0}


def split_forecasts(forecasts: DataFrame, parts: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """forecasts with (fold, part): train those whose vintage is not after a fold's last training row, test those within its
    test block. parts: rows with (keys, time, fold, part)."""
    ends = parts.groupBy(*keys, "fold").agg(F.max(F.when(F.col("part") == "train", F.col(time))).alias("_a"), F.max(time).alias("_b"))
    out = forecasts.join(ends, list(keys))
    part = F.when(F.col("vintage_time") <= F.col("_a"), "train").when(F.col("vintage_time") <= F.col("_b"), "test")
    return out.withColumn("part", part).filter("part is not null").drop("_a", "_b")


def _folds(df: DataFrame, model: Forecaster, cv: Splitter) -> tuple[list[Fold], DataFrame]:
    n = df.groupBy(*model.keys).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if n is None:
        raise ValueError("there are no rows to split")
    folds = cv.split(n)
    return folds, fold_rows(df, folds, keys=model.keys, time=model.time)


def _of(parts: DataFrame, fold: int, part: str) -> DataFrame:
    return parts.filter((F.col("fold") == fold) & (F.col("part") == part)).drop("fold", "part")


def _predictions(model: Forecaster, parts: DataFrame, fold: Fold, horizon: int, stride: int | None, rates: tuple[float, ...]) -> DataFrame:
    """Forecasts of one fold's test block: from its last training row, and, with a stride, from every stride-th row after it by
    the same fitted model; of two forecasts of one vintage and stamp one is kept."""
    train, test = _of(parts, fold.fold, "train"), _of(parts, fold.fold, "test")
    fitted = replace(model).fit(train)
    if rates and isinstance(model, Conformal):
        fitted = replace(model, rates=rates).fit(train)
        return fitted.predict_interval(horizon)
    if stride is None:
        return fitted.predict(horizon)
    whole = rolled(fitted, train.unionByName(test), horizon, stride)
    last = train.groupBy(*model.keys).agg(F.max(model.time).alias("_last"))
    ahead = whole.join(last, list(model.keys)).filter(F.col("vintage_time") >= F.col("_last")).drop("_last")
    first = fitted.predict(horizon).select(*ahead.columns)
    return ahead.unionByName(first).dropDuplicates([*model.keys, "vintage_time", model.time])


def cross_val_predict(model: Forecaster, df: DataFrame, horizon: int = 1, cv: int | Splitter = 5, stride: int | None = None, rates: tuple[float, ...] = ()) -> DataFrame:
    """(fold, keys, vintage_time, time, step, y_hat, or intervals): forecasts of every fold's test block, one lazy union."""
    check_horizon(horizon)
    folds, parts = _folds(df, model, check_cv(cv, horizon))
    parts = parts.persist()  # every fold reads it
    out = [_predictions(model, parts, f, horizon, stride, rates).withColumn("fold", F.lit(f.fold)) for f in folds]
    return reduce(DataFrame.unionByName, out)


def _scored(model: Forecaster, parts: DataFrame, fold: Fold, horizon: int, stride: int | None, scorer: Scorer, error_score: float | str) -> DataFrame:
    try:
        rows = _predictions(model, parts, fold, horizon, stride, ())
        truth = _of(parts, fold.fold, "test").select(*model.keys, model.time, F.col(model.target).cast("double").alias("y"))
        rows = rows.join(truth, [*model.keys, model.time]).withColumn("component", F.lit("y"))
        rows = rows if "group" in rows.columns else rows.withColumn("group", F.concat_ws("/", *model.keys))
        return scorer.score(rows).select(F.lit(fold.fold).alias("fold"), F.col(scorer.name).cast("double").alias(scorer.name))
    except ValueError:
        if error_score == "raise":
            raise
        return parts.sparkSession.createDataFrame([(fold.fold, float(error_score))], f"fold int, {scorer.name} double")


def cross_val_score(model: Forecaster, df: DataFrame, horizon: int = 1, scoring: str | Scorer = "mae", cv: int | Splitter = 5, stride: int | None = None, error_score: float | str = "raise", greater_is_better: bool = False) -> DataFrame:
    """(fold, score). greater_is_better turns the sign of scores of which less is better. error_score: what a fold gets whose
    fit cannot be done, or "raise"."""
    check_horizon(horizon)
    scorer = make_scorer(scoring) if isinstance(scoring, str) else scoring
    folds, parts = _folds(df, model, check_cv(cv, horizon))
    parts = parts.persist()
    out = reduce(DataFrame.unionByName, [_scored(model, parts, f, horizon, stride, scorer, error_score) for f in folds])
    return out.withColumn(scorer.name, -F.col(scorer.name)) if greater_is_better and SCORERS[scorer.name] else out


@dataclass
class Search:
    """Candidates by cross-validation, the best one fitted on all rows; predict and observe go to it.

    fit() keeps results (candidate, params, mean, std, rank). candidates: options of the model, from grid() or randomized().
    """

    model: Forecaster
    candidates: list[dict] = field(default_factory=list)
    scoring: str = "mae"
    cv: int | Splitter = 3
    horizon: int = 1
    refit: bool | Callable[[list], int] = True

    def fit(self, df: DataFrame) -> Search:
        validate_search_data(df.select(*self.model.keys, self.model.time, self.model.target), None, self.model.keys, self.model.time)
        rows = []
        for i, c in enumerate(self.candidates):
            found = cross_val_score(replace(self.model, **c), df, self.horizon, self.scoring, self.cv).collect()  # a row for each fold
            values = [r[self.scoring] for r in found]
            rows.append((i, str(c), float(np.mean(values)), float(np.std(values))))
        lower = SCORERS[self.scoring]
        order = sorted(r[2] if lower else -r[2] for r in rows)
        self.results = df.sparkSession.createDataFrame([(*r, 1 + order.index(r[2] if lower else -r[2])) for r in rows], "candidate int, params string, mean double, std double, rank int")
        self.best_index = self.refit(rows) if callable(self.refit) else min(rows, key=lambda r: r[2] if lower else -r[2])[0]
        self.best_params = self.candidates[self.best_index]
        self.best = replace(self.model, **self.best_params).fit(df) if self.refit else None
        return self

    def predict(self, horizon: int) -> DataFrame:
        return self.best.predict(horizon)


class EarlyStopping:
    """The protocol of boosted estimators: set the most rounds, read the validation curve, cut to a round."""

    def rounds(self, estimator, n: int):
        raise NotImplementedError

    def curve(self, model) -> tuple[list[float], bool]:
        """Values by round, and whether more is better."""
        raise NotImplementedError

    def cut(self, model, n: int):
        raise NotImplementedError


class GradientBoostedTrees(EarlyStopping):
    """Of pyspark.ml: curves from evaluateEachIteration on rows held out, models of the first n trees by their weights."""

    def __init__(self, held_out: DataFrame | None = None, loss: str = "squared"):
        self.held_out, self.loss = held_out, loss

    def rounds(self, estimator, n: int):
        return estimator.copy({estimator.maxIter: n})

    def curve(self, model) -> tuple[list[float], bool]:
        return list(model.evaluateEachIteration(self.held_out, self.loss)), False

    def cut(self, model, n: int) -> Callable[[DataFrame], DataFrame]:
        """rows -> rows with `prediction` of the first n trees."""
        trees, weights = model.trees[:n], model.treeWeights[:n]

        def predict(rows: DataFrame) -> DataFrame:
            for i, t in enumerate(trees):
                rows = t.copy({t.predictionCol: f"_t{i}"}).transform(rows)
            total = sum((F.col(f"_t{i}") * float(w) for i, w in enumerate(weights)), F.lit(0.0))
            return rows.withColumn("prediction", total).drop(*(f"_t{i}" for i in range(len(trees))))

        return predict


def shared_rounds(curves: dict[str, list[tuple[list[float], bool]]]) -> tuple[dict[str, int], dict[str, bool]]:
    """One round (from 1) for each name: the best of the folds' mean curve over the rounds that all folds have, the first of
    equals; and whether it is the last of these."""
    rounds, last = {}, {}
    for name, own in curves.items():
        if not own or any(not len(c) for c, _ in own):
            raise ValueError(f"{name}: a fold has no curve")
        if len({bool(up) for _, up in own}) > 1:
            raise ValueError(f"{name}: more is better in some folds, less in others")
        n = min(len(c) for c, _ in own)
        mean = np.mean([np.asarray(c[:n], float) for c, _ in own], axis=0)
        rounds[name] = int(np.nanargmax(mean) if own[0][1] else np.nanargmin(mean)) + 1
        last[name] = rounds[name] == n
    return rounds, last


def evaluate_shared_rounds(estimator, adapter: Callable[[DataFrame], EarlyStopping], folds: list[tuple[DataFrame, DataFrame]], most: int) -> tuple[int, bool, list]:
    """The round that is best over (train, held out) folds, whether it is the last, and each fold's predictor cut to it."""
    found, adapters = [], []
    for train, held in folds:
        a = adapter(held)
        found.append(a.rounds(estimator, most).fit(train))
        adapters.append(a)
    rounds, last = shared_rounds({"model": [a.curve(m) for a, m in zip(adapters, found)]})
    return rounds["model"], last["model"], [a.cut(m, rounds["model"]) for a, m in zip(adapters, found)]


def fold_table(folds: list[Fold], inner: Splitter | None = None) -> list[tuple[int, int | None, str, int, int]]:
    """(fold, inner fold, part, from, to) of splits, and of an inner splitter's splits of each training block."""
    out = []
    for f in folds:
        out += [(f.fold, None, "train", f.train_start, f.train_end), (f.fold, None, "test", f.train_end, f.test_end)]
        for g in inner.split(f.train_end - f.train_start) if inner else []:
            out += [(f.fold, g.fold, "train", f.train_start + g.train_start, f.train_start + g.train_end), (f.fold, g.fold, "test", f.train_start + g.train_end, f.train_start + g.test_end)]
    return out
