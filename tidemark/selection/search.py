"""Fold bounds, cross-validation of forecasters and grid search."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.metrics.scores import POINT, point_score
from tidemark.models.forecasters import Forecaster
from tidemark.operators.base import numbered


@dataclass(frozen=True)
class Fold:
    """Row numbers [train_start, train_end) and [train_end, test_end) of each series."""

    fold: int
    train_start: int
    train_end: int
    test_end: int


def expanding_window(n: int, n_splits: int = 3, test_size: int | None = None, max_train_size: int | None = None) -> list[Fold]:
    """Test blocks at the tail, with all rows before each (at most max_train_size) for training."""
    size = test_size or n // (n_splits + 1)
    ends = [n - (n_splits - i) * size for i in range(n_splits)]
    if size < 1 or ends[0] < 1:
        raise ValueError(f"{n} rows are too few for {n_splits} splits of {size}")
    return [Fold(i, max(0, e - max_train_size) if max_train_size else 0, e, e + size) for i, e in enumerate(ends)]


def sliding_window(n: int, n_splits: int = 3, test_size: int = 10, train_size: int | None = None, stride: int | None = None) -> list[Fold]:
    """A train window of a fixed size, moved by stride, so that the last test block ends at the tail."""
    stride = stride or test_size
    train = train_size or n - test_size - (n_splits - 1) * stride
    ends = [n - test_size - (n_splits - 1 - i) * stride for i in range(n_splits)]
    if train < 1 or ends[0] < train:
        raise ValueError(f"{n} rows are too few")
    return [Fold(i, e - train, e, e + test_size) for i, e in enumerate(ends)]


def fold_rows(df: DataFrame, folds: list[Fold], **options) -> DataFrame:
    """df's rows with (fold, part) for each fold they are in, part being train or test."""
    from tidemark.operators.base import Operator

    rows = numbered(df, Operator(**options))
    bounds = F.array(*(F.struct(*(F.lit(getattr(f, k)).alias(k) for k in ("fold", "train_start", "train_end", "test_end"))) for f in folds))
    rows = rows.withColumn("_f", F.explode(bounds)).filter((F.col("_rn") >= F.col("_f.train_start")) & (F.col("_rn") < F.col("_f.test_end")))
    return rows.withColumns({"fold": F.col("_f.fold"), "part": F.when(F.col("_rn") < F.col("_f.train_end"), "train").otherwise("test")}).drop("_f", "_rn")


def train_test_split(df: DataFrame, test_size: int | float, keys: tuple[str, ...] = ("group",), time: str = "time") -> tuple[DataFrame, DataFrame]:
    """The head and the tail of each series; a float is a share of its rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_b": F.row_number().over(w.orderBy(F.desc(time))), "_n": F.count("*").over(w)})
    cut = F.lit(test_size) if isinstance(test_size, int) else F.ceil(F.col("_n") * test_size)
    return rows.filter(F.col("_b") > cut).drop("_b", "_n"), rows.filter(F.col("_b") <= cut).drop("_b", "_n")


def cross_validate(model: Forecaster, df: DataFrame, folds: list[Fold], metrics: tuple[str, ...] = ("mae",)) -> DataFrame:
    """(fold, metrics): each fold's model is fitted on its train rows, and scored on its test rows. Folds are one lazy union."""
    parts = fold_rows(df, folds, keys=model.keys, time=model.time)
    out = []
    for f in folds:
        fitted = replace(model).fit(parts.filter(f"fold = {f.fold} and part = 'train'").drop("fold", "part"))
        truth = parts.filter(f"fold = {f.fold} and part = 'test'").select(*model.keys, model.time, F.col(model.target).cast("double").alias("y"))
        rows = fitted.predict(f.test_end - f.train_end).join(truth, [*model.keys, model.time]).withColumn("component", F.lit("y"))
        if tuple(model.keys) != ("group",):
            rows = rows.withColumn("group", F.concat_ws("/", *model.keys))
        scores = [point_score(rows, m) for m in metrics]
        out.append(reduce(lambda a, b: a.crossJoin(b), scores).withColumn("fold", F.lit(f.fold)))  # one row each
    return reduce(DataFrame.unionByName, out)


def grid(options: dict[str, list]) -> Iterator[dict]:
    for values in product(*options.values()):
        yield dict(zip(options, values))


def search(model: Forecaster, df: DataFrame, folds: list[Fold], candidates: list[dict], metric: str = "mae") -> DataFrame:
    """(candidate, params, mean, std, rank), the best having rank 1."""
    from pyspark.sql import Window

    parts = [cross_validate(replace(model, **c), df, folds, (metric,)).withColumns({"candidate": F.lit(i), "params": F.lit(str(c))}) for i, c in enumerate(candidates)]
    scores = reduce(DataFrame.unionByName, parts).groupBy("candidate", "params").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    order = F.col("mean") if POINT[metric].lower_is_better else -F.col("mean")
    return scores.withColumn("rank", F.rank().over(Window.orderBy(order)))  # a row for each candidate


def randomized(options: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    every = list(grid(options))
    return random.Random(seed).sample(every, min(n, len(every)))
