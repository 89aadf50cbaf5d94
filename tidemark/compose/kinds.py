"""Kinds of operators, what may be combined, and what the package offers.

An operator works on series (keys, time), on vintages (keys, vintage_time, time) or on step columns ({base}_step_{h}). The
user's own operators derive from one of these classes and need transform() only; segmenters, weighters, splitters,
similarities, estimators and scorers derive from the classes named in `CONTRACTS`.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models.forecasters import Forecaster
from tidemark.operators.base import Operator


@dataclass
class SeriesOperator(Operator):
    """transform(rows by keys and time) -> rows by keys and time; inverse() where it has one."""

    kind = "series"
    horizon: int = 0  # rows it looks back on

    def inverse(self, df: DataFrame, past: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")


@dataclass
class VintageOperator(Operator):
    """transform(rows by keys, vintage_time and time); no memory, as every vintage is whole."""

    kind = "vintage"

    def by_time(self, *more):
        return super().by_time("vintage_time", *more)


@dataclass
class StepOperator(Operator):
    """transform(rows with {base}_step_{h} columns)."""

    kind = "step"
    least_steps: int = 1

    def steps(self, df: DataFrame, base: str) -> list[str]:
        out = sorted((c for c in df.columns if c.startswith(f"{base}_step_") and c.rsplit("_", 1)[1].isdigit()), key=lambda c: int(c.rsplit("_", 1)[1]))
        if len(out) < self.least_steps:
            raise ValueError(f"{base} has {len(out)} steps, {self.least_steps} are needed")
        return out


class Segmenter:
    """labels(time) -> a column of labels, null outside every segment."""

    def labels(self, time: str = "time") -> Column:
        raise NotImplementedError


class Weighter:
    """weights(time) -> a column of weights, checked and scaled by weighted()."""

    def weights(self, time: str = "time") -> Column:
        raise NotImplementedError

    def weighted(self, df: DataFrame, time: str = "time", out: str = "weight") -> DataFrame:
        return validated_weights(df.withColumn(out, self.weights(time)), out)


def validated_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """df; weights that are null, NaN, infinite, negative, or all zero are errors."""
    w = F.col(weight).cast("double")
    bad = F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
    found = df.agg(bad.alias("bad"), F.count_if(w < 0).alias("negative"), F.sum(w).alias("total"), F.count("*").alias("n")).first()
    for name in ("bad", "negative"):
        if found[name]:
            raise ValueError(f"{found[name]} weights are {'no finite numbers' if name == 'bad' else 'negative'}")
    if found["n"] and not found["total"]:
        raise ValueError("all weights are zero")
    return df


def window_weights(df: DataFrame, horizon: int, how: str = "mean", decay: float = 0.5, keys: tuple[str, ...] = ("group",), time: str = "time", weight: str = "weight") -> DataFrame:
    """df with sample_weight: the weight of a training row from those of the `horizon` rows it predicts: first, last, mean, max,
    min, or a mean that decays with the step. Null for rows without a whole horizon."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    ahead = [F.lead(weight, h).over(w) for h in range(1, horizon + 1)]
    if how in ("first", "last"):
        value = ahead[0 if how == "first" else -1]
    elif how in ("max", "min"):
        value = {"max": F.array_max, "min": F.array_min}[how](F.array(*ahead))
    else:
        shares = [decay**h if how == "decay" else 1.0 for h in range(horizon)]
        value = reduce(lambda a, b: a + b, (c * s for c, s in zip(ahead, shares))) / sum(shares)
    return df.withColumn("sample_weight", F.when(ahead[-1].isNotNull(), value))


@dataclass
class Foreign(SeriesOperator):
    """Any estimator or transformer of pyspark.ml on the value columns: they are assembled to a vector, and what comes out is
    given back by column ({c}) where it is as long, else as {prefix}_{i}."""

    stage: object = None
    prefix: str = "out"

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.values(df), outputCol="_in", handleInvalid="keep").transform(df)

    def fit(self, df: DataFrame) -> Foreign:
        own = self.stage.copy({self.stage.inputCol: "_in", self.stage.outputCol: "_out"})
        self.fitted = own.fit(self._vectors(df)) if hasattr(own, "fit") else own
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        columns = self.values(df)
        out = self.fitted.transform(self._vectors(df)).withColumn("_a", vector_to_array("_out"))
        size = len(columns) if not hasattr(self.stage, "getK") else self.stage.getK()
        names = columns if size == len(columns) and not hasattr(self.stage, "getK") else [f"{self.prefix}_{i}" for i in range(size)]
        return out.select(*self.index(), *(F.col("_a")[i].alias(n) for i, n in enumerate(names)))


def kind_of(op: Operator) -> str:
    return getattr(op, "kind", "series")


def common_kind(ops: dict[str, Operator]) -> str:
    """The kind that all have; operators of different kinds do not combine."""
    kinds = {n: kind_of(o) for n, o in ops.items()}
    if len({*kinds.values()}) > 1:
        raise ValueError(f"operators of different kinds: {kinds}")
    return next(iter(kinds.values()), "series")


def check_homogeneous_kinds(ops: dict[str, Operator], composer: str) -> None:
    try:
        common_kind(ops)
    except ValueError as e:
        raise ValueError(f"{composer}: {e}") from None


def contracts() -> dict[str, type]:
    """The classes that the user's own parts derive from."""
    from tidemark.metrics.conformity import QuantileConformity
    from tidemark.models.exogenous import Estimator, Similarity
    from tidemark.selection.validation import EarlyStopping, Splitter

    return {"series operator": SeriesOperator, "vintage operator": VintageOperator, "step operator": StepOperator, "forecaster": Forecaster, "segmenter": Segmenter, "weighter": Weighter, "splitter": Splitter, "similarity": Similarity, "estimator": Estimator, "conformity": QuantileConformity, "early stopping": EarlyStopping}


def discovered(base: type = Operator) -> dict[str, type]:
    """All classes of the library (its training-data part aside) that derive from base, by name, with the kind as `kind`."""
    import tidemark

    out = {}
    for m in pkgutil.walk_packages(tidemark.__path__, "tidemark."):
        if ".llm" in m.name or ".plans" in m.name:
            continue
        for name, c in inspect.getmembers(importlib.import_module(m.name), inspect.isclass):
            if issubclass(c, base) and c.__module__ == m.name:
                out[name] = c
    return out
