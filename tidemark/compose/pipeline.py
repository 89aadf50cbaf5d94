"""Composition: operators in a row, side by side, by column, by vintage, and forecasters on terms of other columns.

Branches meet by an inner join on (keys, time), so that the longest warm-up decides.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.forecasters import Forecaster
from tidemark.operators.base import Operator


@dataclass
class Pipeline(Operator):
    """steps one after the other; each is fitted on what the ones before it give."""

    steps: tuple[Operator, ...] = ()

    def fit(self, df: DataFrame) -> Pipeline:
        self.seen = []  # the value columns that each step was given
        for i, step in enumerate(self.steps):
            self.seen.append(tuple(step.values(df)))
            step.fit(df)
            if i < len(self.steps) - 1:
                df = step.transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda rows, step: step.transform(rows), self.steps, df)

    def inverse_transform(self, df: DataFrame, past: DataFrame | None = None) -> DataFrame:
        """The steps undone, last one first. past: the rows before df as they were, for steps that look back; each step gets
        them as the steps before it left them. A step without an inverse is an error."""
        befores = [past]
        for step in self.steps[:-1]:
            befores.append(befores[-1] if befores[-1] is None else step.transform(befores[-1]))
        for step, before, columns in zip(reversed(self.steps), reversed(befores), reversed(self.seen)):
            if not hasattr(step, "inverse_transform"):
                raise ValueError(f"{type(step).__name__} has no inverse")
            asked = inspect.signature(step.inverse_transform).parameters
            if "past" in asked and before is None:
                raise ValueError(f"{type(step).__name__} needs the rows before")
            df = step.inverse_transform(df, **({"past": before} if "past" in asked else {}) | ({"columns": columns} if "columns" in asked else {}))
        return df


@dataclass
class Union(Operator):
    """Named branches on the same rows; their columns are prefixed with the branch's name and a weight may scale them."""

    branches: dict[str, Operator] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    prefix: bool = True

    def fit(self, df: DataFrame) -> Union:
        for b in self.branches.values():
            b.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        parts = []
        for name, b in self.branches.items():
            out = b.transform(df)
            w = self.weights.get(name, 1.0)
            parts.append(out.select(*self.index(), *((F.col(c) * w if w != 1.0 else F.col(c)).alias(f"{name}__{c}" if self.prefix else c) for c in out.columns if c not in self.index())))
        return reduce(lambda a, b: a.join(b, self.index()), parts)


@dataclass
class ByColumns(Operator):
    """Branches on subsets of columns; the rest is dropped or passed through."""

    branches: tuple[tuple[Operator, tuple[str, ...]], ...] = ()
    remainder: str = "drop"

    def fit(self, df: DataFrame) -> ByColumns:
        self.fitted = [replace(op, columns=columns).fit(df.select(*self.index(), *columns)) for op, columns in self.branches]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        parts = [op.transform(df.select(*self.index(), *columns)) for op, (_, columns) in zip(self.fitted, self.branches)]
        used = {c for _, columns in self.branches for c in columns}
        if self.remainder == "passthrough":
            parts.append(df.select(*self.index(), *(c for c in df.columns if c not in (*self.index(), *used))))
        return reduce(lambda a, b: a.join(b, self.index()), parts)


@dataclass
class PerVintage(Operator):
    """An operator on each vintage by itself: vintage_time becomes one of its keys."""

    inner: Operator = field(default_factory=Operator)

    def fit(self, df: DataFrame) -> PerVintage:
        self.own = replace(self.inner, keys=(*self.keys, "vintage_time")).fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.own.transform(df)


@dataclass
class Combining(Forecaster):
    """Forecasts of several target columns, added or multiplied; a residual model may add what is left of the target."""

    terms: dict[str, Forecaster] = field(default_factory=dict)
    combine: str = "sum"

    def learn(self, df: DataFrame) -> None:
        self.models = {c: replace(m, keys=self.keys, time=self.time, interval=self.interval, target=c).fit(df) for c, m in self.terms.items()}

    def predict(self, horizon: int) -> DataFrame:
        on = [*self.keys, "vintage_time", self.time, "step"]
        parts = [m.predict(horizon).withColumnRenamed("y_hat", f"_{c}") for c, m in self.models.items()]
        rows = reduce(lambda a, b: a.join(b, on), parts)
        value = reduce(lambda a, b: a + b if self.combine == "sum" else a * b, (F.col(f"_{c}") for c in self.models))
        return rows.select(*on, value.alias("y_hat"))


@dataclass
class ByTarget(Forecaster):
    """A forecaster for each target column: (keys, vintage_time, time, step, component, y_hat)."""

    targets: dict[str, Forecaster] = field(default_factory=dict)

    def learn(self, df: DataFrame) -> None:
        self.models = {c: replace(m, keys=self.keys, time=self.time, interval=self.interval, target=c).fit(df) for c, m in self.targets.items()}

    def predict(self, horizon: int) -> DataFrame:
        return reduce(DataFrame.unionByName, (m.predict(horizon).withColumn("component", F.lit(c)) for c, m in self.models.items()))
