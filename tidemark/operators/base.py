"""The shape that all operators share: long panel tables keyed by (group keys, time).

A table has one row per group and time stamp; its order is a property of windows, never of storage. Operators are lazy
DataFrame to DataFrame functions; `fit` collects at most a few scalars, or keeps a small lazy table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


@dataclass(kw_only=True)
class Operator:
    """keys: the columns that name a series. columns: the value columns, all numeric ones but keys where None."""

    keys: tuple[str, ...] = ("group",)
    time: str = "time"
    columns: tuple[str, ...] | None = None

    def values(self, df: DataFrame) -> list[str]:
        if self.columns is not None:
            return list(self.columns)
        return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in (*self.keys, self.time)]

    def index(self) -> list[str]:
        return [*self.keys, self.time]

    def by_time(self, *more) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(self.time)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def fit(self, df: DataFrame) -> Operator:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def numbered(df: DataFrame, op: Operator, name: str = "_rn") -> DataFrame:
    """df with the row's place in its series, from 0."""
    return df.withColumn(name, F.row_number().over(op.by_time()) - 1)
