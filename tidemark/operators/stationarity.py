"""Differences, returns and value transforms with their inverses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import Operator, numbered


@dataclass
class SeasonalDifferencing(Operator):
    """diff_{s}_{c} = x_t - x_{t-s}; the first s rows are dropped."""

    seasonality: int = 1
    prefix: str = "diff"

    def name(self, c: str) -> str:
        return f"{self.prefix}_{self.seasonality}_{c}"

    def forward(self, x: Column, before: Column) -> Column:
        return x - before

    def transform(self, df: DataFrame) -> DataFrame:
        w = self.by_time()
        out = numbered(df, self).select(*self.index(), *(self.forward(F.col(c), F.lag(c, self.seasonality).over(w)).alias(self.name(c)) for c in self.values(df)), "_rn")
        return out.filter(F.col("_rn") >= self.seasonality).drop("_rn")

    def inverse_transform(self, changed: DataFrame, past: DataFrame) -> DataFrame:
        """Values again, from what transform() gave and the rows before it (of df's own columns), of which the last s count.

        Each phase is a prefix sum, so no recursion is needed.
        """
        columns = self.values(past)
        last = Window.partitionBy(*self.keys).orderBy(F.desc(self.time))
        past = past.withColumn("_back", F.row_number().over(last)).filter(F.col("_back") <= self.seasonality).drop("_back")
        seed = past.select(*self.index(), *(F.col(c).cast("double").alias(c) for c in columns), F.lit(True).alias("_seed"))
        both = numbered(seed.unionByName(changed.select(*self.index(), *(F.col(self.name(c)).alias(c) for c in columns), F.lit(False).alias("_seed"))), self)
        w = Window.partitionBy(*self.keys, "_phase").orderBy(self.time).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_phase", F.col("_rn") % self.seasonality)
        return both.select(*self.index(), *(self.restored(c, w).alias(c) for c in columns), "_seed").filter("not _seed").drop("_seed")

    def restored(self, c: str, w) -> Column:
        return F.sum(c).over(w)


@dataclass
class AbsoluteSeasonalReturn(SeasonalDifferencing):
    """abs_return_{s}_{c}: a seasonal difference by another name."""

    prefix: str = "abs_return"


@dataclass
class SeasonalLogDifferencing(SeasonalDifferencing):
    """The seasonal difference of log(x + offset)."""

    offset: float = 0.0
    prefix: str = "log_diff"

    def forward(self, x: Column, before: Column) -> Column:
        return F.log(x + self.offset) - F.log(before + self.offset)

    def restored(self, c: str, w) -> Column:
        logs = F.when(F.col("_seed"), F.log(F.col(c) + self.offset)).otherwise(F.col(c))
        return F.exp(F.sum(logs).over(w)) - self.offset


@dataclass
class SeasonalReturn(SeasonalDifferencing):
    """return_{s}_{c} = (x + o) / (lag_s(x) + o) - 1; null where the divisor is 0."""

    offset: float = 0.0
    prefix: str = "return"

    def forward(self, x: Column, before: Column) -> Column:
        return F.try_divide(x + self.offset, before + self.offset) - 1

    def restored(self, c: str, w) -> Column:
        factors = F.collect_list(F.when(F.col("_seed"), F.col(c) + self.offset).otherwise(1 + F.col(c))).over(w)
        return F.aggregate(factors, F.lit(1.0), lambda s, x: s * x) - self.offset


@dataclass
class ValueTransform(Operator):
    """{name}_{c} for each value column."""

    def renamed(self, c: str) -> str:
        raise NotImplementedError

    def forward(self, c: str) -> Column:
        raise NotImplementedError

    def backward(self, c: str) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.index(), *(self.forward(c).alias(self.renamed(c)) for c in self.values(df)))

    def inverse_transform(self, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return df.select(*self.index(), *(self.backward(c).alias(c) for c in columns))


@dataclass
class Log(ValueTransform):
    """log(x + offset); null where that is not positive."""

    offset: float = 0.0

    def renamed(self, c: str) -> str:
        return f"log_{self.offset:g}_{c}"

    def forward(self, c: str) -> Column:
        return F.log(F.col(c) + self.offset)

    def backward(self, c: str) -> Column:
        return F.exp(self.renamed(c)) - self.offset


@dataclass
class BoxCox(ValueTransform):
    """((x + o)^l - 1) / l, the logarithm for l = 0."""

    lmbda: float = 0.0
    offset: float = 0.0

    def renamed(self, c: str) -> str:
        return f"boxcox_{self.lmbda:g}_{c}"

    def forward(self, c: str) -> Column:
        x = F.col(c) + self.offset
        return F.log(x) if self.lmbda == 0 else (F.pow(x, F.lit(self.lmbda)) - 1) / self.lmbda

    def backward(self, c: str) -> Column:
        y = F.col(self.renamed(c))
        return (F.exp(y) if self.lmbda == 0 else F.pow(y * self.lmbda + 1, F.lit(1 / self.lmbda))) - self.offset


@dataclass
class ASinh(ValueTransform):
    """asinh((x - median) / (scale * MAD)) with the median and MAD of each series at fit; a MAD of 0 counts as 1."""

    scale: float = 1.4826
    fitted: DataFrame | None = field(default=None, repr=False)

    def renamed(self, c: str) -> str:
        return f"asinh_{c}"

    def fit(self, df: DataFrame) -> ASinh:
        columns = self.values(df)
        middle = df.groupBy(*self.keys).agg(*(F.median(c).alias(f"_m_{c}") for c in columns))
        spread = df.join(middle, list(self.keys)).groupBy(*self.keys).agg(*(F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in columns))
        self.fitted = middle.join(spread, list(self.keys))
        return self

    def _unit(self, c: str) -> Column:
        return self.scale * F.when(F.col(f"_d_{c}") == 0, 1.0).otherwise(F.col(f"_d_{c}"))

    def forward(self, c: str) -> Column:
        return F.asinh((F.col(c) - F.col(f"_m_{c}")) / self._unit(c))

    def backward(self, c: str) -> Column:
        return F.sinh(self.renamed(c)) * self._unit(c) + F.col(f"_m_{c}")

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.fitted, list(self.keys))
        return joined.select(*self.index(), *(self.forward(c).alias(self.renamed(c)) for c in self.values(df)))

    def inverse_transform(self, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return super().inverse_transform(df.join(self.fitted, list(self.keys)), columns)
