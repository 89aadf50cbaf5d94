"""Column scalers over all series. Fitting is one aggregate; what it gives is a few numbers a column."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.base import Operator


@dataclass
class Scaler(Operator):
    def learn(self, c: str) -> dict[str, Column]:
        return {}

    def fit(self, df: DataFrame) -> Scaler:
        columns = self.values(df)
        wanted = {f"{c}|{k}": v for c in columns for k, v in self.learn(c).items()}
        row = df.agg(*(v.alias(k) for k, v in wanted.items())).first().asDict() if wanted else {}
        self.learned = {c: {k.split("|")[1]: v for k, v in row.items() if k.split("|")[0] == c} for c in columns}
        return self

    def scaled(self, c: str, s: dict) -> Column:
        raise NotImplementedError

    def restored(self, c: str, s: dict) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.index(), *(self.scaled(c, s).alias(c) for c, s in self.learned.items()))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.index(), *(self.restored(c, s).alias(c) for c, s in self.learned.items()))


@dataclass
class AffineScaler(Scaler):
    """(x - shift) / unit; a unit of 0 counts as 1."""

    def affine(self, s: dict) -> tuple[float, float]:
        raise NotImplementedError

    def _numbers(self, s: dict) -> tuple[float, float]:
        shift, unit = self.affine(s)
        return float(shift or 0.0), float(unit or 1.0)

    def scaled(self, c: str, s: dict) -> Column:
        shift, unit = self._numbers(s)
        return (F.col(c) - shift) / unit

    def restored(self, c: str, s: dict) -> Column:
        shift, unit = self._numbers(s)
        return F.col(c) * unit + shift


@dataclass
class StandardScaler(AffineScaler):
    """Mean 0 and population standard deviation 1."""

    with_mean: bool = True
    with_std: bool = True

    def learn(self, c: str) -> dict[str, Column]:
        return {"mean": F.avg(c), "std": F.stddev_pop(c)}

    def affine(self, s: dict) -> tuple[float, float]:
        return s["mean"] if self.with_mean else 0.0, s["std"] if self.with_std else 1.0


@dataclass
class MinMaxScaler(AffineScaler):
    """To feature_range; clip holds unseen values inside it."""

    feature_range: tuple[float, float] = (0.0, 1.0)
    clip: bool = False

    def learn(self, c: str) -> dict[str, Column]:
        return {"min": F.min(c).cast("double"), "max": F.max(c).cast("double")}

    def affine(self, s: dict) -> tuple[float, float]:
        low, high = self.feature_range
        unit = ((s["max"] - s["min"]) or 1.0) / (high - low)
        return s["min"] - low * unit, unit

    def scaled(self, c: str, s: dict) -> Column:
        out = super().scaled(c, s)
        return F.when(out.isNotNull(), F.greatest(F.lit(self.feature_range[0]), F.least(F.lit(self.feature_range[1]), out))) if self.clip else out


@dataclass
class RobustScaler(AffineScaler):
    """Median 0, and 1 between two percentiles."""

    quantile_range: tuple[float, float] = (25.0, 75.0)

    def learn(self, c: str) -> dict[str, Column]:
        return {"mid": F.median(c), "lo": F.percentile(c, F.lit(self.quantile_range[0] / 100)), "hi": F.percentile(c, F.lit(self.quantile_range[1] / 100))}

    def affine(self, s: dict) -> tuple[float, float]:
        return s["mid"], s["hi"] - s["lo"]


@dataclass
class MaxAbsScaler(AffineScaler):
    """The largest magnitude becomes 1."""

    def learn(self, c: str) -> dict[str, Column]:
        return {"max": F.max(F.abs(c)).cast("double")}

    def affine(self, s: dict) -> tuple[float, float]:
        return 0.0, s["max"]


@dataclass
class Normalizer(Operator):
    """Each row to norm 1 (l1, l2 or max); rows of zeros stay."""

    norm: str = "l2"

    def transform(self, df: DataFrame) -> DataFrame:
        columns = self.values(df)
        total = None
        for c in columns:
            one = F.col(c) * F.col(c) if self.norm == "l2" else F.abs(c)
            total = one if total is None else F.greatest(total, one) if self.norm == "max" else total + one
        size = F.sqrt(total) if self.norm == "l2" else total
        return df.select(*self.index(), *((F.col(c) / F.when(size == 0, 1.0).otherwise(size)).alias(c) for c in columns))


@dataclass
class PolynomialFeatures(Operator):
    """Monomials up to a degree, named like "1", "a", "a b", "a^2"."""

    degree: int = 2
    interaction_only: bool = False
    include_bias: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        columns, made = self.values(df), []
        pick = combinations if self.interaction_only else combinations_with_replacement
        for d in range(0 if self.include_bias else 1, self.degree + 1):
            for part in pick(columns, d):
                value = F.lit(1.0)
                for c in part:
                    value = value * F.col(c)
                name = " ".join(c if part.count(c) == 1 else f"{c}^{part.count(c)}" for c in dict.fromkeys(part)) or "1"
                made.append(value.alias(name))
        return df.select(*self.index(), *made)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The standard normal quantile by bisection on the distribution function: to 1e-12, for whole arrays at once."""
    low, high = np.full(p.shape, -9.0), np.full(p.shape, 9.0)
    erf = np.vectorize(math.erf, otypes=[float])
    for _ in range(64):
        mid = (low + high) / 2
        less = 0.5 * (1 + erf(mid / math.sqrt(2))) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


@dataclass
class QuantileTransformer(Scaler):
    """The empirical distribution function, by linear interpolation between n_quantiles percentiles (at most as many as there
    are values); a run of equal percentiles counts as its middle. output "normal": its normal quantile, cut at 1e-7 from the
    ends. Values are looked up in Arrow batches, by a binary search each."""

    n_quantiles: int = 1000
    output: str = "uniform"

    def fit(self, df: DataFrame) -> QuantileTransformer:
        self.learned = {}
        for c in self.values(df):
            n = max(2, min(self.n_quantiles, df.agg(F.count(c)).first()[0]))
            self.learned[c] = {"knots": df.agg(F.percentile(c, F.array(*(F.lit(i / (n - 1)) for i in range(n))))).first()[0] or []}
        return self

    def scaled(self, c: str, s: dict) -> Column:
        knots, normal = np.asarray(s["knots"], float), self.output == "normal"
        if not len(knots):
            return F.lit(None).cast("double")
        levels = np.linspace(0, 1, len(knots))
        ends = normal_quantile(np.array([1e-7, 1 - 1e-7]))
        table = normal_quantile(np.clip(np.linspace(0, 1, 4097), 1e-7, 1 - 1e-7)) if normal else None

        @F.pandas_udf("double")
        def looked_up(x: pd.Series) -> pd.Series:
            v = x.to_numpy(float)
            p = (np.interp(v, knots, levels) - np.interp(-v, -knots[::-1], -levels[::-1])) / 2
            p = np.where(np.isnan(v), np.nan, p)
            if normal:
                few, at = np.unique(p, return_inverse=True)
                p = (normal_quantile(np.clip(few, 1e-7, 1 - 1e-7)) if len(few) < 50_000 else np.interp(few, np.linspace(0, 1, 4097), table))[at].clip(*ends)
                p = np.where(np.isnan(v), np.nan, p)
            return pd.Series(p).where(~x.isna().reset_index(drop=True), None)

        return looked_up(F.col(c).cast("double"))


@dataclass
class PowerTransformer(Scaler):
    """Yeo-Johnson, or Box-Cox for positive values, with the exponent of the largest likelihood on a grid refined to 1e-6, then
    mean 0 and deviation 1."""

    method: str = "yeo-johnson"

    def curve(self, x: Column, p: float) -> Column:
        if self.method == "box-cox":
            return F.log(x) if abs(p) < 1e-12 else (F.pow(x, F.lit(p)) - 1) / p
        up = F.log1p(x) if abs(p) < 1e-12 else (F.pow(x + 1, F.lit(p)) - 1) / p
        down = -F.log1p(-x) if abs(p - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - p)) - 1) / (2 - p)
        return F.when(x >= 0, up).otherwise(down)

    def fit(self, df: DataFrame) -> PowerTransformer:
        self.learned = {}
        for c in self.values(df):
            x = F.col(c).cast("double")
            if self.method == "box-cox" and (df.agg(F.min(x)).first()[0] or 1) <= 0:
                raise ValueError(f"{c} has values that are not positive")
            slope = F.log(x) if self.method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
            low, high = -3.0, 5.0
            for _ in range(8):  # each pass asks for 17 exponents in one aggregate, and narrows the range eightfold
                grid = [low + (high - low) * i / 16 for i in range(17)]
                row = df.agg(F.count(c).alias("n"), F.sum(slope).alias("s"), *(F.var_pop(self.curve(x, p)).alias(f"v{i}") for i, p in enumerate(grid))).first()
                score = [(p - 1) * (row["s"] or 0) - row["n"] / 2 * math.log(row[f"v{i}"]) if row[f"v{i}"] else -math.inf for i, p in enumerate(grid)]
                best = score.index(max(score))
                low, high = grid[max(0, best - 1)], grid[min(16, best + 1)]
            p = grid[best]
            mean, std = df.agg(F.avg(self.curve(x, p)), F.stddev_pop(self.curve(x, p))).first()
            self.learned[c] = {"p": p, "mean": mean or 0.0, "std": std or 1.0}
        return self

    def scaled(self, c: str, s: dict) -> Column:
        return (self.curve(F.col(c).cast("double"), s["p"]) - s["mean"]) / s["std"]


@dataclass
class SplineTransformer(Scaler):
    """B-spline basis {c}_sp_{i} by the Cox-de Boor recursion; constant outside. knots: "uniform" between a column's ends, or
    "quantile", at its percentiles; beyond the ends they go on with the outermost distance."""

    n_knots: int = 5
    degree: int = 3
    knots: str = "uniform"

    def learn(self, c: str) -> dict[str, Column]:
        if self.knots == "quantile":
            return {"at": F.percentile(c, F.array(*(F.lit(i / (self.n_knots - 1)) for i in range(self.n_knots))))}
        return {"min": F.min(c).cast("double"), "max": F.max(c).cast("double")}

    def transform(self, df: DataFrame) -> DataFrame:
        made, k = [], self.degree
        for c, s in self.learned.items():
            if "at" in s:
                inner = [float(v) for v in s["at"]]
            else:
                step = (s["max"] - s["min"]) / (self.n_knots - 1) or 1.0
                inner = [s["min"] + step * i for i in range(self.n_knots)]
            first, end = inner[1] - inner[0], inner[-1] - inner[-2]
            at = [inner[0] - first * i for i in range(k, 0, -1)] + inner + [inner[-1] + end * i for i in range(1, k + 1)]
            x = F.greatest(F.lit(inner[0]), F.least(F.lit(inner[-1]), F.col(c).cast("double")))
            last = max(i for i in range(k, k + self.n_knots - 1) if at[i] < at[i + 1] or i == k)
            basis = [F.when((x >= a) & ((x < b) | F.lit(i == last)), 1.0).otherwise(0.0) if i <= last else F.lit(0.0) for i, (a, b) in enumerate(zip(at, at[1:]))]
            for d in range(1, k + 1):
                share = lambda i, d=d: (x - at[i]) / (at[i + d] - at[i]) if at[i + d] > at[i] else F.lit(0.0)
                rest = lambda i, d=d: (at[i + d + 1] - x) / (at[i + d + 1] - at[i + 1]) if at[i + d + 1] > at[i + 1] else F.lit(0.0)
                basis = [share(i) * basis[i] + rest(i) * basis[i + 1] for i in range(len(basis) - 1)]
            made += [b.alias(f"{c}_sp_{i}") for i, b in enumerate(basis)]
        return df.select(*self.index(), *made)
