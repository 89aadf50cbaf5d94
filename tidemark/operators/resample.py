"""Changing the grid of series, and filling gaps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import Operator, numbered
from tidemark.operators.intervals import Interval


@dataclass
class Downsampler(Operator):
    """One row per series and calendar-aligned bin. closed and label: "left" or "right".

    aggregation: mean, sum, min, max, first, last, median or std.
    """

    interval: str = "1h"
    aggregation: str = "mean"
    closed: str = "left"
    label: str = "left"
    include_boundaries: bool = False

    def _aggregate(self, c: str) -> Column:
        return {
            "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp,
            "first": lambda c: F.min_by(c, self.time), "last": lambda c: F.max_by(c, self.time),
        }[self.aggregation](c).alias(c)

    def transform(self, df: DataFrame) -> DataFrame:
        i = Interval.parse(self.interval)
        at = F.col(self.time) if self.closed == "left" else F.timestamp_add("MICROSECOND", F.lit(-1), F.col(self.time))
        start = i.floor(at)
        out = df.groupBy(*self.keys, start.alias("_start")).agg(*(self._aggregate(c) for c in self.values(df)))
        end = i.after(F.col("_start"), F.lit(1))
        bounds = [F.col("_start").alias("lower_boundary"), end.alias("upper_boundary")] if self.include_boundaries else []
        return out.select(*self.keys, (F.col("_start") if self.label == "left" else end).alias(self.time), *bounds, *self.values(df))


def on_grid(df: DataFrame, interval: str, op: Operator) -> DataFrame:
    """Every stamp from a series' first to its last, with nulls where df has no row."""
    i = Interval.parse(interval)
    ends = df.groupBy(*op.keys).agg(F.min(op.time).alias("_a"), F.max(op.time).alias("_b"))
    steps = F.sequence(F.lit(0), i.between(F.col("_a"), F.col("_b")))
    grid = ends.select(*op.keys, "_a", "_b", F.explode(steps).alias("_k")).select(*op.keys, "_b", i.after(F.col("_a"), F.col("_k")).alias(op.time)).filter(F.col(op.time) <= F.col("_b")).drop("_b")
    return grid.join(df, [*op.keys, op.time], "left")


def _before(c: str, w) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _behind(c: str, w) -> Column:
    """w must run backwards: a frame that ends at the series' end would be read anew for every row."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


@dataclass
class TimeImputer(Operator):
    """Fills nulls: linear (by row, inside only), forward, backward, nearest (by time, ties to the earlier), fill_both.

    limit bounds how far a value is carried, in rows; linear takes no notice of it.
    """

    method: str = "linear"
    limit: int | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        columns = self.values(df)
        w = self.by_time()
        out = numbered(df, self)
        for c in columns:
            out = out.withColumns({f"_r_{c}": F.when(F.col(c).isNotNull(), F.col("_rn")), f"_t_{c}": F.when(F.col(c).isNotNull(), F.col(self.time))})
        back = self.whole().orderBy(F.desc(self.time))
        made = [self._filled(c, w, back).alias(c) for c in columns]
        return out.select(*self.index(), *made)

    def _filled(self, c: str, w, back) -> Column:
        x, rn = F.col(c), F.col("_rn")
        before, behind = _before(c, w), _behind(c, back)
        gap, gap_behind = rn - _before(f"_r_{c}", w), _behind(f"_r_{c}", back) - rn
        if self.limit is not None:
            before, behind = F.when(gap <= self.limit, before), F.when(gap_behind <= self.limit, behind)
        if self.method == "linear":
            return F.when(x.isNotNull(), x.cast("double")).otherwise(_before(c, w) + (_behind(c, back) - _before(c, w)) * gap / F.when(gap + gap_behind > 0, gap + gap_behind))
        if self.method == "forward":
            return before
        if self.method == "backward":
            return behind
        if self.method == "fill_both":
            return F.coalesce(before, behind)
        at = F.unix_micros(F.col(self.time).cast("timestamp"))
        past = at - F.unix_micros(_before(f"_t_{c}", w).cast("timestamp"))
        ahead = F.unix_micros(_behind(f"_t_{c}", back).cast("timestamp")) - at
        return F.when(ahead.isNull() | (past <= ahead), F.coalesce(before, F.when(past.isNull(), behind))).when(past.isNull() | (ahead < past), behind)


@dataclass
class Upsampler(Operator):
    """A regular grid from a series' first to its last stamp, filled by linear, nearest, forward or backward."""

    interval: str = "1h"
    interpolation: str = "linear"

    def transform(self, df: DataFrame) -> DataFrame:
        columns = self.values(df)
        filler = TimeImputer(keys=self.keys, time=self.time, columns=tuple(columns), method=self.interpolation)
        return filler.transform(on_grid(df.select(*self.index(), *columns), self.interval, self))


@dataclass
class SeasonalImputer(Operator):
    """Fills nulls with the mean or median of the value's phase, counted in intervals from the first stamp at fit."""

    seasonality: int = 7
    fill_method: str = "seasonal_mean"
    interval: str = "1d"
    fitted: DataFrame | None = field(default=None, repr=False)

    def _phased(self, df: DataFrame, first: DataFrame) -> DataFrame:
        i = Interval.parse(self.interval)
        return df.join(F.broadcast(first) if not self.keys else first, list(self.keys)).withColumn("_phase", F.pmod(i.between(F.col("_first"), F.col(self.time)), F.lit(self.seasonality)))

    def fit(self, df: DataFrame) -> SeasonalImputer:
        columns = self.values(df)
        self.first = df.groupBy(*self.keys).agg(F.min(self.time).alias("_first"))
        own = F.avg if self.fill_method == "seasonal_mean" else F.median
        self.fitted = self._phased(df, self.first).groupBy(*self.keys, "_phase").agg(*(own(c).alias(f"_f_{c}") for c in columns))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        columns = self.values(df)
        return self._phased(df, self.first).join(self.fitted, [*self.keys, "_phase"], "left").select(*self.index(), *(F.coalesce(c, f"_f_{c}").alias(c) for c in columns))


@dataclass
class SimpleImputer(Operator):
    """Fills nulls of each column with its mean, median, most_frequent (ties: the smallest) or a constant, over all series."""

    strategy: str = "mean"
    fill_value: float = 0.0

    def fit(self, df: DataFrame) -> SimpleImputer:
        columns = self.values(df)
        if self.strategy in ("mean", "median"):
            f = F.avg if self.strategy == "mean" else F.median
            self.fill = df.agg(*(f(c).alias(c) for c in columns)).first().asDict()
        elif self.strategy == "most_frequent":
            self.fill = {c: (r := df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()) and r[0] for c in columns}
        else:
            self.fill = dict.fromkeys(columns, self.fill_value)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.index(), *(F.coalesce(c, F.lit(self.fill[c])).alias(c) for c in self.values(df)))
