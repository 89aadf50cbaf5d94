"""Features of the time stamp, arithmetic between columns, segments, outlier bounds and row weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.base import Operator
from tidemark.operators.intervals import Interval


def _flag(c: Column) -> Column:
    return c.cast("int")


#: The calendar fields of a time stamp, as integers; weeks and week days are ISO.
CALENDAR: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "week": F.weekofyear,
    "day_of_week": lambda t: F.weekday(t) + 1,
    "day_of_month": F.dayofmonth,
    "day_of_year": F.dayofyear,
    "hour": F.hour,
    "minute": F.minute,
    "quarter": F.quarter,
    "is_weekend": lambda t: _flag(F.weekday(t) >= 5),
    "is_month_start": lambda t: _flag(F.dayofmonth(t) == 1),
    "is_month_end": lambda t: _flag(F.to_date(t) == F.last_day(t)),
    "is_quarter_start": lambda t: _flag((F.month(t) % 3 == 1) & (F.dayofmonth(t) == 1)),
    "is_quarter_end": lambda t: _flag((F.month(t) % 3 == 0) & (F.to_date(t) == F.last_day(t))),
    "is_year_start": lambda t: _flag(F.dayofyear(t) == 1),
    "is_year_end": lambda t: _flag((F.month(t) == 12) & (F.dayofmonth(t) == 31)),
}


def local(t: Column, zone: str | None) -> Column:
    """UTC stamps as wall-clock stamps of a zone."""
    return t if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), t.cast("timestamp_ntz"))


@dataclass
class CalendarFeatures(Operator):
    """cal_{field} for each field; time_zone moves the clock for the fields only."""

    features: tuple[str, ...] = tuple(CALENDAR)
    time_zone: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        t = local(F.col(self.time), self.time_zone)
        return df.select(*self.index(), *(CALENDAR[f](t).cast("int").alias(f"cal_{f}") for f in self.features))


@dataclass
class HolidayFeatures(Operator):
    """is_holiday, and days to the next and since the last date of a list (null outside it)."""

    holidays: tuple[date, ...] = ()
    days_to_next: bool = True
    days_since_last: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        day = F.to_date(self.time)
        dates = F.array(*(F.lit(d) for d in sorted(self.holidays))).cast("array<date>")
        made = [_flag(F.array_contains(dates, day)).alias("holiday_indicator")]
        if self.days_to_next:
            made.append(F.datediff(F.array_min(F.filter(dates, lambda d: d >= day)), day).alias("holiday_days_to_next"))
        if self.days_since_last:
            made.append(F.datediff(day, F.array_max(F.filter(dates, lambda d: d <= day))).alias("holiday_days_since_last"))
        return df.select(*self.index(), *made)


@dataclass
class DaylightSaving(Operator):
    """dst_in_effect, dst_transition_day and dst_transition_type (1 forward, -1 back, 0 none) of a zone, for UTC stamps."""

    time_zone: str = "America/Chicago"

    def transform(self, df: DataFrame) -> DataFrame:
        def offset(t: Column) -> Column:
            return F.timestamp_diff("MINUTE", t, local(t, self.time_zone))

        t = F.col(self.time)
        day = F.date_trunc("day", local(t, self.time_zone)).cast("timestamp_ntz")
        winter = F.make_timestamp_ntz(F.year(day), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        summer = F.make_timestamp_ntz(F.year(day), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        standard = F.least(offset(winter), offset(summer))
        utc = F.convert_timezone(F.lit(self.time_zone), F.lit("UTC"), day)
        next_utc = F.convert_timezone(F.lit(self.time_zone), F.lit("UTC"), F.timestamp_add("DAY", F.lit(1), day))
        change = F.signum(offset(next_utc) - offset(utc)).cast("int")
        return df.select(*self.index(), _flag(offset(t) > standard).alias("dst_in_effect"), _flag(change != 0).alias("dst_transition_day"), change.alias("dst_transition_type"))


@dataclass
class TimeIndex(Operator):
    """time_index, and its powers time_index_{d}: intervals since the first stamp of all series; normalised by n - 1 on request."""

    interval: str = "1d"
    degree: int = 1
    normalize: bool = False

    def fit(self, df: DataFrame) -> TimeIndex:
        i = Interval.parse(self.interval)
        self.origin, last = df.agg(F.min(self.time), F.max(self.time)).first()
        self.length = df.sparkSession.range(1).select(i.between(F.lit(self.origin), F.lit(last))).first()[0]
        return self

    def index_of(self, t: Column) -> Column:
        at = Interval.parse(self.interval).between(F.lit(self.origin), t).cast("double")
        return at / max(1, self.length) if self.normalize else at

    def transform(self, df: DataFrame) -> DataFrame:
        t = self.index_of(F.col(self.time))
        return df.select(*self.index(), *(F.pow(t, F.lit(float(d))).alias("time_index" if d == 1 else f"time_index_{d}") for d in range(1, self.degree + 1)))


@dataclass
class FourierFeatures(TimeIndex):
    """fourier_{s}_sin_{k} and _cos_{k} of the elapsed intervals; harmonics above half the seasonality are an error."""

    seasonality: float = 7.0
    harmonics: tuple[int, ...] = (1,)

    def transform(self, df: DataFrame) -> DataFrame:
        if max(self.harmonics) > self.seasonality / 2:
            raise ValueError("a harmonic is above half the seasonality")
        t, s = Interval.parse(self.interval).between(F.lit(self.origin), F.col(self.time)), self.seasonality
        angle = lambda k: F.lit(2.0 * k) * F.pi() * t / s
        return df.select(*self.index(), *(f(angle(k)).alias(f"fourier_{s:g}_{name}_{k}") for k in self.harmonics for name, f in (("sin", F.sin), ("cos", F.cos))))


@dataclass
class Arithmetic(Operator):
    """output = left op right, op one of add, sub, mul, div (null for a division by zero)."""

    left: str = ""
    right: str = ""
    op: str = "add"
    output: str = "arithmetic"
    keep_inputs: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        a, b = F.col(self.left), F.col(self.right)
        value = {"add": a + b, "sub": a - b, "mul": a * b, "div": F.try_divide(a, b)}[self.op]
        return df.select(*self.index(), *([self.left, self.right] if self.keep_inputs else []), value.alias(self.output))

    def inverse_transform(self, df: DataFrame, known: str) -> DataFrame:
        """The other input, from output and the known one."""
        y, k = F.col(self.output), F.col(known)
        other = self.right if known == self.left else self.left
        if known == self.right:
            value = {"add": y - k, "sub": y + k, "mul": F.try_divide(y, k), "div": y * k}[self.op]
        else:
            value = {"add": y - k, "sub": k - y, "mul": F.try_divide(y, k), "div": F.try_divide(k, y)}[self.op]
        return df.select(*self.index(), known, value.alias(other))


@dataclass
class Reduce(Operator):
    """output = the sum or product of columns; null if any is null."""

    inputs: tuple[str, ...] = ()
    op: str = "sum"
    output: str = "reduce"
    keep_inputs: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        value = F.col(self.inputs[0])
        for c in self.inputs[1:]:
            value = value + F.col(c) if self.op == "sum" else value * F.col(c)
        return df.select(*self.index(), *(self.inputs if self.keep_inputs else ()), value.alias(self.output))


# --- segments: labels of time stamps, null outside ---------------------------------------------------------------

Segment = Callable[[Column], Column]


def calendar_segment(feature: str, values: tuple[int, ...] | None = None, time_zone: str | None = None) -> Segment:
    """The calendar field's value, null where it is not among values."""

    def label(t: Column) -> Column:
        own = CALENDAR[feature](local(t, time_zone)).cast("int")
        return own if values is None else F.when(own.isin(*values), own)

    return label


def intersection(*segments: Segment) -> Segment:
    """A struct of labels where all are there."""
    return lambda t: F.when(_all(s(t).isNotNull() for s in segments), F.struct(*(s(t).alias(f"s{i}") for i, s in enumerate(segments))))


def union(*segments: Segment) -> Segment:
    """A struct of labels where any is there."""
    return lambda t: F.when(F.coalesce(*(F.when(s(t).isNotNull(), True) for s in segments)), F.struct(*(s(t).alias(f"s{i}") for i, s in enumerate(segments))))


def complement(segment: Segment) -> Segment:
    """True where the segment has no label."""
    return lambda t: F.when(segment(t).isNull(), True)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# --- outliers ----------------------------------------------------------------------------------------------------


def bounded(x: Column, low: Column | float | None, high: Column | float | None, strategy: str = "clip") -> Column:
    """x clipped to [low, high], or null outside; null stays null."""
    as_column = lambda v: None if v is None else v if isinstance(v, Column) else F.lit(float(v))
    low, high, out = as_column(low), as_column(high), x
    if low is not None:
        out = F.when(x < low, low if strategy == "clip" else None).otherwise(out)
    if high is not None:
        out = F.when(x > high, high if strategy == "clip" else None).otherwise(out)
    return F.when(x.isNotNull(), out)


@dataclass
class OutlierThreshold(Operator):
    """Values outside [low, high] are clipped or made null; with a segment only inside it."""

    low: float | None = None
    high: float | None = None
    strategy: str = "clip"
    segment: Segment | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        inside = F.lit(True) if self.segment is None else self.segment(F.col(self.time)).isNotNull()
        return df.select(*self.index(), *(F.when(inside, bounded(F.col(c), self.low, self.high, self.strategy)).otherwise(F.col(c)).alias(c) for c in self.values(df)))


@dataclass
class OutlierPercentile(Operator):
    """Bounds are percentiles (linear) at fit: pooled over each series, or per segment label with at least min_samples rows."""

    low: float | None = None
    high: float | None = None
    strategy: str = "clip"
    segment: Segment | None = None
    by_segment: bool = False
    min_samples: int = 30
    fitted: DataFrame | None = field(default=None, repr=False)

    def _bounds(self, columns: list[str], tag: str) -> list[Column]:
        return [F.percentile(c, F.lit(q / 100)).alias(f"_{name}_{c}{tag}") for c in columns for name, q in (("low", self.low), ("high", self.high)) if q is not None]

    def fit(self, df: DataFrame) -> OutlierPercentile:
        columns = self.values(df)
        rows = df if self.segment is None else df.withColumn("_label", self.segment(F.col(self.time))).filter("_label is not null")
        self.fitted = rows.groupBy(*self.keys).agg(*self._bounds(columns, ""))
        self.labelled = rows.groupBy(*self.keys, "_label").agg(F.count("*").alias("_n"), *self._bounds(columns, "_own")).filter(F.col("_n") >= self.min_samples).drop("_n") if self.by_segment else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        columns = self.values(df)
        label = F.lit(1) if self.segment is None else self.segment(F.col(self.time))
        rows = df.withColumn("_label", label).join(self.fitted, list(self.keys), "left")
        if self.labelled is not None:
            rows = rows.join(self.labelled, [*self.keys, "_label"], "left")

        def bound(name: str, c: str, q: float | None) -> Column | None:
            if q is None:
                return None
            return F.coalesce(f"_{name}_{c}_own", f"_{name}_{c}") if self.labelled is not None else F.col(f"_{name}_{c}")

        return rows.select(*self.index(), *(F.when(F.col("_label").isNotNull(), bounded(F.col(c), bound("low", c, self.low), bound("high", c, self.high), self.strategy)).otherwise(F.col(c)).alias(c) for c in columns))


# --- weights -----------------------------------------------------------------------------------------------------


@dataclass
class Weights(Operator):
    """A weight column from the row's key. normalise scales each series to mean 1."""

    output: str = "weight"
    normalise: bool = False

    def weight(self) -> Column:
        raise NotImplementedError

    def rank(self) -> Column:
        return F.row_number().over(self.by_time())

    def count(self) -> Column:
        return F.count("*").over(self.whole())

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn(self.output, self.weight())
        return out.withColumn(self.output, normalised(F.col(self.output), self)) if self.normalise else out


def normalised(weight: Column, op: Operator) -> Column:
    """Weights of a series scaled to mean 1."""
    return weight * F.count("*").over(op.whole()) / F.sum(weight).over(op.whole())


@dataclass
class ExponentialDecay(Weights):
    """2 ** -(distance / half_life); distance: days to the last stamp (scale "elapsed"), or ranks ("position")."""

    half_life: float = 1.0
    scale: str = "elapsed"

    def weight(self) -> Column:
        if self.scale == "position":
            distance = (self.count() - self.rank()).cast("double")
        else:
            t = F.unix_micros(F.col(self.time).cast("timestamp"))
            distance = (F.max(t).over(self.whole()) - t) / 86_400_000_000.0
        return F.pow(F.lit(2.0), -distance / self.half_life)


@dataclass
class LinearDecay(Weights):
    """A ramp by rank, ending at 1; with a window rows before it weigh 0."""

    window_size: int | None = None

    def weight(self) -> Column:
        if self.window_size is None:
            return self.rank() / self.count()
        cut = self.count() - self.window_size
        return F.when(self.rank() > cut, (self.rank() - cut) / F.least(F.lit(self.window_size), self.count())).otherwise(0.0)


@dataclass
class SeasonalEmphasis(Weights):
    """emphasis for rows in the last row's phase, 1 for others."""

    seasonality: int = 7
    emphasis: float = 2.0

    def weight(self) -> Column:
        return F.when((self.count() - self.rank()) % self.seasonality == 0, float(self.emphasis)).otherwise(1.0)


@dataclass
class SegmentWeights(Weights):
    """inside where a segment has a label, outside elsewhere."""

    segment: Segment | None = None
    inside: float = 1.0
    outside: float = 0.0

    def weight(self) -> Column:
        return F.when(self.segment(F.col(self.time)).isNotNull(), float(self.inside)).otherwise(float(self.outside))


@dataclass
class LookupWeights(Weights):
    """The weight of a column's value in a mapping; "*" or default for others."""

    column: str = "group"
    mapping: dict | None = None
    default: float = 1.0

    def weight(self) -> Column:
        known = {k: v for k, v in (self.mapping or {}).items() if k != "*"}
        other = float((self.mapping or {}).get("*", self.default))
        if not known:
            return F.lit(other)
        table = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, float(v))))
        return F.coalesce(F.try_element_at(table, F.col(self.column)), F.lit(other))


@dataclass
class CompositeWeights(Weights):
    """The product of weights to given powers, or their weighted mean."""

    parts: tuple[Weights, ...] = ()
    combination: str = "multiply"
    powers: tuple[float, ...] | None = None

    def weight(self) -> Column:
        powers = self.powers or (1.0,) * len(self.parts)
        out = None
        for p, a in zip(self.parts, powers):
            one = F.pow(p.weight(), F.lit(float(a))) if self.combination == "multiply" else p.weight() * a
            out = one if out is None else out * one if self.combination == "multiply" else out + one
        return out if self.combination == "multiply" else out / sum(powers)


def table_weights(df: DataFrame, weights: DataFrame, on: list[str], column: str = "weight") -> DataFrame:
    """df with the weights of a keyed table; a key without weight makes the query fail when it runs."""
    joined = df.join(weights, on, "left")
    return joined.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit("a key has no weight")).cast("double")))
