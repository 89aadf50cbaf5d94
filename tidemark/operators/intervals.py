"""Interval strings, and arithmetic on them.

An interval is a number and a unit: us, ms, s, min or m, h, d, w (fixed), mo, q, y (calendar, clamped to month ends).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PATTERN = re.compile(r"(\d+)(mo|min|ms|us|q|y|w|d|h|m|s)")
_SECONDS = {"us": 1e-6, "ms": 1e-3, "s": 1, "min": 60, "h": 3600, "d": 86400, "w": 604800}
_MONTHS = {"mo": 1, "q": 3, "y": 12}
_SPARK = {"us": "MICROSECOND", "ms": "MILLISECOND", "s": "SECOND", "min": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "mo": "MONTH", "q": "QUARTER", "y": "YEAR"}


@dataclass(frozen=True)
class Interval:
    n: int
    unit: str

    @staticmethod
    def parse(text: str) -> Interval:
        m = _PATTERN.fullmatch(text)
        if not m:
            raise ValueError(f"no interval: {text!r}")
        return Interval(int(m[1]), "min" if m[2] == "m" else m[2])

    @property
    def seconds(self) -> float | None:
        """Length of a fixed interval; None for calendar units."""
        return self.n * _SECONDS[self.unit] if self.unit in _SECONDS else None

    @property
    def months(self) -> int | None:
        return self.n * _MONTHS[self.unit] if self.unit in _MONTHS else None

    def to_timedelta(self) -> timedelta | None:
        return None if self.seconds is None else timedelta(seconds=self.seconds)

    def after(self, start: Column, times: Column) -> Column:
        """start and so many intervals, always counted from start."""
        return F.timestamp_add(_SPARK[self.unit], (times * self.n).cast("int"), start)

    def between(self, start: Column, end: Column) -> Column:
        """Whole intervals from start to end, rounded."""
        if self.months:
            months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
            return F.floor(months / self.months).cast("int")
        micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
        return F.round(micros / F.lit(self.seconds * 1e6)).cast("int")

    def floor(self, at: Column) -> Column:
        """The start of the calendar-aligned bin that holds `at`; fixed bins count from the epoch, weeks from Monday."""
        if self.months:
            month = (F.year(at) * 12 + F.month(at) - 1).cast("int")
            month = month - F.pmod(month, F.lit(self.months))
            return F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
        step = int(self.seconds * 1e6)
        shift = 4 * 86_400_000_000 if self.unit == "w" else 0
        micros = F.unix_micros(at.cast("timestamp")) - shift
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(step)) + shift).cast("timestamp_ntz")


def normalised(interval: timedelta) -> Interval:
    """Day counts of whole months, quarters, halves and years as calendar intervals."""
    days = interval / timedelta(days=1)
    for low, high, months in ((28, 31, 1), (59, 62, 2), (89, 92, 3), (181, 184, 6), (365, 366, 12)):
        if low <= days <= high:
            return Interval(months, "mo") if months < 12 else Interval(1, "y")
    return Interval(round(interval / timedelta(microseconds=1)), "us")


def _deltas(df: DataFrame, keys: tuple[str, ...], time: str) -> DataFrame:
    """(d, m, day): microseconds and months since the row before in its series, and the day of the month, 31 at its end."""
    t = F.col(time).cast("timestamp")
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(time))
    months = F.months_between(F.trunc(t, "month"), F.trunc(before, "month")).cast("int")
    return df.select((F.unix_micros(t) - F.unix_micros(before)).alias("d"), months.alias("m"), F.when(t == F.last_day(t), 31).otherwise(F.dayofmonth(t)).alias("day")).filter("d is not null")


def _upper_middle(rows: DataFrame, n: int) -> int:
    """Of n values d the one at place n // 2 of their order: one that is there, never a mean of two."""
    return rows.agg(F.expr(f"percentile_disc({(n // 2 + 0.5) / n!r}D) WITHIN GROUP (ORDER BY d)")).first()[0]


def inferred(df: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> Interval:
    """The interval of a regular grid: one delta, or fixed deltas under a day that differ by at most an hour (their median), or
    whole months. Anything else, and duplicate time stamps, is an error. All steps count, however many there are."""
    distinct = _deltas(df, keys, time).groupBy("d").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    s = distinct.agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if not s["n"]:
        raise ValueError("an interval needs two time stamps in a series")
    if s["least"] <= 0:
        raise ValueError("a series has a time stamp twice")
    if s["n"] == 1:
        return normalised(timedelta(microseconds=s["least"])) if s["least"] >= 28 * 86_400_000_000 else _fixed(s["least"])
    if s["most"] < 86_400_000_000 and s["most"] - s["least"] <= 3_600_000_000:
        return _fixed(_upper_middle(distinct, s["n"]))
    if s["lo"] == s["hi"] and s["lo"] > 0:
        return Interval(s["lo"], "mo")
    raise ValueError(f"no regular grid: {s['n']} different steps")


def representative(df: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> Interval:
    """The middle one of all positive steps, for grids with gaps and jitter; an error only where there is none."""
    rows = _deltas(df, keys, time).filter("d > 0")
    n = rows.count()
    if not n:
        raise ValueError("an interval needs two different time stamps in a series")
    return _fixed(_upper_middle(rows, n))


def _fixed(micros: int) -> Interval:
    for unit in ("d", "h", "min", "s", "ms", "us"):
        one = round(_SECONDS[unit] * 1e6)
        if micros % one == 0:
            return Interval(micros // one, unit)
    raise ValueError(micros)


def add_interval(start: datetime, interval: str, n: int = 1) -> datetime:
    """start and n intervals; calendar units keep the day, clamped to the month's end."""
    i = Interval.parse(interval)
    if i.seconds is not None:
        return start + n * timedelta(seconds=i.seconds)
    month = start.year * 12 + start.month - 1 + n * i.months
    year, month = divmod(month, 12)
    last = (datetime(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return start.replace(year=year, month=month + 1, day=min(start.day, last))
