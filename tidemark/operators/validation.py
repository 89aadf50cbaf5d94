"""Checks of long tables against the contracts of operators. Each one is one aggregate, of which a few values are read.

Errors name what is wrong and where; a check that passes returns its table, ordered or cast where it says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from tidemark.operators.intervals import Interval, inferred


def check_time_column(df: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time", name: str = "table") -> DataFrame:
    """The time column is there, a date or time stamp, never null, and once per series."""
    if time not in df.columns:
        raise ValueError(f"{name} has no column {time!r}")
    kind = df.schema[time].dataType
    if kind.typeName() not in ("date", "timestamp", "timestamp_ntz"):
        raise ValueError(f"{name}.{time} is {kind.simpleString()}, not a date or time stamp")
    counts = df.groupBy(*keys, time).agg(F.count("*").alias("n")).agg(F.count_if(F.col(time).isNull()).alias("null"), F.count_if(F.col("n") > 1).alias("twice")).first()
    if counts["null"]:
        raise ValueError(f"{name}.{time} has nulls")
    if counts["twice"]:
        raise ValueError(f"{name} has {counts['twice']} time stamps more than once in a series")
    return df


def check_continuity(before: DataFrame, after: DataFrame, interval: str | None = None, keys: tuple[str, ...] = ("group",), time: str = "time") -> None:
    """The first row of `after` comes one interval after the last one of `before`, in every series that both have; without an
    interval, just after it. New series may come."""
    ends = before.groupBy(*keys).agg(F.max(time).alias("_last")).join(after.groupBy(*keys).agg(F.min(time).alias("_first")), list(keys))
    if interval is None:
        bad = F.col("_first") <= F.col("_last")
    else:
        bad = F.col("_first") != Interval.parse(interval).after(F.col("_last"), F.lit(1))
    found = ends.filter(bad).orderBy(*keys).limit(1).collect()
    if found:
        raise ValueError(f"series {[found[0][k] for k in keys]} ends at {found[0]['_last']} and goes on at {found[0]['_first']}: a gap or an overlap")


def check_day_of_month(df: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> bool:
    """Whether each series keeps its day of the month, the last days of months counting as one."""
    day = F.when(F.to_date(time) == F.last_day(F.to_date(time)), F.lit(32)).otherwise(F.dayofmonth(time))
    day = F.struct(F.min(F.dayofmonth(time)).alias("lo"), F.max(F.dayofmonth(time)).alias("hi"), F.bool_and(day == 32).alias("ends"), F.max(F.when(day != 32, F.dayofmonth(time))).alias("free"), F.min(F.when(day != 32, F.dayofmonth(time))).alias("free_lo"))
    rows = df.groupBy(*keys).agg(day.alias("d"))
    ok = F.col("d.ends") | (F.col("d.lo") == F.col("d.hi")) | (F.col("d.free").isNotNull() & (F.col("d.free") == F.col("d.free_lo")) & (F.col("d.hi") == F.col("d.free")))
    return rows.filter(~F.coalesce(ok, F.lit(False))).isEmpty()


def check_inputs(y: DataFrame, x: DataFrame | None, keys: tuple[str, ...] = ("group",), time: str = "time") -> Interval:
    """Target and covariates are on grids of one interval, which is returned."""
    check_time_column(y, keys, time, "y")
    own = inferred(y, keys, time)
    if x is not None:
        check_time_column(x, keys, time, "X")
        other = inferred(x, keys, time)
        if other != own:
            raise ValueError(f"y has steps of {own}, X of {other}")
    return own


def check_schema(df: DataFrame, expected: StructType) -> DataFrame:
    """df with the columns of `expected` in its order; missing columns and other types are errors, extra columns go."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    other = [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in expected.fields if have[f.name] != f.dataType]
    if other:
        raise ValueError("; ".join(other))
    return df.select(*(f.name for f in expected.fields))


def validate_column_names(names: Iterable[str]) -> None:
    """Wide panel names are plain, or group__member with one separator and both sides there."""
    for n in names:
        if "___" in n or n.count("__") > 1 or "__" in n and not all(n.split("__")):
            raise ValueError(f"{n!r} is no name of the form group__member")


def check_panel_members(df: DataFrame, member: str, keys: tuple[str, ...] = ("group",)) -> None:
    """Every group has the same members."""
    found = df.select(*keys, member).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("m")).select("m").distinct().limit(2).count()
    if found > 1:
        raise ValueError("groups have different members")


def check_panel_groups_match(y: DataFrame, x: DataFrame, keys: tuple[str, ...] = ("group",)) -> None:
    """Every group of y is in X."""
    lost = y.select(*keys).distinct().join(x.select(*keys).distinct(), list(keys), "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"X has no rows of {[*lost[0]]}")


def check_groups(fitted: DataFrame, requested: list, key: str = "group") -> DataFrame:
    """The rows of the requested groups; one that was never seen is an error."""
    have = {r[0] for r in fitted.filter(F.col(key).isin(requested)).select(key).distinct().collect()}
    lost = [g for g in requested if g not in have]
    if lost:
        raise ValueError(f"unknown groups: {lost}")
    return fitted.filter(F.col(key).isin(requested))


def check_sufficient_rows(df: DataFrame, least: int, context: str = "this operator", keys: tuple[str, ...] = ("group",)) -> None:
    few = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") < least).orderBy("n", *keys).limit(1).collect()
    if few or least > 0 and df.isEmpty():
        raise ValueError(f"{context} needs {least} rows a series" + (f"; {[few[0][k] for k in keys]} has {few[0]['n']}" if few else "; there are none"))


def check_horizon(horizon: int | None, allow_none: bool = False) -> None:
    if horizon is None and allow_none:
        return
    if not isinstance(horizon, int) or isinstance(horizon, bool) or horizon < 1:
        raise ValueError(f"a horizon is a whole number from 1, not {horizon!r}")


def check_covariates_given(x: DataFrame | None, lookback: int, context: str = "this forecaster") -> None:
    if x is None and lookback > 0:
        raise ValueError(f"{context} was fitted with covariates, and needs them here")


def validate_search_data(y: DataFrame, x: DataFrame | None, keys: tuple[str, ...] = ("group",), time: str = "time") -> Interval:
    """What a search splits: a regular target, and covariates of all its groups on the same grid."""
    own = check_inputs(y, x, keys, time)
    if x is not None:
        check_panel_groups_match(y, x, keys)
    return own


def select_scored(rows: DataFrame, groups: list | None = None, components: list | None = None, rates: list[float] | None = None) -> DataFrame:
    """The scored rows of some groups, components and coverage rates; one that the table lacks is an error."""
    for column, wanted in (("group", groups), ("component", components), ("coverage_rate", rates)):
        if wanted is None:
            continue
        have = {r[0] for r in rows.filter(F.col(column).isin(wanted)).select(column).distinct().collect()}
        lost = [w for w in wanted if w not in have]
        if lost:
            raise ValueError(f"nothing to score for {column} {lost}")
        rows = rows.filter(F.col(column).isin(wanted))
    return rows


def check_vintages(df: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> None:
    """Vintage forecasts have both stamps, once each."""
    bad = df.filter(F.col("vintage_time").isNull() | F.col(time).isNull()).limit(1).count()
    if bad:
        raise ValueError("a vintage or target stamp is null")
    if not df.groupBy(*keys, "vintage_time", time).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a vintage has a target stamp twice")


def reject_conflicting_forecasts(df: DataFrame, values: list[str], keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """df without repeated rows; rows of one vintage and stamp with different values are an error. Nulls count as a value."""
    alike = F.struct(*values)
    if not df.groupBy(*keys, "vintage_time", time).agg(F.count_distinct(F.xxhash64(alike)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("forecasts of one vintage and stamp differ")
    return df.dropDuplicates([*keys, "vintage_time", time])


def validate_view(df: DataFrame, columns: list[str] | None = None, groups: list | None = None, least: int = 1, key: str = "group", categorical: bool = False) -> list[str]:
    """The columns a view shows: those asked for, or all that are numeric (or categorical); errors for unknown ones and too few rows."""
    lost = [c for c in columns or [] if c not in df.columns]
    if lost:
        raise ValueError(f"no such columns: {lost}")
    if groups is not None:
        check_groups(df, groups, key)
    check_sufficient_rows(df, least, "a view", (key,) if key in df.columns else ())
    return columns or [*numeric_columns(df, (key,)), *(categorical_columns(df, (key,)) if categorical else [])]


def validate_view_options(kind: str | None = None, kinds: Iterable[str] | None = None, **positive: int | None) -> None:
    if kind is not None and kinds is not None and kind not in {*kinds}:
        raise ValueError(f"kind is one of {sorted(kinds)}, not {kind!r}")
    for name, value in positive.items():
        if value is not None and value <= 0:
            raise ValueError(f"{name} is positive, not {value}")


def cast(df: DataFrame, schema: StructType) -> DataFrame:
    """df's columns of `schema` in its types; values for whole-number columns are rounded (half to even) first."""

    def one(f):
        c = F.col(f.name)
        if isinstance(f.dataType, IntegralType) and not isinstance(df.schema[f.name].dataType, IntegralType):
            c = F.bround(c, 0)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*(one(f) for f in schema.fields))


def is_categorical(kind: DataType) -> bool:
    return isinstance(kind, StringType)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical(f.dataType) and f.name not in {*exclude}]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in {*exclude}]


class Contract:
    """What a fitted operator holds its later inputs to: the columns and types it was fitted on, the grid, and its series.

    fit() records; check() gives the input with its columns in order, or says what is wrong with it.
    """

    def __init__(self, keys: tuple[str, ...] = ("group",), time: str = "time", regular: bool = True, least: int = 1):
        self.keys, self.time, self.regular, self.least = keys, time, regular, least
        self.schema: StructType | None = None
        self.interval: Interval | None = None
        self.ends: DataFrame | None = None

    def fit(self, df: DataFrame, x: DataFrame | None = None) -> Contract:
        check_time_column(df, self.keys, self.time)
        check_sufficient_rows(df, self.least, "fit", self.keys)
        self.schema, self.covariates = df.schema, x.schema if x is not None else None
        self.interval = inferred(df, self.keys, self.time) if self.regular else None
        if x is not None:
            check_panel_groups_match(df, x, self.keys)
        self.ends = df.select(*self.keys, self.time)
        return self

    def check(self, df: DataFrame, continues: bool = False, x: DataFrame | None = None) -> DataFrame:
        """continues: df goes on where the fitted rows end."""
        if self.schema is None:
            raise ValueError("fit comes first")
        out = check_schema(df, self.schema)
        if continues:
            check_continuity(self.ends, out, None, self.keys, self.time)
        if (x is None) != (self.covariates is None):
            raise ValueError("covariates are to be given exactly if they were at fit")
        if x is not None:
            check_schema(x, self.covariates)
        return out

    def check_inverse(self, transformed: DataFrame, past: DataFrame | None, lookback: int) -> None:
        """An inverse gets the rows before the transformed ones, as many as it looks back on."""
        if not lookback:
            return
        if past is None:
            raise ValueError(f"the inverse needs the {lookback} rows before")
        check_sufficient_rows(past, lookback, "the inverse", self.keys)
        check_continuity(past, transformed, None, self.keys, self.time)


def stamps_of(df: DataFrame) -> list[str]:
    """Which of vintage_time and time a table has, in this order."""
    return [c for c in ("vintage_time", "time") if c in df.columns and isinstance(df.schema[c].dataType, (TimestampType, TimestampNTZType))]


# --- names of wide panels: group__member -------------------------------------------------------------------------

_NAME = re.compile(r"(.+?)__(.+)")


def renamed_member(column: str, fn) -> str:
    """fn of the member's part of a wide name, or of a plain name."""
    m = _NAME.fullmatch(column)
    return f"{m[1]}__{fn(m[2])}" if m else fn(column)


def with_prefix(column: str, prefix: str) -> str:
    return renamed_member(column, lambda n: prefix + n)


def with_suffix(column: str, suffix: str) -> str:
    return renamed_member(column, lambda n: n + suffix)


def select_groups(df: DataFrame, groups: list[str], include_global: bool = True, time: str = "time") -> DataFrame:
    """The time and the wide columns of some groups, with or without those of no group."""
    validate_column_names(c for c in df.columns if c != time)
    own = {c: (m[1] if (m := _NAME.fullmatch(c)) else None) for c in df.columns if c != time}
    lost = [g for g in groups if g not in own.values()]
    if lost:
        raise ValueError(f"unknown groups: {lost}")
    return df.select(time, *(c for c, g in own.items() if g in groups or include_global and g is None))


def step_coverage(df: DataFrame, base: str, horizon: int) -> DataFrame:
    """df with {base}_coverage: how many of its {base}_step_{h} are there."""
    return df.withColumn(f"{base}_coverage", sum((F.col(f"{base}_step_{h}").isNotNull().cast("int") for h in range(1, horizon + 1)), F.lit(0)))


def rank_deficient(df: DataFrame, bases: list[str], horizon: int, tolerance: float = 1e-9) -> list[str]:
    """The bases whose step columns depend on each other linearly, by the rank of their products, which are all that is read."""
    import numpy as np

    out = []
    for b in bases:
        names = [f"{b}_step_{h}" for h in range(1, horizon + 1)]
        rows = df.select(F.lit(1.0).alias("_1"), *(F.col(c).cast("double").alias(c) for c in names)).na.drop()
        every = ["_1", *names]
        sums = rows.agg(*(F.sum(F.col(a) * F.col(c)).alias(f"{i}_{j}") for i, a in enumerate(every) for j, c in enumerate(every) if i <= j)).first()
        gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(every))] for i in range(len(every))])
        size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        if np.linalg.matrix_rank(gram / size[:, None] / size[None, :], tol=tolerance) < len(every):
            out.append(b)
    return out


def merge_forecasts(made: DataFrame, given: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """made with the columns of given on the same (vintage_time, time); names that both have are an error."""
    on = [*keys, "vintage_time", time]
    both = {*made.columns} & {*given.columns} - {*on}
    if both:
        raise ValueError(f"both tables have {sorted(both)}")
    return made.join(given, on, "left")


def first_in_time(df: DataFrame, keys: tuple[str, ...], time: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
