"""Joins and reshapes: steps of known futures, as-of forecasts by vintage, wide and long panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import Interval


def asof_backward(left: DataFrame, right: DataFrame, on: str, right_on: str, keys: tuple[str, ...] = ("group",), columns: tuple[str, ...] = ()) -> DataFrame:
    """left with the columns of the newest right row that is not after it, by one union and one window (one shuffle by keys)."""
    extra = [c for c in left.columns if c not in (*keys, on)]
    kinds = {f.name: f.dataType for f in left.schema.fields}
    a = left.select(*keys, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.struct(*extra).alias("_left") if extra else F.lit(0).alias("_left"), F.lit(None).cast(right.select(F.struct(right_on, *columns).alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(right_on, *columns).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*keys, F.col("_at").cast(kinds[on]).alias(on), *(F.col(f"_left.{c}").alias(c) for c in extra), *(F.col(f"_right.{c}").alias(c) for c in (right_on, *columns)))


def steps_of(times: DataFrame, horizon: int, interval: str, base: str, target: str = "_target") -> DataFrame:
    """Each row of times once per step 1..horizon, with the stamp so many intervals after `base`."""
    return times.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(target, Interval.parse(interval).after(F.col(base), F.col("step")))


def pivoted(rows: DataFrame, keys: list[str], values: tuple[str, ...], horizon: int) -> DataFrame:
    """Long steps as {c}_step_{h} columns, by one conditional aggregate."""
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("step") == h, F.col(c))).alias(f"{c}_step_{h}") for c in values for h in range(1, horizon + 1)))


def window_futures(future: DataFrame, times: DataFrame, horizon: int, interval: str, values: tuple[str, ...], keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """Values known in advance, at each of times' next `horizon` stamps."""
    asked = steps_of(times.select(*keys, time), horizon, interval, time)
    return pivoted(asked.join(future.select(*keys, F.col(time).alias("_target"), *values), [*keys, "_target"], "left"), [*keys, time], values, horizon)


def window_forecasts(forecasts: DataFrame, times: DataFrame, horizon: int, interval: str, values: tuple[str, ...], keys: tuple[str, ...] = ("group",), time: str = "time", vintage: str = "vintage_time") -> DataFrame:
    """Forecasts of the newest vintage at or before each of times, for its next `horizon` stamps."""
    vintages = forecasts.select(*keys, vintage).distinct()
    known = asof_backward(times.select(*keys, time), vintages, time, vintage, keys)
    asked = steps_of(known, horizon, interval, time)
    found = asked.join(forecasts.select(*keys, vintage, F.col(time).alias("_target"), *values), [*keys, vintage, "_target"], "left")
    return pivoted(found, [*keys, time], values, horizon)


def densify_vintages(forecasts: DataFrame, values: tuple[str, ...], keys: tuple[str, ...] = ("group",), time: str = "time", vintage: str = "vintage_time") -> DataFrame:
    """Every vintage with each column taken from its newest vintage that has that column at all."""
    per = forecasts.groupBy(*keys, vintage).agg(*(F.when(F.count(c) > 0, F.col(vintage)).alias(f"_v_{c}") for c in values))
    w = Window.partitionBy(*keys).orderBy(vintage).rowsBetween(Window.unboundedPreceding, 0)
    newest = per.select(*keys, vintage, *(F.last(f"_v_{c}", ignorenulls=True).over(w).alias(f"_v_{c}") for c in values))
    parts = [newest.select(*keys, vintage, F.col(f"_v_{c}").alias("_own")).join(forecasts.select(*keys, F.col(vintage).alias("_own"), time, c).filter(F.col(c).isNotNull()), [*keys, "_own"]).drop("_own") for c in values]
    return reduce(lambda a, b: a.join(b, [*keys, vintage, time], "full"), parts)


def retained_vintages(forecasts: DataFrame, now, values: tuple[str, ...], keys: tuple[str, ...] = ("group",), time: str = "time", vintage: str = "vintage_time") -> DataFrame:
    """Of each column the newest vintage up to now that still reaches beyond it."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("there")) for c in values]
    long = forecasts.select(*keys, vintage, time, F.explode(F.array(*rows)).alias("c")).select(*keys, vintage, time, "c.*").filter("there")
    ends = long.groupBy(*keys, "column", vintage).agg(F.max(time).alias("_end")).filter((F.col(vintage) <= now) & (F.col("_end") > now))
    return ends.groupBy(*keys, "column").agg(F.max(vintage).alias(vintage))


def to_long(wide: DataFrame, time: str = "time") -> DataFrame:
    """(group, time, members..., globals...) from {group}__{member} columns; plain columns are repeated for each group."""
    split = [c.split("__", 1) for c in wide.columns if "__" in c]
    groups = list(dict.fromkeys(g for g, _ in split))
    members = list(dict.fromkeys(m for _, m in split))
    shared = [c for c in wide.columns if "__" not in c and c != time]
    rows = F.array(*(F.struct(F.lit(g).alias("group"), *((F.col(f"{g}__{m}") if [g, m] in split else F.lit(None)).alias(m) for m in members)) for g in groups))
    return wide.select(time, *shared, F.explode(rows).alias("_r")).select("_r.group", time, *(f"_r.{m}" for m in members), *shared)


def to_wide(long: DataFrame, groups: tuple[str, ...], members: tuple[str, ...], time: str = "time") -> DataFrame:
    """{group}__{member} columns, full outer on time, by one conditional aggregate."""
    return long.groupBy(time).agg(*(F.max(F.when(F.col("group") == g, F.col(m))).alias(f"{g}__{m}") for g in groups for m in members))


def actuals_as_forecasts(actuals: DataFrame, horizon: int, values: tuple[str, ...], keys: tuple[str, ...] = ("group",), time: str = "time", stride: int = 1) -> DataFrame:
    """Vintages of perfect foresight: at each (stride-th) stamp the next `horizon` rows."""
    w = Window.partitionBy(*keys).orderBy(time)
    ahead = F.array(*(F.struct(F.lit(h).alias("step"), F.lead(time, h).over(w).alias("time"), *(F.lead(c, h).over(w).alias(c) for c in values)) for h in range(1, horizon + 1)))
    rows = actuals.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_a", ahead).filter(F.col("_rn") % stride == 0)
    return rows.select(*keys, F.col(time).alias("vintage_time"), F.explode("_a").alias("_s")).select(*keys, "vintage_time", "_s.*").filter("time is not null")
