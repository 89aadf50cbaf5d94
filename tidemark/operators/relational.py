"""Joins and set operations on long tables, each with the plan that holds at scale.

Equi, semi and anti joins are Spark's own: adaptive execution broadcasts a side only when its measured size allows it.
Range and overlap joins are equi joins on time bins, so that no pair of rows that cannot match is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left with a partner in right. Null keys have none."""
    return left.join(right.select(*on), on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner in right; those with null keys are among them."""
    return left.join(right.select(*on), on, "left_anti")


def positional(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """Columns side by side by the rows' place in their series, as far as the shorter one goes. right's keys and time go."""
    w = Window.partitionBy(*keys).orderBy(time)
    a = left.withColumn("_at", F.row_number().over(w))
    b = right.withColumn("_at", F.row_number().over(w)).drop(time)
    return a.join(b, [*keys, "_at"]).drop("_at")


def _bin(at, width: int):
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(width * 1_000_000)).cast("bigint")


def in_span(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "time", start: str = "start", end: str = "end", width: int = 86_400) -> DataFrame:
    """points with every span (start <= at <= end) of their keys: an equi join on bins of `width` seconds.

    A span is in as many bins as it touches, a point in one, so that a pair meets once. width near the usual length of a span
    makes the least work; it has no effect on the result.
    """
    a = points.withColumn("_bin", _bin(F.col(at), width))
    b = spans.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))))
    return a.join(b, [*keys, "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 86_400) -> DataFrame:
    """Pairs of spans of the same keys that share a moment (ends included). A pair meets in each bin that both touch and is kept
    in the first of them."""
    (a0, a1), (b0, b1) = left_span, right_span
    cut = lambda df, s, e: df.filter(F.col(s) <= F.col(e)).withColumn("_bin", F.explode(F.sequence(_bin(F.col(s), width), _bin(F.col(e), width))))
    pairs = cut(left, a0, a1).join(cut(right, b0, b1), [*keys, "_bin"]).filter((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)))
    return pairs.filter(F.col("_bin") == _bin(F.greatest(a0, b0), width)).drop("_bin")


def less_than(left: DataFrame, right: DataFrame, x: str, y: str) -> DataFrame:
    """left with n_above: how many rows of right have y > x (a theta join that only counts). Both sides are reduced to counts
    per value and merged in one ordered pass over distinct values, never paired."""
    a = left.select(F.col(x).alias("_v")).filter("_v is not null").distinct().withColumn("_n", F.lit(0))
    b = right.groupBy(F.col(y).alias("_v")).agg(F.count("*").alias("_n")).filter("_v is not null")
    both = a.unionByName(b).groupBy("_v").agg(F.sum("_n").alias("_n"))
    cut = both.select(F.percentile_approx("_v", F.array(*(F.lit(i / 64) for i in range(1, 64))), 1000)).first()[0] or []
    part = F.lit(0)
    for c in cut:  # 64 ranges, each ordered by itself, with the sums of those above it
        part = part + (F.col("_v") > F.lit(c)).cast("int")
    both = both.withColumn("_p", part)
    sums = both.groupBy("_p").agg(F.sum("_n").alias("_s"))
    above = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))  # 64 rows
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = both.withColumn("_in", inside).join(above, "_p").select(F.col("_v").alias(x), (F.col("_in") + F.col("_above")).alias("n_above"))
    return left.join(counted, x, "left").withColumn("n_above", F.coalesce("n_above", F.lit(0)))


def keep_last(df: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last by `order`, of rows alike the one whose other columns are the largest. By aggregation, so
    that partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*on, *order)]
    return df.groupBy(*on).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*on, "_r.*").select(*df.columns)


def top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; partitions cut theirs to k before the shuffle (Spark's window group limit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def stacked(*tables: DataFrame) -> DataFrame:
    """Union by name; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def grouping_sets(df: DataFrame, sets: list[list[str]], **aggregates) -> DataFrame:
    """Aggregates for each set of columns, the others null, with _grouping, the number of the set. One expand, one shuffle."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    tagged = df.withColumn("_grouping", F.explode(F.array(*map(F.lit, range(len(sets))))))
    for c in every:
        tagged = tagged.withColumn(f"_g_{c}", F.when(F.col("_grouping").isin([i for i, s in enumerate(sets) if c in s]), F.col(c)))
    out = tagged.groupBy("_grouping", *(f"_g_{c}" for c in every)).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.withColumnsRenamed({f"_g_{c}": c for c in every})


def rolled_up(df: DataFrame, columns: list[str], **aggregates) -> DataFrame:
    return df.rollup(*columns).agg(*(a.alias(n) for n, a in aggregates.items()))


def cubed(df: DataFrame, columns: list[str], **aggregates) -> DataFrame:
    return df.cube(*columns).agg(*(a.alias(n) for n, a in aggregates.items()))


def approximate(df: DataFrame, by: list[str], column: str, error: float = 0.02) -> DataFrame:
    """(by, distinct_about, median_about): sketches of bounded size, merged from partial ones; error is the relative deviation."""
    return df.groupBy(*by).agg(F.approx_count_distinct(column, error).alias("distinct_about"), F.percentile_approx(column, 0.5, int(1 / error) * 100).alias("median_about"))


def sessions(df: DataFrame, keys: tuple[str, ...], gap_seconds: int, time: str = "time") -> DataFrame:
    """(keys, start, end, n): runs of rows none of which comes more than gap_seconds after the one before."""
    w = Window.partitionBy(*keys).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.select(*keys, time).withColumn("_new", F.coalesce((t - F.lag(t).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_s").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("_s")
