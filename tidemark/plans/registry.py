"""A registry of queries, and the tables they share.

The panel that most of them read is daily: for each return flag the quantity shipped (y) and the number of lines (x).
Doubles are rounded and time stamps are text in every result, so that engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of the shared tables; "g" stands for group.
DAILY = "daily AS (SELECT l_returnflag AS g, date_trunc('day', l_shipdate)::TIMESTAMP AS time, sum(l_quantity) AS y, count(*)::DOUBLE AS x FROM lineitem GROUP BY 1, 2)"
MONTHLY = "monthly AS (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate)::TIMESTAMP AS time, count(*)::DOUBLE AS y FROM orders WHERE o_orderdate < (SELECT date_trunc('month', max(o_orderdate) + INTERVAL 1 DAY) FROM orders) GROUP BY 1, 2)"
KEY = "g AS \"group\", strftime(time, '%Y-%m-%d %H:%M:%S') AS time"
BY = "PARTITION BY g ORDER BY time"


def r(expression: str, name: str) -> str:
    """A rounded SQL column."""
    return f'round({expression}, 6) + 0.0 AS "{name}"'


def recursion(b, a, x: str = "y") -> str:
    """SQL of a causal filter over `daily`: each row's output from its own and the last inputs and outputs."""
    b, a = [float(v) / float(a[0]) for v in b], [float(v) / float(a[0]) for v in a]
    k = len(a) - 1
    names = ", ".join(f"x{i}, o{i}" for i in range(1, k + 1))
    out = f"{b[0]!r} * n.x" + "".join(f" + {b[i]!r} * e.x{i} - ({a[i]!r}) * e.o{i}" for i in range(1, k + 1))
    shifted = ", ".join(f"{'n.x' if i == 1 else f'e.x{i - 1}'}, {out if i == 1 else f'e.o{i - 1}'}" for i in range(1, k + 1))
    start = ", ".join(f"{'x' if i == 1 else '0.0::DOUBLE'}, {f'{b[0]!r} * x' if i == 1 else '0.0::DOUBLE'}" for i in range(1, k + 1))
    return f"WITH RECURSIVE {DAILY}, n AS (SELECT g, time, {x}::DOUBLE AS x, row_number() OVER ({BY}) AS rn FROM daily), e(g, time, rn, {names}) AS (SELECT g, time, rn, {start} FROM n WHERE rn = 1 UNION ALL SELECT n.g, n.time, n.rn, {shifted} FROM e JOIN n ON n.g = e.g AND n.rn = e.rn + 1)"


def fitted(name: str, y: str, a: str, b: str, source: str = "e") -> str:
    """CTE of the least-squares plane of y on a and b, by Cramer's rule on covariances."""
    rows = f"(SELECT {a} AS a, {b} AS b, {y} AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {y} IS NOT NULL)"
    return f"""{name}s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM {rows}),
{name} AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ka, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS kb, my - (ay * bb - byy * ab) / (aa * bb - ab * ab) * ma - (byy * aa - ay * ab) / (aa * bb - ab * ab) * mb AS k0 FROM {name}s)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("group"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("time"))
    return rows.agg(F.sum("l_quantity").alias("y"), F.count("*").cast("double").alias("x"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month and priority; a last month that the data ends within is left out."""
    orders = table(spark, sf_dir, "orders")
    end = orders.agg(F.date_trunc("month", F.max("o_orderdate") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("end")).scalar()
    rows = orders.filter(F.col("o_orderdate") < end)
    return rows.groupBy(F.col("o_orderpriority").alias("group"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time")).agg(F.count("*").cast("double").alias("y"))


def comparable(df: DataFrame) -> DataFrame:
    """Doubles rounded, time stamps as text."""

    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return (F.round(c, 6) + 0.0).alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
        return c

    return df.select(*(one(*x) for x in df.dtypes))


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir); sql is its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: comparable(f(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return register
