"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Links, labels and components stay in Spark tables. Each round is written to the shared folder, so that neither lineage
nor a lost executor costs more than one round. Minima are aggregated map-side before they are shuffled; the joins that
bring them back are plain sort-merge joins, which adaptive execution splits where a hub's rows are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import removed, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, component_id) of every node that has a link to a smaller one or larger one than itself, and the table's path.

    edges: columns a, b (bigint), in any direction; null ends and loops are left out, repeated edges count once.
    component_id is the smallest node reachable. Nodes without links are not in the result; nor are the smallest nodes
    themselves, whose component is their own id: coalesce after a left join.
    """
    spark = edges.sparkSession
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = stored(edges)
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        after, at = stored(_stars(now))
        removed(spark, path)
        now, path = after, at
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")), path
