"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised and hashed in several tables: each key is the tuple of `width`-quantised projections on Gaussian
directions with random offsets. Equal vectors of a label are one class before that, so that copies cost nothing. Classes
that share a bucket are compared exactly, by cosine in double precision. A bucket's members are dealt to tiles of a
bounded number of blocks, so that no task holds an unbounded bucket, and only sums of links and spanning forests leave a
tile, never its pairs; a pair that meets in several tables counts in the first of them only.

With unit vectors of cosine 0.98 at distance 0.2, width 0.8, 8 projections and 32 tables, a pair at the threshold is met
with probability 0.997, closer ones more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, bounded_batches, groups_of, mixed, stored
from tidemark.llm.components import components

#: Members of a block; a tile compares two blocks, and has a number for each pair of their members.
BLOCK = 1536


class Hashes:
    """The p-stable hash functions for vectors of `size` components."""

    def __init__(self, size: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng([seed, size])
        self.directions = rng.standard_normal((size, tables * projections))
        self.offsets = rng.uniform(0, width, tables * projections)
        self.tables, self.projections, self.width = tables, projections, width

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """vectors x tables: 64-bit keys of unit vectors."""
        cells = np.floor((vectors @ self.directions + self.offsets) / self.width).astype(np.int64).reshape(len(vectors), self.tables, self.projections)
        out = np.zeros(cells.shape[:2], np.uint64)
        for k in range(self.projections):
            out = mixed(out + cells[:, :, k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        return out.astype(np.int64)


def _forest(linked: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest place that each row and each column reaches in a boolean matrix of links, whose columns' places follow
    those of the rows (or are the rows', where it is whole)."""
    rows, columns = np.arange(linked.shape[0]), np.arange(linked.shape[1]) + (0 if whole else linked.shape[0])
    most = sum(linked.shape) + 1
    while True:
        least = np.minimum(rows, np.where(linked, columns[None, :], most).min(axis=1, initial=most))
        other = np.minimum(columns, np.where(linked, least[:, None], most).min(axis=0, initial=most))
        least = np.minimum(least, other) if whole else least
        if (least == rows).all() and (other == columns).all():
            return least, least if whole else other
        rows, columns = least, least if whole else other


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, tables: int = 32, projections: int = 8, width: float = 0.8, seed: int = 7) -> DataFrame:
    """One row per row of df: key, n_links (other rows linked directly), component_id (smallest key reachable, itself included), kept.

    Rows link when their labels are equal and not null and the cosine is at least `cosine`. A vector that is null, empty,
    all zero or has a null or non-finite component links with nothing, nor does one with a null label; vectors of
    different sizes don't link. Keys must be unique and not null. Rows that repeat a vector link with each other.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    size = F.size(vector)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    valid = F.coalesce(F.col(label).isNotNull() & (size > 0) & F.forall(vector, finite) & F.exists(vector, lambda c: c != 0), F.lit(False))
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("y"), F.col(vector).alias("v"), valid.alias("ok"))
    rows = rows.withColumns({"h1": F.xxhash64("y", "v"), "h2": F.xxhash64(F.lit(1), "v", "y")})
    classes, _ = stored(rows.filter("ok").groupBy("y", "h1", "h2").agg(F.min("id").alias("c"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("size", F.size("v")))

    def hashed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            for k in np.unique(sizes := x.column(2).to_numpy()):
                own = x.filter(pa.array(sizes == k))
                v = own.column(3).flatten().to_numpy().astype(np.float64).reshape(own.num_rows, int(k))
                v = v / np.abs(v).max(axis=1, keepdims=True)
                keys = Hashes(int(k), tables, projections, width, seed).keys(v / np.linalg.norm(v, axis=1, keepdims=True))
                at = np.repeat(np.arange(own.num_rows), tables)
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(at)), own.column(1).take(pa.array(at)), own.column(2).take(pa.array(at)), pa.array(np.tile(np.arange(tables, dtype=np.int32), own.num_rows)), pa.array(keys.ravel())], ["c", "y", "size", "t", "k"])

    kind = classes.select("c").schema["c"].dataType.simpleString()
    keys, _ = stored(classes.select("c", "y", "size", "v").mapInArrow(hashed, f"c {kind}, y string, size int, t int, k bigint"))
    bucket = ["y", "size", "t", "k"]
    full = keys.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = (
        keys.join(full, bucket)
        .withColumn("nb", blocks)
        .withColumn("block", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("tile", F.concat_ws("/", "size", "t", "k", F.least("block", "other"), F.greatest("block", "other"), "y"))
        .select("tile", "block", "c", "t")
        .join(classes.select("c", "n", "v"), "c")
        .select("tile", "block", "t", "c", "n", "v")
    )

    def compared(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions: dict[int, Hashes] = {}
        for g in groups_of(frames):
            block, t = g.column("block").to_numpy(), g.column("t")[0].as_py()
            first, last = (int(x) for x in g.column("tile")[0].as_py().split("/")[3:5])
            whole = first == last
            x, y = np.flatnonzero(block == first), np.flatnonzero(block == last)
            if not len(x) or not len(y) or whole and len(x) < 2:
                continue
            n = g.column("n").to_numpy()
            v = g.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(g.num_rows, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            norm = np.sqrt((v * v).sum(axis=1))
            linked = v[x] @ v[y].T / (norm[x][:, None] * norm[y][None, :]) >= cosine
            if whole:
                np.fill_diagonal(linked, False)
            if t and linked.any():  # pairs that meet in an earlier table count there
                f = functions.setdefault(v.shape[1], Hashes(v.shape[1], tables, projections, width, seed))
                own = f.keys(v / norm[:, None])
                for k in range(t):
                    linked &= own[x, k][:, None] != own[y, k][None, :]
            if not linked.any():
                continue
            c = g.column("c").combine_chunks()
            least_x, least_y = _forest(linked, whole)
            places = x if whole else np.concatenate([x, y])
            for rows, least, sums in ((x, least_x, linked @ n[y]), *(() if whole else ((y, least_y, n[x] @ linked),))):
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rows[some])), pa.array(sums[some].astype(np.int64)), c.take(pa.array(places[least[some]]))], ["a", "links", "b"])

    links, _ = stored(dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compared, f"a {kind}, links bigint, b {kind}"))
    found, _ = components(links)
    sums = links.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    of_class = classes.select("y", "h1", "h2", "c", "n").join(sums, "c", "left").join(found.withColumnRenamed("node", "c"), "c", "left").select("y", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "c").alias("component_id"))
    out = rows.select("id", "ok", *(F.when(F.col("ok"), F.col(c)).alias(c) for c in ("y", "h1", "h2"))).join(of_class, ["y", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
