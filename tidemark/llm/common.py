"""What the training-data operators share: Arrow text as numpy bytes, and tables in the cluster's shared folder.

Nulls in a text column count as empty texts everywhere in this package.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Limits of one Arrow batch handed to Python: rows, and bytes (one row may be longer than that). Arrays of 8 bytes a byte are made of it.
BATCH_ROWS = 2_000
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> None:
    """Cut Arrow batches by bytes too, as texts differ in length by orders of magnitude; a caller's own setting stays."""
    known = spark._jsparkSession.sessionState().conf()
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", n_bytes)):
        if not known.contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, where it may be unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when the query ends: each is run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df to the shared folder; return it reread, with a cut lineage, and its path.

    The table goes when removed() is called, or with the application: results that a caller reads later stay until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_clear)
    _LEFT[path] = spark
    with without_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Tables that are still there, and their sessions.
_LEFT: dict[str, SparkSession] = {}


def _clear() -> None:
    """Delete what is left when the driver ends; the JVM may be gone by then."""
    with contextlib.suppress(Exception):
        for path, spark in list(_LEFT.items()):
            removed(spark, path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by stored() that no later plan reads."""
    jvm = spark._jvm
    for path in filter(None, paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        _LEFT.pop(path, None)


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """df with a unique, not null _row (bigint): the key, or a larger number of their own for rows without a key or with one
    that is met again. These rows (few or none, as a rule) are stored, and are the second table; None: there are none."""
    repeated, _ = stored(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    odd = df.join(repeated, key, "left_semi").select(*df.columns).union(df.filter(F.col(key).isNull()))
    largest = df.agg(F.coalesce(F.max(key).cast("bigint"), F.lit(0))).first()[0]
    odd, path = stored(odd.withColumn("_row", F.monotonically_increasing_id() + F.lit(max(largest, -1) + 1)))
    if odd.isEmpty():
        removed(df.sparkSession, path)
        return df.withColumn("_row", F.col(key).cast("bigint")), None
    even = df.filter(F.col(key).isNotNull()).join(repeated, key, "left_anti").select(*df.columns, F.col(key).cast("bigint").alias("_row"))
    return even.union(odd), odd


def extended(schema: StructType, more: str) -> StructType:
    """schema with the columns of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column back to back, and where each row starts (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if large else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of [start, start + length) of every row, back to back."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_ODD = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                out = np.empty(size, np.uint64)
                out[0], done = 1, 1
                while done < size:
                    more = min(done, size - done)
                    out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
                    done += more
                _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with span_hashes(S, a, b) a polynomial hash of values[a:b]; values are mixed first."""
    _, down = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * down[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [a, b), alike for equal spans of equal length wherever they lie."""
    up, _ = powers(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[b] - sums[a]) * up[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: A random 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those that have rows."""
    return (x for x in frames if x.num_rows)


def groups_of(frames: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for x in batches(frames):
        keys = x.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(x.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
