"""Recurrences along a series in time proportional to its rows: chunks of rows are folded by themselves, their effects are
composed over the chunks of a series, and each chunk is then finished from the state before it. All in the JVM.

What one task holds are CHUNK rows, or one state per chunk of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk. Folds append to arrays, which costs the square of this, and nothing more.
CHUNK = 512


def _chunks(df: DataFrame, keys: list[str], time: str, columns: list[str], size: int) -> DataFrame:
    """(keys, _chunk, _rows): the rows of each chunk in order, as structs of time and columns."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.select(*keys, time, *columns, F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("_chunk"))
    return rows.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct(time, *columns))).alias("_rows"))


def _before(chunks: DataFrame, keys: list[str], start: Column, step, value) -> DataFrame:
    """(keys, _chunk, _state): the state before each chunk. step(state, chunk) composes; value(state) is what is kept of it."""
    ends = [c for c in chunks.columns if c.startswith("_end")]
    series = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", *ends))).alias("_c"))
    first = F.struct(start.alias("s"), F.array().cast(f"array<{_kind(series, value(start))}>").alias("out"))
    folded = F.aggregate("_c", first, lambda a, c: F.struct(step(a["s"], c).alias("s"), F.concat(a["out"], F.array(value(a["s"]))).alias("out")), lambda a: a["out"])
    zipped = F.explode(F.arrays_zip(F.col("_c._chunk").alias("_chunk"), folded.alias("_state")))
    return series.select(*keys, zipped.alias("_z")).select(*keys, F.col("_z._chunk").alias("_chunk"), F.col("_z._state").alias("_state"))


def _kind(df: DataFrame, c: Column) -> str:
    return df.select(c.alias("x")).schema["x"].dataType.simpleString()


def linear_scan(df: DataFrame, scans: dict[str, tuple[Column, Column]], keys: tuple[str, ...] = ("group",), time: str = "time", size: int = CHUNK) -> DataFrame:
    """(keys, time, scans...): for each name and its (r, b) the values m of m = r * m_before + b, from m = 0. r and b are not null."""
    keys, names = list(keys), list(scans)
    made = df.select(*keys, time, *(c.cast("double").alias(f"_{k}{i}") for i, n in enumerate(names) for k, c in zip("rb", scans[n])))
    chunks = _chunks(made, keys, time, [f"_{k}{i}" for i in range(len(names)) for k in "rb"], size)
    one = "array<struct<p:double,z:double>>"

    def fold(i: int) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("z"), F.array().cast(one).alias("out"))

        def step(s: Column, x: Column) -> Column:
            p, z = s["p"] * x[f"_r{i}"], s["z"] * x[f"_r{i}"] + x[f"_b{i}"]
            return F.struct(p.alias("p"), z.alias("z"), F.concat(s["out"], F.array(F.struct(p.alias("p"), z.alias("z")))).alias("out"))

        return F.aggregate("_rows", start, step, lambda s: s["out"])

    chunks = chunks.withColumns({f"_out{i}": fold(i) for i in range(len(names))})
    chunks = chunks.withColumn("_end", F.array(*(F.element_at(f"_out{i}", -1) for i in range(len(names)))))
    zero = F.array(*[F.lit(0.0)] * len(names))
    before = _before(chunks.select(*keys, "_chunk", "_end"), keys, zero, lambda s, c: F.zip_with(s, c["_end"], lambda m, e: m * e["p"] + e["z"]), lambda s: s)
    rows = chunks.drop("_end").join(before, [*keys, "_chunk"])
    rows = rows.select(*keys, "_state", F.explode(F.arrays_zip("_rows", *(f"_out{i}" for i in range(len(names))))).alias("_x"))
    return rows.select(*keys, F.col(f"_x._rows.{time}").alias(time), *((F.col(f"_x._out{i}.z") + F.col(f"_x._out{i}.p") * F.col("_state")[i]).alias(n) for i, n in enumerate(names)))


def clipped_walk(df: DataFrame, move: Column, start: float, low: float, high: float, keys: tuple[str, ...] = ("group",), time: str = "time", out: str = "value", size: int = CHUNK) -> DataFrame:
    """(keys, time, out): before each row, the value that started at `start` and took every move, cut to [low, high] each time.

    A run of moves is x -> min(b, max(a, x + d)), and so are two runs after each other.
    """
    keys = list(keys)
    clip = lambda c: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))
    chunks = _chunks(df.select(*keys, time, move.cast("double").alias("_e")), keys, time, ["_e"], size)
    one = "array<struct<d:double,a:double,b:double>>"
    run = lambda d, a, b: F.struct(d.alias("d"), a.alias("a"), b.alias("b"))
    start_run = F.struct(run(F.lit(0.0), F.lit(float("-inf")), F.lit(float("inf"))).alias("f"), F.array().cast(one).alias("out"))

    def step(s: Column, x: Column) -> Column:
        f = s["f"]
        return F.struct(run(f["d"] + x["_e"], clip(f["a"] + x["_e"]), clip(f["b"] + x["_e"])).alias("f"), F.concat(s["out"], F.array(f)).alias("out"))

    apply = lambda f, x: F.least(f["b"], F.greatest(f["a"], x + f["d"]))
    folded = chunks.withColumn("_f", F.aggregate("_rows", start_run, step)).select(*keys, "_chunk", "_rows", F.col("_f.f").alias("_end"), F.col("_f.out").alias("_out"))
    before = _before(folded.select(*keys, "_chunk", "_end"), keys, F.lit(float(start)), lambda s, c: apply(c["_end"], s), lambda s: s)
    rows = folded.drop("_end").join(before, [*keys, "_chunk"]).select(*keys, "_state", F.explode(F.arrays_zip("_rows", "_out")).alias("_x"))
    return rows.select(*keys, F.col(f"_x._rows.{time}").alias(time), apply(F.col("_x._out"), F.col("_state")).alias(out))
