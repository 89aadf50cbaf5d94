"""TSF text archives: header directives, then one line per series with its values.

    @attribute series_name string
    @attribute start_timestamp date
    @frequency daily
    @data
    T1:2020-01-01 00-00-00:1.0,2.0,?

A file is read as text in Spark and exploded to (series_name, time, value); `?` is null. Only the header is read first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import Interval

#: Frequency words of the format.
FREQUENCIES = {"4_seconds": "4s", "minutely": "1min", "10_minutes": "10min", "half_hourly": "30min", "hourly": "1h", "daily": "1d", "weekly": "1w", "monthly": "1mo", "quarterly": "1q", "yearly": "1y"}


@dataclass
class Header:
    attributes: list[tuple[str, str]] = field(default_factory=list)
    frequency: str | None = None
    horizon: int | None = None
    missing: bool = False
    equal_length: bool = False


def read_header(spark: SparkSession, path: str, most_lines: int = 1000) -> Header:
    """The directives before @data."""
    out = Header()
    for row in spark.read.text(path, wholetext=False).limit(most_lines).toLocalIterator():
        line = row[0].strip()
        if line.lower() == "@data":
            return out
        word, _, rest = line.partition(" ")
        word, rest = word.lower(), rest.strip()
        if word == "@attribute":
            name, _, kind = rest.partition(" ")
            out.attributes.append((name, kind.strip().lower()))
        elif word == "@frequency":
            out.frequency = rest
        elif word == "@horizon":
            out.horizon = int(rest)
        elif word in ("@missing", "@equallength"):
            setattr(out, "missing" if word == "@missing" else "equal_length", rest.lower() == "true")
    raise ValueError(f"{path} has no @data")


def read_tsf(spark: SparkSession, path: str, n_series: int | None = None, value: str = "value") -> DataFrame:
    """(attributes..., time, value) in long form; series without a start count from 1970-01-01."""
    header = read_header(spark, path)
    interval = Interval.parse(FREQUENCIES[header.frequency] if header.frequency else "1d")
    names = [n for n, _ in header.attributes]
    data = spark.read.text(path).filter(F.col("value").contains(":") & ~F.ltrim("value").startswith("@") & ~F.ltrim("value").startswith("#"))
    if n_series is not None:
        data = data.limit(n_series)
    parts = F.split(F.trim("value"), ":")
    rows = data.select(*(F.get(parts, i).alias(n) for i, n in enumerate(names)), F.posexplode(F.split(F.element_at(parts, -1), ",")).alias("_k", "_v"))
    start = next((n for n, kind in header.attributes if kind == "date"), None)
    origin = F.to_timestamp_ntz(F.col(start), F.lit("yyyy-MM-dd HH-mm-ss")) if start else F.lit("1970-01-01").cast("timestamp_ntz")
    x = F.trim("_v")
    return rows.select(*(n for n in names if n != start), interval.after(origin, F.col("_k")).alias("time"), F.when(x.isin("?", "", "NaN"), None).otherwise(x).cast("double").alias(value))


def write_tsf(df: DataFrame, path: str, frequency: str, name: str = "series_name", time: str = "time", value: str = "value") -> None:
    """One text folder of a long table, whose header is a file of its own that sorts first."""
    spark = df.sparkSession
    lines = df.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(time, value))).alias("_r"))
    body = lines.select(F.concat_ws(":", F.col(name), F.date_format(F.col("_r")[0][time], "yyyy-MM-dd HH-mm-ss"), F.array_join(F.transform("_r", lambda r: F.coalesce(r[value].cast("string"), F.lit("?"))), ",")).alias("value"))
    head = [f"@attribute {name} string", "@attribute start_timestamp date", f"@frequency {frequency}", "@data"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/0-head")
    body.write.text(f"{path}/1-data")


def labelled(df: DataFrame, cuts: list[float], labels: list[str], value: str = "value") -> DataFrame:
    """df with a label column by ordered thresholds; rows without a value are left out."""
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        out = F.when(F.col(value) <= cut, label).otherwise(out)
    return df.filter(F.col(value).isNotNull()).withColumn("label", out)


def quantile_labelled(df: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    """labelled() at the quantiles that cut the values into equal shares."""
    shares = [i / len(labels) for i in range(1, len(labels))]
    cuts = df.agg(F.percentile(value, F.array(*map(F.lit, shares)))).first()[0]
    return labelled(df, list(cuts), labels, value)


def synthetic(spark: SparkSession, groups: int = 2, length: int = 200, interval: str = "1d", seed: int = 42) -> DataFrame:
    """(group, time, y, x): a seasonal series with noise that depends on a covariate. Rows are made in place."""
    i = Interval.parse(interval)
    rows = spark.range(groups * length).select((F.col("id") % groups).cast("string").alias("group"), F.floor(F.col("id") / groups).cast("int").alias("k"))
    x = F.sin(F.col("k") / 5.0)
    return rows.select("group", i.after(F.lit("2021-01-01").cast("timestamp_ntz"), F.col("k")).alias("time"), (10 + 3 * F.sin(2 * F.pi() * F.col("k") / 7) + 2 * x + 0.1 * F.randn(seed)).alias("y"), x.alias("x"))
