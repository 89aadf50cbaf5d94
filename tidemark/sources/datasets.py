"""Named series archives, and synthetic data with exogenous columns.

An archive is a zip or text file in the TSF format that somebody has put into the data folder under the dataset's name; this
library fetches nothing. It is read by Spark, kept as Parquet beside it, and read from there the next time. A Parquet
copy that cannot be read is made anew.
"""

from __future__ import annotations

import os
import shutil
import zipfile
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import Interval
from tidemark.sources.tsf import read_tsf


@dataclass(frozen=True)
class Dataset:
    """Rows (series_name, time, value) of an archive; n_series: how many series are read unless the caller says so."""

    name: str
    frequency: str
    n_series: int | None = None


DATASETS = {
    d.name: d
    for d in (
        Dataset("tourism_monthly", "1mo"),
        Dataset("tourism_quarterly", "1q"),
        Dataset("sunspot", "1d"),
        Dataset("electricity_demand", "30min"),
        Dataset("dominick", "1w", 50),
        Dataset("pedestrian_counts", "1h", 20),
        Dataset("hospital", "1mo"),
        Dataset("kdd_cup", "1h"),
    )
}
#: Measurements of the air-quality archive, and the limits of its classes.
MEASUREMENTS = ("pm2.5", "pm10", "no2", "co", "o3", "so2")
AIR_LIMITS = ((15.0, "good"), (35.0, "moderate"), (75.0, "unhealthy"), (None, "hazardous"))
#: Month and day of the holidays in synthetic data.
HOLIDAYS = ((1, 1), (1, 6), (1, 8), (1, 15), (2, 19), (3, 29), (4, 1), (5, 1), (5, 27), (7, 4), (9, 2), (11, 28), (12, 25), (12, 26))


def data_home(path: str | None = None) -> str:
    """The folder of archives, made if it is not there: path, or TIDEMARK_DATA, or ~/tidemark_data."""
    out = os.path.expanduser(path or os.environ.get("TIDEMARK_DATA") or "~/tidemark_data")
    os.makedirs(out, exist_ok=True)
    return out


def clear_data_home(path: str | None = None) -> None:
    """Deletes the Parquet copies; archives stay."""
    home = data_home(path)
    for name in DATASETS:
        shutil.rmtree(os.path.join(home, f"{name}.parquet"), ignore_errors=True)


def _archive(name: str, home: str) -> str:
    """The text file of a dataset: as it is, or taken out of its zip."""
    text = os.path.join(home, f"{name}.tsf")
    packed = os.path.join(home, f"{name}.zip")
    if not os.path.exists(text) and os.path.exists(packed):
        with zipfile.ZipFile(packed) as z:
            inner = [n for n in z.namelist() if n.endswith(".tsf")]
            if len(inner) != 1:
                raise ValueError(f"{packed} holds {len(inner)} series files")
            part = f"{text}.part"
            with z.open(inner[0]) as source, open(part, "wb") as target:
                shutil.copyfileobj(source, target)
            os.replace(part, text)
    if not os.path.exists(text):
        raise FileNotFoundError(f"put {name}.tsf or {name}.zip into {home}")
    return text


def fetch(spark: SparkSession, name: str, n_series: int | None = None, home: str | None = None) -> DataFrame:
    """(series_name, time, value) of a named archive."""
    if name not in DATASETS:
        raise ValueError(f"no dataset {name!r}; there are {', '.join(sorted(DATASETS))}")
    n_series = n_series or DATASETS[name].n_series
    folder = data_home(home)
    kept = os.path.join(folder, f"{name}.parquet")
    try:
        rows = spark.read.parquet(kept)
    except PySparkException:
        read_tsf(spark, _archive(name, folder)).write.mode("overwrite").parquet(kept)
        rows = spark.read.parquet(kept)
    if n_series is None:
        return rows
    first = rows.select("series_name").distinct().orderBy(F.length("series_name"), "series_name").limit(n_series)
    return rows.join(first, "series_name", "left_semi")


def fetch_kdd_cup(spark: SparkSession, n_groups: int | None = 5, home: str | None = None) -> DataFrame:
    """(station, measurement, time, value): names of series split at the measurement that ends them."""
    rows = fetch(spark, "kdd_cup", home=home)
    by_length = sorted(MEASUREMENTS, key=len, reverse=True)
    measured = F.coalesce(*(F.when(F.lower("series_name").endswith(f"_{m}"), F.lit(m)) for m in by_length))
    rows = rows.withColumn("measurement", measured)
    rows = rows.withColumn("station", F.when(F.col("measurement").isNull(), F.col("series_name")).otherwise(F.expr("left(series_name, length(series_name) - length(measurement) - 1)")))
    if n_groups is not None:
        first = rows.select("station").distinct().orderBy("station").limit(n_groups)
        rows = rows.join(first, "station", "left_semi")
    return rows.select("station", "measurement", "time", "value")


def below(value: Column, limits: tuple) -> Column:
    """The label of the first limit that value is less than; the last one has none."""
    out = F.lit(limits[-1][1])
    for limit, label in reversed(limits[:-1]):
        out = F.when(value < limit, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def air_quality_classes(spark: SparkSession, home: str | None = None) -> DataFrame:
    """(time, air_quality, pm10, no2, co, o3, so2) of the first station that has all measurements; rows without a target go."""
    rows = fetch_kdd_cup(spark, None, home)
    whole = rows.groupBy("station").agg(F.count_distinct("measurement").alias("n")).filter(F.col("n") == len(MEASUREMENTS)).orderBy("station").limit(1).select("station")
    wide = rows.join(whole, "station", "left_semi").groupBy("time").agg(*(F.max(F.when(F.col("measurement") == m, F.col("value"))).alias(m.replace(".", "_")) for m in MEASUREMENTS))
    return wide.filter("pm2_5 is not null").select("time", below(F.col("pm2_5"), AIR_LIMITS).alias("air_quality"), *(m for m in MEASUREMENTS if m != "pm2.5"))


def demand_classes(spark: SparkSession, series: str | None = None, home: str | None = None) -> DataFrame:
    """(time, demand): low, medium or high, by the thirds of one series' values; the first by name where none is given."""
    rows = fetch(spark, "electricity_demand", home=home).filter("value is not null")
    name = series or rows.agg(F.min("series_name")).first()[0]
    own = rows.filter(F.col("series_name") == name)
    cuts = own.agg(F.percentile("value", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
    label = F.when(F.col("value") <= cuts[0], "low").when(F.col("value") <= cuts[1], "medium").otherwise("high")
    return own.select("time", label.alias("demand"))


def holiday(time: str = "time") -> Column:
    """1.0 on the holidays of synthetic data."""
    return (F.month(time) * 100 + F.dayofmonth(time)).isin([100 * m + d for m, d in HOLIDAYS]).cast("double")


@dataclass
class Bundle:
    """A target with covariates known up to now, known in advance, and forecast by vintages."""

    y: DataFrame
    actual: DataFrame
    future: DataFrame
    forecasts: DataFrame
    frequency: str = "1h"
    classes: list[str] = field(default_factory=list)


def _hours(spark: SparkSession, n: int) -> DataFrame:
    at = Interval.parse("1h").after(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("id"))
    return spark.range(n).select(F.lit("_").alias("group"), F.col("id").alias("_i"), at.alias("time")).withColumn("is_holiday", holiday())


def forecast_grid(rows: DataFrame, n: int, horizon: int) -> DataFrame:
    """(group, vintage_time, time, _i): from the row `horizon` on, every row as a vintage of the stamps after it that are there."""
    i = Interval.parse("1h")
    grid = rows.filter(F.col("_i") >= horizon).select("group", F.col("time").alias("vintage_time"), F.col("_i").alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    return grid.withColumn("_i", F.col("_v") + F.col("_h")).filter(F.col("_i") < n).select("group", "vintage_time", i.after(F.col("vintage_time"), F.col("_h")).alias("time"), "_i", "_h")


def _bundle(rows: DataFrame, n: int, horizon: int, y: Column, label: str, actual: str, forecast: str, bias: float, spread: float, seed: int) -> Bundle:
    made = forecast_grid(rows, n, horizon).join(rows.select("_i", actual), "_i")
    forecasts = made.select("group", "vintage_time", "time", (F.col(actual) + bias + spread * F.randn(seed + 3)).alias(forecast))
    return Bundle(rows.select("group", "time", y.alias(label)), rows.select("group", "time", actual), rows.select("group", "time", "is_holiday"), forecasts)


def exogenous_regression(spark: SparkSession, n_samples: int = 200, horizon: int = 6, noise: float = 0.1, bias: float = 0.5, seed: int = 42) -> Bundle:
    """Hourly prices: 50 + 2 temperature + 10 holiday + noise. The temperature has a daily cycle; its forecasts are biased."""
    rows = _hours(spark, n_samples).withColumn("temperature", 15 + 5 * F.sin(2 * F.pi() * F.col("_i") / 24) + 0.5 * F.randn(seed))
    price = 50 + 2 * F.col("temperature") + 10 * F.col("is_holiday") + noise * F.randn(seed + 1)
    return _bundle(rows, n_samples, horizon, price, "price", "temperature", "wx_temp", bias, 0.3, seed)


def exogenous_classification(spark: SparkSession, n_samples: int = 200, horizon: int = 6, noise: float = 1.0, bias: float = 0.5, seed: int = 42) -> Bundle:
    """Hourly air quality, good, moderate or poor, by a pollutant with a daily cycle that is lower on holidays."""
    rows = _hours(spark, n_samples).withColumn("pollutant", 50 + 20 * F.sin(2 * F.pi() * F.col("_i") / 24) + 5 * F.randn(seed))
    felt = F.col("pollutant") - 5 * F.col("is_holiday") + noise * F.randn(seed + 1)
    out = _bundle(rows, n_samples, horizon, below(felt, ((40.0, "good"), (60.0, "moderate"), (None, "poor"))), "air_quality", "pollutant", "pollutant_forecast", bias, 2.0, seed)
    out.classes = ["good", "moderate", "poor"]
    return out
