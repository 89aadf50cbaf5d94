"""Observe and predict on a stream: each series keeps its last observations in the state store.

The state of a series is bounded by `seasonality` rows, whatever the stream has brought. Rows of a batch are taken in
order of time; a stamp that is not after the last one observed is dropped, as in the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def observe_predict(stream: DataFrame, horizon: int, seasonality: int = 1, key: str = "group", time: str = "time", value: str = "y") -> DataFrame:
    """(key, vintage_time, step, y_hat): after each batch the seasonal-naive forecast of every series it touched.

    A series gives none until it has had `seasonality` observations.
    """

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = state.get if state.exists else (None, [])
        kept = list(kept)
        rows = pd.concat(list(frames)).sort_values(time)
        for at, y in zip(rows[time], rows[value]):
            at = pd.Timestamp(at)
            if last is None or at > pd.Timestamp(last):
                last, kept = at.isoformat(), [*kept, float(y)][-seasonality:]
        state.update((last, kept))
        if len(kept) == seasonality:
            yield pd.DataFrame({key: name[0], "vintage_time": pd.Timestamp(last), "step": range(1, horizon + 1), "y_hat": [kept[(h - 1) % seasonality] for h in range(1, horizon + 1)]}).astype({"step": "int32"})

    kind = stream.schema[key].dataType.simpleString()
    grouped = stream.select(key, F.col(time).cast("timestamp").alias(time), F.col(value).cast("double").alias(value)).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, vintage_time timestamp, step int, y_hat double", "last string, kept array<double>", "update", GroupStateTimeout.NoTimeout)


def downsample(stream: DataFrame, interval: str, delay: str, key: str = "group", time: str = "time", value: str = "y") -> DataFrame:
    """(key, time, mean, n) of tumbling windows, given out once the watermark has passed them."""
    return stream.withWatermark(time, delay).groupBy(key, F.window(time, interval)).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(key, F.col("window.start").alias(time), "mean", "n")


def read_series(spark, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
