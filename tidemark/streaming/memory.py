"""Memory of operators and forecasters over batches of new rows: observe, rewind, and transform or predict as rows come.

The memory of a series are its last `horizon` rows. It is a table, not a collection; where the session has a checkpoint
folder, each new memory is written there, so that its lineage does not grow with the batches. Rows of a batch must follow
the memory without a gap and without an overlap; what does not is an error that names the first such series.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.models.exogenous import rolled
from tidemark.models.forecasters import Forecaster
from tidemark.operators.base import Operator
from tidemark.operators.validation import check_continuity


def _tail(df: DataFrame, op: Operator, n: int) -> DataFrame:
    w = Window.partitionBy(*op.keys).orderBy(F.desc(op.time))
    return df.withColumn("_b", F.row_number().over(w)).filter(F.col("_b") <= n).drop("_b")


def _cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder where there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


@dataclass
class Memory:
    """The last `horizon` rows of every series."""

    op: Operator
    horizon: int
    interval: str | None = None  # of the grid; None: the batches' order alone is checked
    rows: DataFrame | None = None

    def rewind(self, df: DataFrame) -> Memory:
        """Forgets everything but the tail of df."""
        self.rows = _cut(_tail(df, self.op, max(1, self.horizon)))
        return self

    def observe(self, batch: DataFrame) -> Memory:
        if self.rows is None:
            return self.rewind(batch)
        check_continuity(self.rows, batch, self.interval, self.op.keys, self.op.time)
        return self.rewind(self.rows.unionByName(batch.select(*self.rows.columns)))

    def with_batch(self, batch: DataFrame) -> DataFrame:
        return batch if self.rows is None else self.rows.unionByName(batch.select(*self.rows.columns))


@dataclass
class Observing:
    """An operator with a memory: the batches' rows are transformed as if the series had been there as a whole."""

    op: Operator
    horizon: int
    interval: str | None = None
    memory: Memory = field(init=False)

    def __post_init__(self) -> None:
        self.memory = Memory(self.op, self.horizon, self.interval)

    def fit(self, df: DataFrame) -> Observing:
        self.op = self.op.fit(df)
        self.memory.op = self.op
        self.memory.rewind(df)
        return self

    def observe(self, batch: DataFrame) -> Observing:
        self.memory.observe(batch)
        return self

    def rewind(self, df: DataFrame) -> Observing:
        self.memory.rewind(df)
        return self

    def observe_transform(self, batch: DataFrame) -> DataFrame:
        """The transformed rows of the batch alone, with the memory in front of them; the batch is then observed."""
        if self.memory.rows is not None:
            check_continuity(self.memory.rows, batch, self.interval, self.op.keys, self.op.time)
        whole = self.op.transform(self.memory.with_batch(batch))
        out = _cut(whole.join(batch.select(*self.op.index()), self.op.index(), "left_semi"))
        self.memory.rewind(self.memory.with_batch(batch))
        return out

    def rewind_transform(self, df: DataFrame) -> DataFrame:
        """All of df transformed; then the memory is its tail."""
        out = self.op.transform(df)
        self.memory.rewind(df)
        return out


@dataclass
class ObservingForecaster:
    """A fitted forecaster that is told of new rows without being fitted again."""

    model: Forecaster
    horizon: int  # rows of a series that the model looks back on
    strict: bool = True

    def fit(self, df: DataFrame) -> ObservingForecaster:
        self.model = replace(self.model).fit(df)
        self.memory = Memory(self.model, self.horizon, self.model.interval if self.strict else None).rewind(df)
        return self

    def observe(self, batch: DataFrame) -> ObservingForecaster:
        self.memory.observe(batch)
        return self

    def rewind(self, df: DataFrame) -> ObservingForecaster:
        """Back to what was known at the end of df: predictions start from there again."""
        self.memory.rewind(df)
        return self

    def predict(self, horizon: int) -> DataFrame:
        """From the last row of every series' memory."""
        rows = rolled(self.model, self.memory.rows, horizon)
        last = self.memory.rows.groupBy(*self.model.keys).agg(F.max(self.model.time).alias("vintage_time"))
        return rows.join(last, [*self.model.keys, "vintage_time"], "left_semi")

    def observe_predict(self, batch: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
        """Forecasts from every stride-th row of the batch as vintage, its last one among them, in one pass over the memory and
        the batch; the batch is then observed."""
        if self.memory.rows is not None:
            check_continuity(self.memory.rows, batch, self.memory.interval, self.model.keys, self.model.time)
        rows = rolled(self.model, self.memory.with_batch(batch), horizon, stride)
        stamps = batch.select(*self.model.keys, F.col(self.model.time).alias("vintage_time"))
        out = _cut(rows.join(stamps, [*self.model.keys, "vintage_time"], "left_semi"))
        self.memory.rewind(self.memory.with_batch(batch))
        return out


def retained_vintages(forecasts: DataFrame, observed: DataFrame, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """forecasts (keys, vintage_time, time, ...) that still matter after `observed` (keys, time): of each series the newest vintage
    not after its last row whose stamps reach beyond it, and all vintages to come."""
    last = observed.groupBy(*keys).agg(F.max(time).alias("_now"))
    spans = forecasts.groupBy(*keys, "vintage_time").agg(F.max(time).alias("_to")).join(last, list(keys))
    past = spans.filter((F.col("vintage_time") <= F.col("_now")) & (F.col("_to") > F.col("_now"))).groupBy(*keys).agg(F.max("vintage_time").alias("vintage_time"))
    ahead = spans.filter(F.col("vintage_time") > F.col("_now")).select(*keys, "vintage_time")
    return forecasts.join(past.select(*keys, "vintage_time").union(ahead), [*keys, "vintage_time"], "left_semi")


def without_late_rows(stream: DataFrame, delay: str, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """A stream's rows once each, by (keys, time), late ones dropped by the watermark; state is kept for `delay` only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])


def session_counts(stream: DataFrame, gap: str, delay: str, keys: tuple[str, ...] = ("group",), time: str = "time") -> DataFrame:
    """(keys, start, end, n) of sessions, given out once the watermark has passed them."""
    found = stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that writes the stream to Parquet exactly once: the sink's log and the checkpoint make a restart repeat nothing."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
