"""Frames that arrive: scoring them, latency over the last ones, and a running rate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordering import ordered

HISTORY = 240
#: Rows of a stream that one task ranks at a time, at least.
RUN = 4096


def score_stream(frames: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that scores each micro-batch and hands it to ``sink``; ``once`` works off what is there and stops.

    A batch that is run again after a failure has the same number, so a sink that overwrites by number writes once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(score(batch), number)

    writer = frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def late_tolerant_counts(frames: DataFrame, time: str, window: str, lateness: str, *by: str) -> DataFrame:
    """Frames by event-time window; those later than ``lateness`` are dropped. A timestamp without zone is taken as UTC's."""
    at = frames.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return at.groupBy(F.window(time, window).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def rolling_median(df: DataFrame, partition: list[str], order: list[str], value: str, last: int = HISTORY) -> DataFrame:
    """``df`` with the median ``rolling_median`` of the last rows of its stream.

    A stream is cut into runs, each with the ``last - 1`` rows before it, so that a long stream is many tasks'.
    """
    size = max(RUN, 4 * last)
    at = F.col("k") - 1
    own = F.floor(at / size)
    ranked = ordered(df, order, {}, by=partition)
    # A row at the end of a run is also among those before the next.
    runs = ranked.withColumn("__run", F.explode(F.when(at % size > size - last, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*partition, "__run").orderBy("k").rowsBetween(1 - last, 0)
    median = runs.withColumn("rolling_median", F.percentile(value, F.lit(0.5)).over(frame))
    return median.where(F.col("__run") == own).select(*df.columns, "rolling_median")


def ema_by(df: DataFrame, partition: list[str], order: list[str], value: str, keep: float = 0.9) -> DataFrame:
    """The final running rate of each stream: ``keep`` of what it was and the rest of each next value, begun by the first.

    A value's share falls by ``keep`` with every one after it, so the rate is a weighted sum and no task holds a stream.
    """
    backwards = [F.desc(c) for c in order]
    at = ordered(df.select(*partition, *order, F.col(value).alias("__x")), backwards, {}, by=partition)
    total = at.groupBy(*partition).agg(F.sum((1 - keep) * F.pow(F.lit(keep), F.col("k") - 1) * F.col("__x")).alias("s"), F.max(F.struct("k", "__x")).alias("first"))
    n = F.col("first.k").cast("long")
    return total.select(*partition, n.alias("n"), (F.col("s") + F.pow(F.lit(keep), n) * F.col("first.__x")).alias("ema"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, the value at the middle or below it, smallest and mean of each group, and how many there are."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.expr(f"percentile_disc(0.5) within group (order by `{value}`)").alias("lower_median"), F.count(value).alias("n"))


def ema_stream(frames: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """The running rate of each key after every micro-batch: one number of state a key. Rows of a batch are folded in order."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        rate, n = state.get if state.exists else (None, 0)
        for x in rows[value].tolist():
            rate, n = x if rate is None else keep * rate + (1 - keep) * x, n + 1
        state.update((rate, n))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [rate]})

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, ema double", "ema double, n long", "update", GroupStateTimeout.NoTimeout)
