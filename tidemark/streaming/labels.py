"""Streams of labels: snapshots that grow as labels are released.

In ``running_release_counts`` and ``windowed_counts`` event time is the release. ``replay_to_table`` writes each batch's labels
exactly once, by batch id, so that a restarted query doesn't count one twice. ``releases`` takes labels as they
arrive, holds each in keyed state and gives it out when event time, the arrivals' watermark, reaches its release: what has
come out by then is the snapshot, and a label isn't there a day early.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

DAY_MS = 86_400_000
RELEASED = "instrument string, observed_day long, released_day long, value double, status string"
#: Timers need a store that can be read in the order of time.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def label_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Labels from a folder of Parquet files, a few files for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def released_at(labels: DataFrame, epoch: str) -> DataFrame:
    """``labels`` with the release as a timestamp, which event-time operators need."""
    return labels.withColumn("released_at", F.timestamp_add("DAY", F.col("released_day"), F.to_timestamp(F.lit(epoch))))


def running_release_counts(labels: DataFrame, epoch: str, lateness: str = "0 seconds") -> DataFrame:
    """(released_day, n, total): an aggregation by release day with a watermark, so that old days leave the state."""
    timed = released_at(labels, epoch).withWatermark("released_at", lateness)
    return timed.groupBy(F.window("released_at", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select((F.datediff(F.col("window.start"), F.lit(epoch))).cast("long").alias("released_day"), "n", "total")


def windowed_counts(labels: DataFrame, epoch: str, length: str, slide: str, lateness: str = "0 seconds") -> DataFrame:
    """Sliding windows over releases, the streaming form of a trailing training window."""
    timed = released_at(labels, epoch).withWatermark("released_at", lateness)
    return timed.groupBy(F.window("released_at", length, slide)).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def replay_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Consumes what there is of the stream; batch k is written to ``path/batch=k``, anew if it is repeated."""

    def save(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Releases(StatefulProcessor):
    """Of one instrument: labels held by observed day until their release.

    A label that arrives on its release day or later comes out at once as ``late``; a second label of a day whose first is
    held comes out as ``repeated``, and the first one stays. State holds what is not released yet, no more.
    """

    def __init__(self, epoch_ms: int) -> None:
        self.epoch_ms = epoch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "observed_day long", "released_day long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            if r.released_day is None:  # only moves time on
                continue
            day = (r.observed_day,)
            if r.arrived_day >= r.released_day:
                yield self._out(key, r.observed_day, r.released_day, r.value, "late")
            elif self.held.containsKey(day):
                yield self._out(key, r.observed_day, r.released_day, r.value, "repeated")
            else:
                self.held.updateValue(day, (r.released_day, r.value))
                self.handle.registerTimer(self.epoch_ms + r.released_day * DAY_MS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = (expiredTimerInfo.getExpiryTimeInMs() - self.epoch_ms) // DAY_MS
        for (day,), (released_day, value) in sorted((tuple(k), tuple(v)) for k, v in self.held.iterator()):
            if released_day <= now:
                self.held.removeKey((day,))
                yield self._out(key, day, released_day, value, "released")

    def close(self) -> None:
        pass

    @staticmethod
    def _out(key: tuple, day: int, released_day: int, value: float, status: str) -> Row:
        return Row(instrument=key[0], observed_day=day, released_day=released_day, value=value, status=status)


def releases(arrivals: DataFrame, epoch: str = "2024-01-01", lateness: str = "0 seconds") -> DataFrame:
    """(instrument, observed_day, released_day, value, status) of a stream (instrument, observed_day, released_day, value, arrived_day).

    Time is the latest arrival less ``lateness``; rows that arrive further behind it are dropped by the watermark. A row
    without a release day only moves time on.
    """
    for name, value in STORE.items():
        arrivals.sparkSession.conf.set(name, value)
    timed = arrivals.withColumn("arrived_at", F.timestamp_add("DAY", F.col("arrived_day"), F.to_timestamp(F.lit(epoch)))).withWatermark("arrived_at", lateness)
    epoch_ms = int(arrivals.sparkSession.range(1).select(F.unix_millis(F.to_timestamp(F.lit(epoch)))).first()[0])
    return timed.groupBy("instrument").transformWithState(Releases(epoch_ms), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Consumes what there is of the stream into a folder of Parquet files whose log names each batch's files once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
