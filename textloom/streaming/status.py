"""Statuses and errors of jobs, and claims of instructions, over batches or streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE, ERRORS, MILESTONES = 2000, 100, 20


def latest(events: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """The values of each key's last event. The same on a stream, in complete or update mode."""
    return events.groupBy(key).agg(*[F.max_by(v, at).alias(v) for v in values])


def unique_errors(errors: DataFrame, order: str, most: int = ERRORS) -> DataFrame:
    """The first of each message, cut to MESSAGE characters; the first `most` of them."""
    cut = errors.withColumn("message", F.substring("message", 1, MESSAGE))
    return cut.groupBy("message").agg(F.min(order).alias(order)).orderBy(order).limit(most)


def milestones(events: DataFrame, key: str, at: str, what: str, most: int = MILESTONES) -> DataFrame:
    """The last events of each key, newest first."""
    from pyspark.sql import Window

    ranked = events.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at))))
    return ranked.where(F.col("rank") <= most).select(key, "rank", what)


def windowed_errors(events: DataFrame, ts: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of event types by window; on a stream with late rows up to the delay."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """What a stream has now, batch by batch into sink; the next call goes on from there."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_by_near_key(stream: DataFrame, text: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Near-duplicates dropped over all batches of a stream; keys older than the delay are forgotten."""
    from ..operators.dedupe import near_key

    return stream.withColumn("near_key", near_key(F.col(text))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["near_key"])
