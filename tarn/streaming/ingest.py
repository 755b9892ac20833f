"""Results and events as streams: keyed merges and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.merges import merged


def newest_per_key(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return rows.withColumn("_back", F.row_number().over(last)).where("_back = 1").drop("_back")


def merge_stream(
    stream: DataFrame,
    keys: list[str],
    at: str,
    read: Callable[[], DataFrame | None],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> StreamingQuery:
    """Merge each batch of arriving rows into a table, newest row of a key first.

    ``read`` gives the table's latest version or None, ``write`` stores the next
    one under the batch's number; a batch that runs again writes the same version.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = newest_per_key(batch, keys, at)
        old = read()
        write(new if old is None else merged(old, new, keys), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by time window and type; works on streams and on tables."""
    seen = events
    if events.isStreaming:  # a watermark needs an instant
        seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        seen.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "value")
    )
