"""Streaming wrappers (not in the matched feature set): requests quoted as they
arrive, and sessions that end a fixed time after they began."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def quote_stream(requests: DataFrame, quote: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of request lines through ``quote``, written once to a
    folder of its own: a batch that is tried again replaces what it wrote."""

    def batch(lines: DataFrame, number: int) -> None:
        quote(lines).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )
