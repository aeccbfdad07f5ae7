"""Streams of log events: windowed counts, latency, and incremental analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``(start, kind, n, total)`` per window and kind; events later than ``late`` behind the newest are dropped by the watermark.

    Works on a stream and on a table alike; without ``slide`` the windows don't overlap.
    """
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), "kind", "n", "total")


def run_to_end(aggregated: DataFrame, checkpoint: str, folder: str) -> DataFrame:
    """Process what is there, then stop, and return the whole aggregate as a table written to ``folder``.

    A later run with the same checkpoint reads only new files. The result never passes through the driver.
    """
    schema = aggregated.schema

    def replace(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(folder)

    q = aggregated.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return aggregated.sparkSession.read.schema(schema).parquet(folder)


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """Give each micro-batch to ``work`` with its number; a resumed run starts after the last finished batch."""
    q = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def poll(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], every: str = "30 seconds", until: Callable[[], bool] | None = None) -> None:
    """Give what is new to ``work`` at each tick of ``every``; stops once ``until`` says so, or else when all that is there is done."""
    q = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        if until is None:
            q.processAllAvailable()
        else:
            while not until() and q.isActive:
                q.awaitTermination(1)
    finally:
        q.stop()
