"""Windowed totals over unbounded input, with watermarks for late rows and one row a key at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_totals(events: DataFrame, time: str, value: str, keys: Sequence[str], width: str, slide: str | None = None, late: str | None = None, once: Sequence[str] = ()) -> DataFrame:
    """Rows (window, keys, n, total), tumbling or sliding. ``late``: how long a window waits for late rows; ``once``: columns that identify a row that may come twice.

    Works on batch and streaming input alike. Defined cases: rows with a null time belong to no window; null values add nothing; null keys form a group.
    """
    rows = events.withWatermark(time, late) if late else events
    if once:
        rows = rows.dropDuplicatesWithinWatermark(list(once)) if late and events.isStreaming else rows.dropDuplicates(list(once))
    return rows.groupBy(F.window(time, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def session_totals(events: DataFrame, time: str, value: str, keys: Sequence[str], gap: str, late: str | None = None) -> DataFrame:
    """Rows (window, keys, n, total) for sessions that end after ``gap`` without a row."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).withColumnRenamed("session_window", "window")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there in append mode and stop; a later call goes on from the checkpoint."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
