"""Streaming forms of the rollups and of incremental refresh.

Defined results: events later than the watermark are dropped by the stream and counted nowhere;
null times are dropped; repeated deliveries of a batch replace their earlier result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_usage(events: DataFrame, at: str = "ts", tool: str = "event_type", tokens: str = "value", late: str = "1 day") -> DataFrame:
    """Calls and tokens per UTC day and tool; a day is final once the watermark has passed it."""
    e = events.where(F.col(at).isNotNull()).withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(F.window("_t", "1 day"), F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tool", "calls", "tokens")


def quiet_periods(changes: DataFrame, key: str = "repo_path", at: str = "ts", gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """One row per burst of changes of a key, emitted after ``gap`` of quiet: the debounced refresh."""
    e = changes.where(F.col(at).isNotNull() & F.col(key).isNotNull()).withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(F.session_window("_t", gap), F.col(key)).agg(F.count("*").alias("changes"))
    return g.select(key, F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "changes")


def refresh_on_change(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Runs ``apply(batch, number)`` on every micro-batch; with ``every`` it keeps polling, else it
    takes what is there and stops. The number makes a repeated batch recognisable."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def append_result(stream: DataFrame, folder: str, checkpoint: str):
    """Final rows appended to a Parquet folder, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
