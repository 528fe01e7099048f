"""Structured Streaming: windows of late events, and judgements that resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lekhya.sources.files import exists


def files(spark: SparkSession, folder: str, schema: T.StructType | str, per_batch: int = 64) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def windows(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum per window and key; rows later than the watermark are dropped, repeats of ``event_id`` within it count once."""
    marked = events.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return marked.groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def closed(events: DataFrame, time: str, keys: list[str], measures: dict[str, Column], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """``measures`` per window and keys, each window once when the watermark has passed it; rows that come later are dropped, so state holds open windows only. For sinks in append mode."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(*(c.alias(k) for k, c in measures.items()))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, *measures)


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def resumed(items: DataFrame, key: str, judge: Callable[[DataFrame], DataFrame], results: str, checkpoint: str) -> StreamingQuery:
    """Judge what arrives and append it to ``results``: items judged already are skipped, so a batch run again after a failure adds nothing twice."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        todo = rows.dropDuplicates([key])
        if exists(spark, results):
            todo = todo.join(spark.read.parquet(results).select(key), key, "left_anti")
        judge(todo).write.mode("append").parquet(results)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
