"""The streaming aggregation run over the events as they lie in the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.operators.registry import QUERIES, SQL
from lekhya.plans import shared_folder
from lekhya.sources import table
from lekhya.sources.files import exists
from lekhya.streaming import incremental


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows by a stream over the whole events table, its last state written in full by each batch.

    All events that are there form one bounded run (``availableNow``); the watermark is wider than the data, so none is
    late. State and result lie in the shared checkpoint folder.
    """
    folder = shared_folder(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    counted = incremental.windows(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", late="3650 days")

    def publish(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/result")

    counted.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/result")
    return found.selectExpr("cast(window_start as timestamp_ntz) as window_start", "event_type", "n", "round(total, 4) as total")


QUERIES["stream_event_windows"] = stream_event_windows
SQL["stream_event_windows"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2"


def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements per day and export by a stream that takes them as they were loaded, half a month a batch.

    The watermark is a day behind the latest evaluation seen. A row loaded so late that its day was closed two
    batches ago is dropped, and days still open at the end aren't told. Staging, state and result lie in the shared folder.
    """
    folder = shared_folder(spark, "stream")
    rows = table(spark, sf_dir, "correctness_results").select("result_id", "export_source", F.col("evaluated_at").cast("timestamp").alias("evaluated_at"), (F.date_trunc("month", "loaded_at") + F.when(F.dayofmonth("loaded_at") > 15, F.expr("interval 15 days")).otherwise(F.expr("interval 0 days"))).alias("part"))
    for r in rows.select("part").distinct().orderBy("part").collect():  # a row a part
        rows.filter(F.col("part").eqNullSafe(F.lit(r.part))).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/arrived")
    if not exists(spark, f"{folder}/arrived"):
        rows.drop("part").write.parquet(f"{folder}/arrived")
    arrived = incremental.files(spark, f"{folder}/arrived", rows.drop("part").schema, per_batch=1)
    days = incremental.closed(arrived, "evaluated_at", ["export_source"], {"n": F.count(F.lit(1))}, late="1 day")
    days.writeStream.format("parquet").option("path", f"{folder}/result").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{folder}/result").selectExpr("cast(window_start as timestamp_ntz) as window_start", "export_source", "n")


QUERIES["stream_closed_days"] = stream_closed_days
SQL["stream_closed_days"] = """
WITH r AS (SELECT date_trunc('month', loaded_at) + CASE WHEN day(loaded_at) > 15 THEN INTERVAL 15 DAY ELSE INTERVAL 0 DAY END AS part, date_trunc('day', evaluated_at) AS day, evaluated_at, export_source FROM correctness_results), b AS (SELECT part, max(evaluated_at) AS top FROM r GROUP BY part),
m AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark FROM b)
SELECT CAST(day AS TIMESTAMP) AS window_start, export_source, count(*) AS n FROM r JOIN m USING (part) WHERE mark IS NULL OR day + INTERVAL 1 DAY > mark GROUP BY day, export_source HAVING day + INTERVAL 1 DAY <= (SELECT max(top) - INTERVAL 1 DAY FROM b)"""
