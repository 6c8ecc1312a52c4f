"""Extensions over streams: event-time windows, incremental ingest, counts of accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in each window of event time; later than ``late`` is too late, in a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    counts = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each user's sessions, which end after a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    counts = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counts.select("user_id", F.col("w.start").alias("session_start"), "events")


def read_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def ingest(stream: DataFrame, table_path: str, checkpoint: str, key: str = "id"):
    """Appends each batch's rows that the table doesn't have yet, once by key; runs until nothing new is there."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates([key])
        try:
            rows = rows.join(spark.read.parquet(table_path).select(key), key, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        rows.write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
