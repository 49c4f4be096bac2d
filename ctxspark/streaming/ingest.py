"""Structured Streaming variants: counts by kind kept current by micro-batches, windowed counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def file_stream(spark: SparkSession, pattern: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files that match a glob, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def ingest_counts(stream: DataFrame, key: str, out: str, checkpoint: str) -> DataFrame:
    """Drain a stream into partial counts per batch below `out`, and return their sums.

    A batch writes its own folder and overwrites it when it is run again after a failure, so no row is
    counted twice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema(f"{key} string, n long, total double").parquet(f"{out}/batch=*")
    return parts.groupBy(key).agg(F.sum("n").alias("events"), F.round(F.sum("total"), 4).alias("total"))


def windowed(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window and kind; rows later than the watermark are left out."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("events"))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
