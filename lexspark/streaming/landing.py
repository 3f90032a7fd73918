"""Optional landing stream: documents arriving as files, and job states folded from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the Parquet files that arrive below a path."""
    return spark.readStream.schema(schema).parquet(path)


def job_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window of event time; later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def start(stream: DataFrame, transform, path: str, checkpoint: str):
    """Writes transform(batch) once per batch: a retried batch replaces its own folder, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
