"""Streaming ingest of captured responses: gate on arrival, first response of each URL. An extension; batch operators are the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gate import verdict

SCHEMA = T.StructType().add("url", "string").add("engine", "string").add("data", "binary").add("content_type", "string").add("status", "integer").add("captured", "timestamp")


def incoming(spark: SparkSession, path: str, files: int = 1000, visit: str | None = None) -> DataFrame:
    """A stream of response files as they come, with the number of a url's visit if its column is named."""
    schema = T.StructType([*SCHEMA, T.StructField(visit, T.LongType())]) if visit else SCHEMA
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def accepted(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Passing responses, the first of each URL within the watermark; state is dropped beyond it."""
    kind = verdict(F.col("status"), F.col("data"), F.col("content_type"), F.col("url"))
    return stream.withColumn("kind", kind).where("kind IS NULL").drop("kind").withWatermark("captured", late).dropDuplicatesWithinWatermark(["url"])


def failures(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Failures by window and kind."""
    kind = verdict(F.col("status"), F.col("data"), F.col("content_type"), F.col("url"))
    return stream.withColumn("kind", kind).where("kind IS NOT NULL").withWatermark("captured", late).groupBy(F.window("captured", window), "kind").count()


def run(df: DataFrame, path: str, checkpoint: str):
    """Writes what there is and stops; the next call goes on from there."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
