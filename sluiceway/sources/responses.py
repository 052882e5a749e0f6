"""Captured responses and URL lists as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gate import MAX_BYTES, keep_first

RESPONSE = T.StructType().add("url", "string").add("engine", "string").add("data", "binary").add("content_type", "string").add("status", "integer")


def url_list(spark: SparkSession, text: str) -> DataFrame:
    """(ord, url) of a JSON array of URLs, each once, in order; an empty array has no rows."""
    one = spark.range(1).select(F.posexplode(F.from_json(F.lit(text), T.ArrayType(T.StringType()))).alias("ord", "url"))
    return keep_first(one, ["url"], ["ord"])


def captured(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of captured responses."""
    return spark.read.schema(RESPONSE).parquet(path)


def files(spark: SparkSession, path: str, pattern: str = "*", engine: str = "http") -> DataFrame:
    """Files as responses of status 200; those over MAX_BYTES are failures: their bytes are not read, and error_class is TooLarge."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    kind = F.when(F.endswith(F.lower("path"), F.lit(".pdf")), "application/pdf").when(F.rlike(F.lower("path"), F.lit(r"\.html?$")), "text/html").otherwise("application/octet-stream")
    row = [F.col("path").alias("url"), F.lit(engine).alias("engine")]
    small = df.where(F.col("length") <= MAX_BYTES).select(*row, F.col("content").alias("data"), kind.alias("content_type"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error_class"))
    large = df.where(F.col("length") > MAX_BYTES).select(*row, F.lit(None).cast("binary").alias("data"), kind.alias("content_type"), F.lit(0).alias("status"), F.lit("TooLarge").alias("error_class"))
    return small.unionByName(large)


def sheet(responses: DataFrame, urls: DataFrame) -> DataFrame:
    """Outcomes in the order of a URL list; a URL without response is an error."""
    out = urls.join(responses, "url", "left")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("engine_used").isNull(), F.lit("missing")))) if "error" in responses.columns else out


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out, as absent ones are."""
    df.write.mode("errorifexists").option("ignoreNullFields", "true").json(path)


def as_json(df: DataFrame, order: str) -> DataFrame:
    """A single JSON array of all rows, in order: for results of a page, not of a corpus."""
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != order]))
    return df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, row.alias("j")))), lambda x: x["j"]), ", "), F.lit("]")).alias("json"))
