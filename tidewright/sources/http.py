"""Bodies of HTTP streams that have landed as files: bytes, text, lines, JSON lines, server-sent events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from .files import read_bytes, read_text


def body_bytes(spark: SparkSession, path: str) -> DataFrame:
    return read_bytes(spark, path)


def body_lines(spark: SparkSession, path: str) -> DataFrame:
    return formats.explode_lines(read_text(spark, path), "text").select("path", "line_no", "line")


def body_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    parsed = body_lines(spark, path).withColumn("v", formats.ndjson(F.col("line"), schema))
    return parsed.where("v is not null").select("path", "line_no", "v.*")


def body_sse(spark: SparkSession, path: str) -> DataFrame:
    return read_text(spark, path).select("path", F.posexplode(formats.sse_events(F.col("text"))).alias("event_no", "e")).select("path", "event_no", "e.*")
