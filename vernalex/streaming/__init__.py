"""Streaming: late and repeated deliveries of entries as a Structured Streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def first_deliveries_stream(spark: SparkSession, path: str, schema: str, key: str = "seq", at: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """A folder of Parquet deliveries as a stream, each key once; keys are forgotten ``late`` after their delivery."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
