"""Streaming ingestion (an extension): degrees and windowed activity that follow a growing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.operators.graph import degrees


def stream_table(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A Parquet folder as a stream; its schema comes from what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_degrees(edges: DataFrame) -> DataFrame:
    """Degrees of a stream of edges; for update or complete output."""
    return degrees(edges)


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their values by type and tumbling window; rows later than ``late`` are dropped."""
    window = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
