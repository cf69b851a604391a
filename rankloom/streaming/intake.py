"""Continuous intake of hit tables: best hit per gene so far, and hits per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import hit_schema


def read_hit_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Hit tables as they arrive in a folder."""
    return spark.readStream.schema(hit_schema()).option("sep", ";").option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def best_so_far(hits: DataFrame) -> DataFrame:
    """(id2, id1, E, start1, end1) of the lowest energy of each gene; a state row per gene, for update or complete mode."""
    best = F.min(F.struct("E", "start1", "end1", "start2", "end2")).alias("b")
    return hits.groupBy("id2", "id1").agg(best).select("id2", "id1", "b.E", "b.start1", "b.end1")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and sums per tumbling window; windows older than the watermark are closed and their state dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
