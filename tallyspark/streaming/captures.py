"""Captures as a stream: an addition to the batch operators, which have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "dataset string, attempt string, seq long, kind string, status string, at timestamp"


def journal_stream(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """Journal events as JSON files arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def latest(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """ST2 as a stream: the latest status of each attempt; repeated events within the watermark count once."""
    seen = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["dataset", "attempt", "seq"])
    return seen.groupBy("dataset", "attempt").agg(F.max_by("status", "seq").alias("status"), F.max_by("kind", "seq").alias("kind"), F.max("at").alias("at"))


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Attempts and failures by dataset and day, closed once the watermark has passed the day."""
    failed = (F.col("kind") == "outcome") & (F.col("status") != "candidate_prepared")
    return events.withWatermark("at", delay).groupBy("dataset", F.window("at", "1 day")).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))
