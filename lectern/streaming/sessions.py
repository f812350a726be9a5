"""Reading sessions and last places over a stream of activity. An extension: a library without a stream has no counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVITY = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ACTIVITY).parquet(path)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, events): events of a user with less than a gap between them; events later than `late` are left out."""
    window = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def last_places(events: DataFrame) -> DataFrame:
    """(user_id, event_type, last): for an update-mode sink."""
    return events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("last"))
