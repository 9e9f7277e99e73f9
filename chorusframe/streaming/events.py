"""Call events and array-wide slots on streams of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_events(det: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Call events by session windows on ``detected_at``; starts exactly one gap apart are one event."""
    timed = det.withColumn("at", F.col("detected_at").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy("station", "recording", "species", F.session_window("at", gap).alias("w"))
    return out.agg(F.count("*").alias("windows"), F.max("confidence").alias("max_confidence")).select("station", "recording", "species", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "windows", "max_confidence")


def stream_slots(det: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Detections and (approximately) distinct stations of each species and time slot."""
    timed = det.withColumn("at", F.col("detected_at").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy("species", F.window("at", width).alias("w")).agg(F.count("*").alias("detections"), F.approx_count_distinct("station").alias("stations"))
    return out.select("species", F.col("w.start").alias("slot"), "detections", "stations")
