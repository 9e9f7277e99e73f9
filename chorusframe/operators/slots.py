"""Time slots in which several stations fire: how wide a sound carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import kilometres


def slotted(det: DataFrame, minutes: int) -> DataFrame:
    return det.withColumn("slot", F.window("detected_at", f"{minutes} minutes")["start"])


def slot_extents(det: DataFrame, places: DataFrame, minutes: int = 30, by: Sequence[str] = ("species",)) -> DataFrame:
    """Stations, detections and the largest distance between two stations for each slot; 0 km for a single one.

    ``places(station, lat, lon)`` has a row a station.  Pairs are of distinct stations in a slot, not of detections.
    """
    s = slotted(det, minutes)
    n = s.groupBy(*by, "slot").agg(F.count("*").alias("detections"))
    seen = s.select(*by, "slot", "station").distinct().join(places, "station")
    other = seen.select(*by, "slot", F.col("station").alias("_o"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    pair = seen.join(other, [*by, "slot"]).where(F.col("station") < F.col("_o"))
    far = pair.groupBy(*by, "slot").agg(F.max(kilometres(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).alias("span_km"))
    stations = seen.groupBy(*by, "slot").agg(F.count("*").alias("stations"))
    out = n.join(stations, [*by, "slot"], "left").join(far, [*by, "slot"], "left")
    return out.withColumn("span_km", F.coalesce("span_km", F.lit(0.0))).withColumn("stations", F.coalesce("stations", F.lit(0)))


def slot_width_sweep(det: DataFrame, places: DataFrame, audible_km: float, widths: Sequence[int] = (5, 10, 15, 30, 60, 120)) -> DataFrame:
    """For each slot width and species: slots with more than one station, and the share of them wider than twice the audible range."""
    out = None
    for w in widths:
        e = slot_extents(det, places, w).where("stations > 1").groupBy("species")
        e = e.agg(F.count("*").alias("slots"), F.count_if(F.col("span_km") > 2 * audible_km).alias("too_wide")).withColumn("minutes", F.lit(w))
        out = e if out is None else out.unionByName(e)
    return out.withColumn("share", F.try_divide("too_wide", "slots"))


def worst_slots(det: DataFrame, minutes: int = 30, most: int = 10) -> DataFrame:
    """The slots with the most detections."""
    s = slotted(det, minutes).groupBy("species", "slot").agg(F.count("*").alias("detections"), F.count_distinct("station").alias("stations"))
    return s.orderBy(F.desc("detections"), "species", "slot").limit(most)
