"""Seeded samples and splits.  Draws are MD5 hashes of (seed, keys), so they do not depend on partitioning or order, and any engine can repeat them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    """A uniform number in (0, 1) for the row's keys: 32 bits of the MD5 of seed and keys, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") + 0.5) / float(1 << 32)


def plan_segments(recordings: DataFrame, segments: int, segment_s: float = 300.0, seed: int = 0, group: str = "station") -> DataFrame:
    """``station, recording, start_s, end_s``: an even quota a station (the remainder to the first by name), recordings drawn by
    duration, segments of a recording without overlap.

    Every slot of a fixed grid in a recording is a candidate with the same weight, so longer recordings come in proportion;
    each recording's grid has its own random offset.
    """
    long = recordings.where(F.col("duration_s") >= segment_s)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(group))
    quota = long.select(group).distinct().withColumn("_i", order).withColumn("_k", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row a station
    quota = quota.withColumn("_quota", F.floor(F.lit(segments) / F.col("_k")) + (F.col("_i") <= F.lit(segments) % F.col("_k")).cast("int")).select(group, "_quota")
    slots = F.floor(F.col("duration_s") / segment_s)
    spare = F.col("duration_s") - slots * segment_s
    grid = long.withColumn("_at", spare * draw(seed, "recording")).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("bigint"), slots - 1)))
    grid = grid.withColumn("start_s", F.col("_at") + F.col("_n") * segment_s).withColumn("_u", draw(seed + 1, "recording", "_n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_u", "recording", "_n"))
    out = grid.withColumn("_r", rank).join(quota, group).where("_r <= _quota")
    return out.select(group, "recording", "start_s", (F.col("start_s") + segment_s).alias("end_s"), F.lit(seed).alias("seed"))


def annotation_template(plan: DataFrame) -> DataFrame:
    """One blank row a segment."""
    blank = lambda t: F.lit(None).cast(t)
    return plan.select("station", "recording", F.col("start_s").alias("segment_start_s"), F.col("end_s").alias("segment_end_s"), blank("string").alias("species"), blank("double").alias("call_start_s"), blank("double").alias("call_end_s"), F.lit("").alias("note"))


def per_group(df: DataFrame, by: Sequence[str], most: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def by_confidence_band(det: DataFrame, edges: Sequence[float], most: int, rare: int, seed: int = 0) -> DataFrame:
    """``most`` detections of each species and confidence band; species of up to ``rare`` rows in full."""
    band = sum(((F.col("confidence") >= e).cast("int") for e in edges), F.lit(0))
    rows = det.withColumn("band", band).withColumn("_n", F.count("*").over(Window.partitionBy("species")))
    rank = F.row_number().over(Window.partitionBy("species", "band").orderBy(draw(seed, "det_id"), "det_id"))
    return rows.withColumn("_r", rank).where((F.col("_r") <= most) | (F.col("_n") <= rare)).drop("_n", "_r")


def reliability_sample(det: DataFrame, slices: int = 100, top: int = 20, seed: int = 0) -> DataFrame:
    """One detection of each equal confidence slice, and ``top`` of the best twentieth, without repeats."""
    slice_no = F.least(F.lit(slices - 1), F.floor(F.col("confidence") * slices))
    rows = det.where("confidence IS NOT NULL").withColumn("slice", slice_no)
    one = per_group(rows, ["slice"], 1, "det_id", seed)
    bar = rows.agg(F.percentile("confidence", F.lit(0.95)).alias("_bar"))
    best = rows.join(F.broadcast(bar)).where(F.col("confidence") >= F.col("_bar")).drop("_bar")  # one row
    best = best.orderBy(draw(seed + 1, "det_id"), "det_id").limit(top)
    return one.unionByName(best).dropDuplicates(["det_id"])


def random_windows(recordings: DataFrame, each: int, window_s: float = 2.0, seed: int = 0) -> DataFrame:
    """``each`` random starts a station, recordings drawn by duration: for a draw u the recording in which u of the station's time lies."""
    w = Window.partitionBy("station").orderBy("recording")
    usable = recordings.withColumn("_d", F.col("duration_s") - window_s).where("_d > 0")
    spans = usable.withColumn("_hi", F.sum("_d").over(w)).withColumn("_lo", F.col("_hi") - F.col("_d")).withColumn("_all", F.sum("_d").over(Window.partitionBy("station")))
    draws = spans.select("station", "_all").distinct().withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("_t", draw(seed, "station", "_k") * F.col("_all"))
    width = F.lit(600.0)
    a = draws.drop("_all").withColumn("_b", F.floor(F.col("_t") / width))
    b = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    hit = a.join(b, ["station", "_b"]).where((F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_hi")))
    return hit.select("station", "recording", (F.col("_t") - F.col("_lo")).alias("start_s"), F.concat_ws(":", "station", "_k").alias("draw_id"))


def grouped_split(df: DataFrame, group: str, label: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``part``: validation for whole groups of each label, in a random order, up to ``share`` of its rows, at least one group if there are two."""
    g = df.groupBy(label, group).agg(F.count("*").alias("_n")).withColumn("_u", draw(seed, group))
    first = g.groupBy(group).agg(F.min(label).alias(label))
    g = g.join(first, [label, group])  # a group with several labels belongs to the first
    w, whole = Window.partitionBy(label).orderBy("_u", group), Window.partitionBy(label)
    g = g.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn("_all", F.sum("_n").over(whole)).withColumn("_k", F.count("*").over(whole))
    val = (F.col("_before") < share * F.col("_all")) & (F.col("_k") > 1)
    val = val & ((F.col("_before") + F.col("_n") < F.col("_all")) | (F.col("_before") == 0))
    part = g.select(group, F.when(val, "validation").otherwise("train").alias("part"))
    return df.join(part, group, "left")


def group_sample(df: DataFrame, group: str, groups: int, seed: int = 0) -> DataFrame:
    """All rows of ``groups`` random groups."""
    chosen = df.select(group).distinct().orderBy(draw(seed, group), group).limit(groups)
    return df.join(chosen, group, "left_semi")


def listening_sheet(clips: DataFrame, seed: int = 0) -> DataFrame:
    """A shuffled sheet with species, station (the clip's folder), a running number and a blank verdict."""
    from ..functions import parse
    from .ranking import prefix_count

    name = parse.base_name(F.col("path"))
    rows = clips.select("path", parse.clip_species(name).alias("species"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("station"), parse.clip_confidence(name).alias("confidence"), F.lit("").alias("verdict"), draw(seed, "path").alias("_u"))
    return prefix_count(rows, [F.col("_u").asc(), F.col("path").asc()], "number").drop("_u")
