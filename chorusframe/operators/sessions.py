"""Runs of detections: call events and listening episodes.

Ids are ``(station, recording, species, seq)``; a global running number would need a total sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import KEYS
from .prefix import exact_quantiles

EVENT_GAP_S, EPISODE_GAP_S, WINDOW_S = 2.0, 300.0, 2.0


def _by_start() -> Window:
    return Window.partitionBy(*KEYS).orderBy("start_s", "det_id")


def assign_runs(gap_s: float, name: str) -> Callable[[DataFrame], DataFrame]:
    """Number the runs of each (station, recording, species): a gap of more than ``gap_s`` between starts begins a new one."""

    def run(det: DataFrame) -> DataFrame:
        gap = F.col("start_s") - F.lag("start_s").over(_by_start())
        new = F.when(gap.isNull() | (gap > gap_s), 1).otherwise(0)
        return det.withColumn("_new", new).withColumn(name, F.sum("_new").over(_by_start())).drop("_new")

    return run


def assign_events(gap_s: float = EVENT_GAP_S) -> Callable[[DataFrame], DataFrame]:
    return assign_runs(gap_s, "event_no")


def assign_episodes(gap_s: float = EPISODE_GAP_S) -> Callable[[DataFrame], DataFrame]:
    return assign_runs(gap_s, "episode_no")


def events(det: DataFrame, gap_s: float = EVENT_GAP_S, window_s: float = WINDOW_S) -> DataFrame:
    """One row per call event; its verdict is call if any window is one, null if none was reviewed."""
    calls, reviewed = F.count_if(F.col("verdict") == "call"), F.count("verdict")
    out = det.transform(assign_events(gap_s)).groupBy(*KEYS, "event_no")
    out = out.agg(
        F.min("start_s").alias("start_s"), (F.max("start_s") + window_s).alias("end_s"), F.count("*").alias("windows"), F.max("confidence").alias("max_confidence"),
        calls.alias("call_windows"), reviewed.alias("reviewed_windows"),
    )
    mixed = (F.col("call_windows") > 0) & (F.col("call_windows") < F.col("reviewed_windows"))
    word = F.when(F.col("call_windows") > 0, "call").when(F.col("reviewed_windows") > 0, "false_positive")
    return out.withColumn("duration_s", F.col("end_s") - F.col("start_s")).withColumn("verdict", word).withColumn("mixed", mixed)


def rolled_up(df: DataFrame, by: str, *aggs: Column) -> DataFrame:
    """The aggregates over all rows (``by`` = ALL) and for each value of ``by``."""
    return df.rollup(by).agg(*aggs, F.grouping(by).alias("_all")).withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def event_effort(det: DataFrame, gap_s: float = EVENT_GAP_S) -> DataFrame:
    """Windows against events, overall and by station."""
    e = events(det, gap_s)
    out = rolled_up(e, "station", F.sum("windows").alias("windows"), F.count("*").alias("events"), F.max("windows").alias("longest_windows"))
    return out.withColumn("windows_per_event", F.try_divide("windows", "events"))


def duration_summary(det: DataFrame, gap_s: float = EVENT_GAP_S) -> DataFrame:
    """Event durations overall and by verdict: median, mean, 90th percentile, longest, and the share of single windows."""
    e = events(det, gap_s).withColumn("verdict", F.coalesce("verdict", F.lit("unreviewed")))
    e = cut(e.select("verdict", "duration_s", "windows"))
    each = e.select(F.explode(F.array("verdict", F.lit("ALL"))).alias("verdict"), "duration_s")
    q = exact_quantiles(each, "duration_s", [0.5, 0.9], ["verdict"]).select("verdict", F.col("q")[0].alias("median_s"), F.col("q")[1].alias("p90_s"))
    out = rolled_up(e, "verdict", F.count("*").alias("events"), F.avg("duration_s").alias("mean_s"), F.max("duration_s").alias("max_s"), (F.count_if(F.col("windows") == 1) / F.count("*")).alias("single_share"))
    return out.join(q, "verdict", "left").select("verdict", "events", "median_s", "mean_s", "p90_s", "max_s", "single_share")


def episodes(det: DataFrame, gap_s: float = EPISODE_GAP_S) -> DataFrame:
    """One row per episode of reviewed detections, with its purity: all calls, all false positives, or mixed."""
    out = det.transform(assign_episodes(gap_s)).groupBy(*KEYS, "episode_no")
    out = out.agg(
        F.count("*").alias("detections"), F.count_if(F.col("verdict") == "call").alias("calls"), F.count_if(F.col("verdict") == "false_positive").alias("fps"),
        (F.max("start_s") - F.min("start_s")).alias("span_s"),
    )
    purity = F.when(F.col("fps") == 0, "calls").when(F.col("calls") == 0, "false_positives").otherwise("mixed")
    return out.withColumn("purity", purity)


def episode_effort(det: DataFrame, gap_s: float = EPISODE_GAP_S) -> DataFrame:
    """Listens needed (one for a pure episode, all detections of a mixed one) against detections, overall and by station."""
    need = F.when(F.col("purity") == "mixed", F.col("detections")).otherwise(1)
    out = rolled_up(episodes(det, gap_s).withColumn("need", need), "station", F.sum("detections").alias("detections"), F.count("*").alias("episodes"), F.sum("need").alias("listens"))
    return out.withColumn("saved_share", 1 - F.try_divide("listens", "detections"))


def episode_features(gap_s: float = EPISODE_GAP_S) -> Callable[[DataFrame], DataFrame]:
    """Size, span, rate, mean gap and position of each detection's episode; a lone detection's mean gap is ``gap_s``."""

    def run(det: DataFrame) -> DataFrame:
        w = Window.partitionBy(*KEYS, "episode_no")
        size, first, last = F.count("*").over(w), F.min("start_s").over(w), F.max("start_s").over(w)
        span = last - first
        return det.transform(assign_episodes(gap_s)).withColumns(
            {
                "episode_size": size,
                "episode_span_s": span,
                "episode_rate": size / (span + 1),
                "episode_mean_gap_s": F.when(size > 1, span / (size - 1)).otherwise(gap_s),
                "episode_position": F.when(span > 0, (F.col("start_s") - first) / span).otherwise(0.0),
            }
        )

    return run


def event_features(gap_s: float = EVENT_GAP_S, window_s: float = WINDOW_S) -> Callable[[DataFrame], DataFrame]:
    def run(det: DataFrame) -> DataFrame:
        w = Window.partitionBy(*KEYS, "event_no")
        first, last = F.min("start_s").over(w), F.max("start_s").over(w)
        return det.transform(assign_events(gap_s)).withColumns(
            {
                "event_windows": F.count("*").over(w),
                "event_duration_s": last - first + window_s,
                "event_position": F.when(last > first, (F.col("start_s") - first) / (last - first)).otherwise(0.0),
            }
        )

    return run


def gap_to_nearest(det: DataFrame) -> DataFrame:
    """Seconds to the nearer of the previous and next detection of the recording and species; null if alone."""
    before, after = F.col("start_s") - F.lag("start_s").over(_by_start()), F.lead("start_s").over(_by_start()) - F.col("start_s")
    return det.withColumn("gap_to_nearest_s", F.least(before, after))
