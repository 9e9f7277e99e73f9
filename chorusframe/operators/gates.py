"""Predicates that keep or drop detections and recordings.  A missing measurement never drops a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import hour_fraction
from .prefix import exact_quantiles

Step = Callable[[DataFrame], DataFrame]


def confident(threshold: float, background: str = "Background") -> Step:
    return lambda w: w.where((F.col("species") != background) & (F.col("confidence") >= threshold))


def minutes(clock: str) -> int:
    h, m = clock.split(":")
    return int(h) * 60 + int(m)


def recordings_between(start: str | None, end: str | None, at: str = "started_at") -> Step:
    """Recordings that began between two clock times, both included; a start after the end wraps past midnight.

    Recordings without a start time go; without both times all stay.
    """
    if start is None or end is None:
        return lambda r: r
    lo, hi, m = minutes(start), minutes(end), F.hour(at) * 60 + F.minute(at)
    return lambda r: r.where((m >= lo) & (m <= hi) if lo <= hi else (m >= lo) | (m <= hi))


def time_gate(lo: float, hi: float, at: str = "detected_at") -> Step:
    """Half-open in hours of the day; seconds do not count."""
    return lambda d: d.where((hour_fraction(F.col(at)) >= lo) & (hour_fraction(F.col(at)) < hi))


def low_frequency_gate(species: str, threshold: float, ratio: str = "low_freq_ratio") -> Step:
    return lambda d: d.where((F.col("species") != species) | F.coalesce(F.col(ratio) >= threshold, F.lit(True)))


def distance_gate(cutoffs: DataFrame, percentile: int, by_class: dict[str, int] | None = None, distance: str = "ood_distance") -> Step:
    """Keep rows within their class's cutoff at ``percentile``; ``cutoffs(species, percentile map<int,double>)`` has a row a class."""
    wanted = F.lit(percentile)
    for name, p in (by_class or {}).items():
        wanted = F.when(F.col("species") == name, p).otherwise(wanted)

    def run(d: DataFrame) -> DataFrame:
        at = F.try_element_at("percentile", wanted)
        limit = F.when(at.isNotNull(), at).otherwise(F.raise_error("that percentile was not fitted"))
        both = d.join(cutoffs, "species", "left")
        ok = F.when(F.col("percentile").isNull() | F.col(distance).isNull(), True).otherwise(F.col(distance) <= limit)
        return both.where(ok).drop("percentile")

    return run


def array_wide(det: DataFrame, minutes_wide: int = 30, stations: int = 4, chorus: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Adds ``slot_stations`` and ``keep``: false where that many stations or more fire in one slot outside the chorus hours."""
    slotted = det.withColumn("_slot", F.window("detected_at", f"{minutes_wide} minutes")["start"])
    per = slotted.select("species", "_slot", "station").distinct().groupBy("species", "_slot").agg(F.count("*").alias("slot_stations"))
    hour, loud = hour_fraction(F.col("detected_at")), F.lit(False)
    for lo, hi in chorus:
        loud = loud | ((hour >= lo) & (hour < hi))
    out = slotted.join(per, ["species", "_slot"]).drop("_slot")
    return out.withColumn("keep", (F.col("slot_stations") < stations) | loud)


def distance_flag(percentile: float = 0.95, distance: str = "mahalanobis_d2") -> Step:
    """Flags rows beyond that percentile of their species' own distances."""

    def run(d: DataFrame) -> DataFrame:
        cut = exact_quantiles(d.where("species IS NOT NULL"), distance, [percentile], ["species"]).select("species", F.col("q")[0].alias("_cut"))
        return d.join(cut, "species", "left").withColumn("flag_mahal", F.coalesce(F.col(distance) > F.col("_cut"), F.lit(False))).drop("_cut")

    return run


def tag_flag(suspicious: Sequence[str], tag: str = "tag_top") -> Step:
    return lambda d: d.withColumn("flag_tag", F.coalesce(F.col(tag).isin(*suspicious), F.lit(False)))


FLAGS = ("flag_mahal", "flag_tag", "flag_isolated", "flag_invading_cluster")


def merge_flags(flags: Sequence[str] = FLAGS, tag: str = "tag_top") -> Step:
    """``n_flags`` and ``flag_reason``; flags that the table lacks count as false."""

    def run(d: DataFrame) -> DataFrame:
        have = [f for f in flags if f in d.columns]
        on = {f: F.coalesce(F.col(f), F.lit(False)) for f in have}
        word = {f: F.lit(f.removeprefix("flag_")) if f != "flag_tag" or tag not in d.columns else F.concat(F.lit("tag:"), F.coalesce(tag, F.lit(""))) for f in have}
        n = sum((on[f].cast("int") for f in have), F.lit(0))
        return d.withColumn("n_flags", n).withColumn("flag_reason", F.concat_ws("|", *(F.when(on[f], word[f]) for f in have)))

    return run


def hard_negatives(d: DataFrame) -> DataFrame:
    """Rows with two flags or an invading cluster, and the first reason that holds."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in d.columns else F.lit(False)
    reason = F.when(on("flag_mahal"), "mahal").when(on("flag_tag"), "tag").when(on("flag_isolated"), "isolated").otherwise("invading_cluster")
    return d.where((F.col("n_flags") >= 2) | on("flag_invading_cluster")).withColumn("primary_reason", reason)


def drop_hot_negatives(manifest: DataFrame, scores: DataFrame, threshold: float, machine: Sequence[str], background: str = "Background") -> DataFrame:
    """Adds ``dropped`` and ``spared`` for background rows that score as calls: machine-labelled unverified ones go, human ones stay."""
    hot = scores.where(F.col("target_score") >= threshold).select("path", F.lit(True).alias("_hot")).distinct()
    out = manifest.join(hot, "path", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)) & (F.col("label") == background))
    own = F.col("source").isin(*machine) & F.col("verified").eqNullSafe(False)
    return out.withColumn("dropped", F.col("_hot") & own).withColumn("spared", F.col("_hot") & ~own).drop("_hot")


def drop_dumps(folders: Sequence[str], prefix: str) -> Step:
    bad = F.col("folder").isin(*folders) & F.col("source").startswith(prefix) & ~F.coalesce(F.col("verified"), F.lit(False))
    return lambda m: m.where(~F.coalesce(bad, F.lit(False)))


def mine_medium(windows: DataFrame, lo: float, hi: float, most: int, background: str = "Background") -> DataFrame:
    """The first ``most`` windows in file order that are not background and of middling confidence."""
    some = windows.where((F.col("species") != background) & F.col("confidence").between(lo, hi))
    return some.orderBy("recording", "start_s", "det_id").limit(most)


def screen_candidates(candidates: DataFrame, recordings: DataFrame, min_score: float, min_ratio: float) -> DataFrame:
    """listen, rejected, or source_missing where the recording is unknown."""
    known = recordings.select("recording", F.lit(True).alias("_known")).distinct()
    good = (F.col("score") >= min_score) & F.coalesce(F.col("low_freq_ratio") >= min_ratio, F.lit(True))
    word = F.when(F.col("_known").isNull(), "source_missing").when(good, "listen").otherwise("rejected")
    return candidates.join(known, "recording", "left").withColumn("screen", word).drop("_known")


def exclude_stations(names: Sequence[str]) -> Step:
    return lambda d: d.where(~F.coalesce(F.col("station").isin(*names), F.lit(False)))


def refuse_test_stations(tuned: Sequence[str], held: Sequence[str]) -> None:
    if both := sorted(set(tuned) & set(held)):
        raise ValueError(f"stations held out for testing cannot be tuned on: {', '.join(both)}")


def two_protocol_mask(cut: int) -> Column:
    return (F.coalesce(F.col("n_neighbours") < cut, F.lit(False))) | F.coalesce(F.col("flag_invading_cluster"), F.lit(False))


def gated_recurrence(cut: float, least: float, share: float, tight: str = "knn_dist", distance: str = "mahalanobis_d2") -> Step:
    """Adds ``flag_recurrent``: close to others and far from training, where such rows are at least ``share`` of their station."""

    def run(d: DataFrame) -> DataFrame:
        hit = F.coalesce((F.col(tight) <= cut) & (F.col(distance) >= least), F.lit(False))
        part = F.avg(hit.cast("double")).over(Window.partitionBy("station"))
        return d.withColumn("flag_recurrent", hit & (part >= share))

    return run


def loud_windows(decibels: float = 20.0, floor: float = 1e-4) -> Step:
    """Windows within ``decibels`` of their recording's loudest whose peak is above ``floor``."""

    def run(w: DataFrame) -> DataFrame:
        top = w.groupBy("recording").agg(F.max("rms").alias("_top"))
        return w.join(top, "recording").where((F.col("rms") >= F.col("_top") * 10 ** (-decibels / 20)) & (F.col("peak") >= floor)).drop("_top")

    return run
