"""Joins of detections with reviews: tolerance, nearest, interval and distance, all as equi-joins on buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S, MIN_OVERLAP_S = 2.0, 0.5


def second(start: Column) -> Column:
    return F.bround(start).cast("bigint")


def preferred_offsets(tolerance: int) -> list[int]:
    """0, -1, +1, -2, +2 ..."""
    return [0, *(s * k for k in range(1, tolerance + 1) for s in (-1, 1))]


def _on(keys: Sequence[str], *more: tuple[Column, str]) -> Column:
    """The rows of a table meet those of another whose keys are called ``_of_`` and their name."""
    on = F.lit(True)
    for left, right in [*((F.col(k), f"_of_{k}") for k in keys), *more]:
        on = on & (left == F.col(right))
    return on


def match_review(review: DataFrame, found: DataFrame, tolerance: int = 1, keys: tuple[str, ...] = ("species", "recording"), keep: tuple[str, ...] = ("cleanup",), review_id: str = "review_id") -> DataFrame:
    """Each review row with the detection of the same keys whose second is nearest by preference, within ``tolerance``.

    ``review`` has keys, start_s and a unique ``review_id``; unmatched rows stay, with nulls in ``keep`` and ``det_id``.
    A second of the keys has one first detection, and seconds meet, not rows.
    """
    offsets = F.array(*(F.struct(F.lit(i).alias("p"), F.lit(o).alias("o")) for i, o in enumerate(preferred_offsets(tolerance))))
    asked = review.select(*(F.col(k).alias(f"_of_{k}") for k in keys), second(F.col("start_s")).alias("_of_sec")).distinct()
    tries = asked.select("*", F.explode(offsets).alias("t")).withColumn("_sec", F.col("_of_sec") + F.col("t.o"))
    got = found.groupBy(*keys, second(F.col("start_s")).alias("_sec")).agg(F.min_by(F.struct("det_id", *keep), F.struct("det_id")).alias("_f"))
    hit = tries.join(got.withColumnRenamed("_sec", "_got"), _on(keys, (F.col("_sec"), "_got")))
    hit = hit.groupBy(*(f"_of_{k}" for k in keys), "_of_sec").agg(F.min_by("_f", "t.p").alias("_m"))
    return review.join(hit, _on(keys, (second(F.col("start_s")), "_of_sec")), "left").select(*(F.col(f"`{c}`") for c in review.columns), "_m.det_id", *(f"_m.{c}" for c in keep))


def _nearest_places(new: DataFrame, reviewed: DataFrame, span_s: float, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``_of_`` keys and start of each place of ``new`` that has a reviewed window within ``span_s``, its rows ``n``, and ``_m``: gap_s and the window ``r`` (start_s, keep).

    Places, not rows, are put in order within buckets of ``span_s``. The nearest window on either side lies in the place's own bucket or
    is the last of the bucket before or the first of that behind, so a bucket gets its own windows and one of each neighbour.
    """
    real = F.col("start_s").isNotNull() & ~F.isnan("start_s")
    own = reviewed.where(real).select(*keys, "start_s", *keep).distinct().groupBy(*keys, "start_s").agg(F.min(F.struct("start_s", *keep)).alias("r"))
    own = own.withColumn("b", F.floor(F.col("start_s") / span_s))
    ends = own.groupBy(*keys, "b").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    ends = ends.select(*keys, F.explode(F.array(F.struct((F.col("b") - 1).alias("b"), F.col("first").alias("r")), F.struct((F.col("b") + 1).alias("b"), F.col("last").alias("r")))).alias("x"))
    at = new.where(real).groupBy(*keys, "start_s").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("start_s") / span_s))
    windows = own.select(*keys, "b", "start_s", "r").unionByName(ends.select(*keys, "x.b", "x.r.start_s", "x.r")).withColumn("n", F.lit(None).cast("bigint"))
    rows = windows.unionByName(at.withColumn("r", F.lit(None).cast(windows.schema["r"].dataType)))
    group = Window.partitionBy(*keys, "b")
    before, after = (F.last("r", True).over(group.orderBy(o, F.col("n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.col("start_s").asc(), F.col("start_s").desc()))
    rows = rows.select("*", before.alias("before"), after.alias("after")).where("n IS NOT NULL")
    far = lambda c: F.abs(F.col("start_s") - F.col(f"{c}.start_s"))
    near = F.array_min(F.array(*(F.when(far(c) <= span_s, F.struct(far(c).alias("gap_s"), F.col(c).alias("r"))) for c in ("before", "after"))))
    return rows.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("start_s").alias("_of_start"), "n", near.alias("_m")).where("_m IS NOT NULL")


def match_nearest(new: DataFrame, reviewed: DataFrame, span_s: float = WINDOW_S + 1, keys: tuple[str, ...] = ("recording",), keep: tuple[str, ...] = ("verdict",)) -> DataFrame:
    """Each new detection with the nearest reviewed window of its recording within ``span_s``; on a tie the earlier.

    Adds ``gap_s``, ``near_start_s`` and ``keep``; several detections may share one window.
    """
    near = _nearest_places(new, reviewed, span_s, keys, keep).drop("n")
    rows = new.drop(*keep).join(near, _on(keys, (F.col("start_s"), "_of_start")), "left")
    return rows.select(*(F.col(f"`{c}`") for c in new.columns if c not in keep), "_m.gap_s", F.col("_m.r.start_s").alias("near_start_s"), *(f"_m.r.{c}" for c in keep))


def detection_changes(new: DataFrame, reviewed: DataFrame, span_s: float = WINDOW_S + 1) -> DataFrame:
    """One row: reviewed calls and false positives that the new run still covers, has lost, and detections on new ground."""
    near = _nearest_places(new, reviewed, span_s, ("recording",), ())
    covered = near.groupBy("_of_recording", F.col("_m.r.start_s").alias("_of_start")).agg(F.sum("n").alias("n"))
    per = reviewed.groupBy("recording", "start_s").agg(F.count_if(F.col("verdict") == "call").alias("calls"), F.count_if(F.col("verdict") == "false_positive").alias("fps"))
    total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    hit = F.col("n").isNotNull()
    out = per.join(covered, _on(("recording",), (F.col("start_s"), "_of_start")), "left").agg(*(total(c, on).alias(f"{c}_{name}") for name, on in (("kept", hit), ("lost", ~hit)) for c in ("calls", "fps")), total("n", hit).alias("near"))
    return out.crossJoin(new.agg(F.count("*").alias("all"))).select("calls_kept", "fps_kept", "calls_lost", "fps_lost", (F.col("all") - F.col("near")).alias("new_ground"))  # one row each


def _buckets(df: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    return df.withColumn("_b", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def overlapping(calls: DataFrame, windows: DataFrame, at_least_s: float = MIN_OVERLAP_S, keys: tuple[str, ...] = ("recording", "species"), width: float = 60.0, strict: bool = False, anti: bool = False) -> DataFrame:
    """The rows of ``calls`` (start_s, end_s, unique ``call_id``) that a window of the same keys overlaps by ``at_least_s``, or, ``anti``, the others.

    ``strict`` asks for an overlap of more than ``at_least_s``.
    """
    a = _buckets(calls.select("call_id", *keys, "start_s", "end_s"), F.col("start_s"), F.col("end_s"), width)
    b = _buckets(windows.select(*keys, F.col("start_s").alias("_s"), F.col("end_s").alias("_e")), F.col("_s"), F.col("_e"), width)
    shared = F.least("end_s", "_e") - F.greatest("start_s", "_s")
    hit = a.join(b, [*keys, "_b"]).where(shared > at_least_s if strict else shared >= at_least_s).select("call_id").distinct()
    return calls.join(hit, "call_id", "left_anti" if anti else "left_semi")


def away_from(draws: DataFrame, judged: DataFrame, distance_s: float = 4.0, keys: tuple[str, ...] = ("recording",)) -> DataFrame:
    """The draws (unique ``draw_id``) with no judged window of the recording less than ``distance_s`` away."""
    a = draws.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_s") / distance_s) - 1, F.floor(F.col("start_s") / distance_s) + 1)))
    b = judged.select(*keys, F.col("start_s").alias("_s")).withColumn("_b", F.floor(F.col("_s") / distance_s))
    near = a.join(b, [*keys, "_b"]).where(F.abs(F.col("start_s") - F.col("_s")) < distance_s).select("draw_id").distinct()
    return draws.join(near, "draw_id", "left_anti")


def recall(calls: DataFrame, windows: DataFrame, at_least_s: float = MIN_OVERLAP_S, window_s: float = WINDOW_S, group: str = "station") -> DataFrame:
    """Annotated calls detected, overall and by ``group``, with a Wilson interval; a call without an end is one window long."""
    from ..functions.intervals import wilson_high, wilson_low
    from .sessions import rolled_up

    whole = calls.withColumn("end_s", F.coalesce("end_s", F.col("start_s") + window_s))
    hit = overlapping(whole, windows, at_least_s).select("call_id", F.lit(1).alias("hit"))
    rows = whole.join(hit, "call_id", "left")
    out = rolled_up(rows, group, F.count("*").alias("calls"), F.count("hit").alias("detected"))
    k, n = F.col("detected"), F.col("calls")
    return out.withColumn("recall", F.try_divide(k, n)).withColumn("low", wilson_low(k, n)).withColumn("high", wilson_high(k, n))


def settled_reviews(review: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key with its verdict, null where rows of the key disagree."""
    return review.groupBy(*keys).agg(F.when(F.count_distinct("verdict") == 1, F.min("verdict")).alias("verdict"), F.count("*").alias("reviews"))


def apply_review(flagged: DataFrame, review: DataFrame, background: str = "Background") -> DataFrame:
    """Relabel flagged clips by (recording, second): a call takes its species and is verified, a false positive becomes background; a conflict leaves it."""
    keyed = flagged.withColumn("_sec", second(F.col("start_s")))
    said = settled_reviews(review.select("recording", second(F.col("start_s")).alias("_sec"), "verdict"), ("recording", "_sec")).withColumnRenamed("verdict", "_v")
    out = keyed.join(said, ["recording", "_sec"], "left")
    out = out.withColumn("label", F.when(F.col("_v") == "call", F.col("species")).when(F.col("_v") == "false_positive", F.lit(background)).otherwise(F.col("label")))
    return out.withColumn("verified", F.col("_v").isNotNull()).drop("_sec", "_v", "reviews")


def unreviewed(flagged: DataFrame, review: DataFrame) -> DataFrame:
    """Flagged clips whose (recording, second) nobody judged."""
    keys = review.select("recording", second(F.col("start_s")).alias("_sec")).distinct()
    return flagged.withColumn("_sec", second(F.col("start_s"))).join(keys, ["recording", "_sec"], "left_anti").drop("_sec")


def attach_audio(det: DataFrame, recordings: DataFrame) -> DataFrame:
    """Adds each detection's recording path; ``path`` is null where the recording is missing."""
    paths = recordings.groupBy("recording").agg(F.min("path").alias("path"))
    return det.join(paths, "recording", "left")


def require_some(df: DataFrame, column: str) -> DataFrame:
    """``df``, or an error if it has rows and ``column`` is null in all of them."""
    n = df.agg(F.count("*").alias("n"), F.count(column).alias("k")).first()
    if n["n"] and not n["k"]:
        raise ValueError(f"{column} is missing in all {n['n']} rows")
    return df


def latest_labels(log: DataFrame, allowed: tuple[str, ...] = ("call", "false_positive", "unsure")) -> DataFrame:
    """The last label of each clip in an append log (clip_id, label, seq); a label outside the domain is an error."""
    ok = F.when(F.col("label").isin(*allowed), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null")))))
    w = Window.partitionBy("clip_id").orderBy(F.desc("seq"))
    return log.withColumn("label", ok).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def join_labels(clips: DataFrame, labels: DataFrame) -> DataFrame:
    return clips.join(labels, "clip_id", "left")


def reconcile(manifest: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("path", "aug"), compare: tuple[str, ...] = ("label", "station", "source")) -> DataFrame:
    """One row per kind of difference: rows of one table alone, and rows whose columns differ; with counts and an example."""
    a = manifest.select(*keys, F.struct(*compare).alias("_a"), F.lit(1).alias("_in_a"))
    b = index.select(*keys, F.struct(*compare).alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, list(keys), "full_outer")
    kinds = [F.when(F.col("_in_b").isNull(), F.lit("only_in_manifest")), F.when(F.col("_in_a").isNull(), F.lit("only_in_index"))]
    kinds += [F.when(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(f"differs_in_{c}")) for c in compare]
    rows = both.select(keys[0], F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min(keys[0]).alias("example"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other has fewer of, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def shared_groups(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Groups on both sides of a split; none should be."""
    return left.select(group).intersect(right.select(group))


def compare_arms(a: DataFrame, b: DataFrame, key: str, metrics: tuple[str, ...]) -> DataFrame:
    """Mean of each metric over the keys that both tables have, and the mean difference b - a."""
    both = a.select(key, *(F.col(m).alias(f"{m}_a") for m in metrics)).join(b.select(key, *(F.col(m).alias(f"{m}_b") for m in metrics)), key)
    aggs = [x for m in metrics for x in (F.avg(f"{m}_a").alias(f"{m}_a"), F.avg(f"{m}_b").alias(f"{m}_b"), F.avg(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta"))]
    return both.agg(F.count("*").alias("n"), *aggs)


def coordinate_stations(recordings: DataFrame) -> DataFrame:
    """Each coordinate text with all stations that recorded it."""
    return recordings.where("coords IS NOT NULL").groupBy("coords").agg(F.array_sort(F.collect_set("station")).alias("stations"))


def verified_rows(manifest: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("path", "aug")) -> DataFrame:
    """Index rows that rendered (``ok``) and are verified in the manifest and in the index."""
    known = manifest.where(F.coalesce("verified", F.lit(False))).select(*keys)
    return index.where(F.coalesce("ok", F.lit(False)) & F.coalesce("verified", F.lit(False))).join(known, list(keys), "left_semi")


def detection_hours(manifest: DataFrame, review: DataFrame) -> DataFrame:
    """Each clip's hour of day by its file name, from the review table; null where nobody reviewed it."""
    hours = review.groupBy("file").agg(F.min(F.hour("detected_at")).alias("hour"))
    return manifest.withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1)).join(hours, "file", "left").drop("file")
