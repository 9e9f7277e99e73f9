"""Windows over recordings: segmentation, suppression of overlaps, pulses and augmentation."""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.lineage import cut

SIZE_S, STRIDE_S, TASK_ROWS = 2.0, 1.0, 50_000


def sliding_windows(recordings: DataFrame, size_s: float = SIZE_S, stride_s: float = STRIDE_S) -> DataFrame:
    """``recording, win_no, start_s, end_s``: a grid, and a last window anchored at the end where the grid leaves a rest.

    A recording shorter than a window has one, which its reader pads.
    """
    d = F.col("duration_s")
    steps = F.greatest(F.lit(0), F.floor((d - size_s) / stride_s)).cast("bigint")
    on_grid = F.transform(F.sequence(F.lit(0).cast("bigint"), steps), lambda i: i * stride_s)
    rest = (d > size_s) & (steps * stride_s + size_s < d)
    starts = F.when(rest, F.concat(on_grid, F.array(d - size_s))).otherwise(on_grid)
    return recordings.select("recording", F.posexplode(starts).alias("win_no", "start_s")).withColumn("end_s", F.col("start_s") + size_s)


def _suppress(t: pa.Table, iou: float) -> pa.Table:
    """The rows that stay of many chains.  Those kept so far are held in order of their starts, so that a row meets only those near it."""
    start, end = t["start_s"].to_numpy(), t["end_s"].to_numpy()
    score = t["confidence"].to_pandas().to_numpy(float)
    order = np.lexsort((t["det_id"].to_pandas().to_numpy(), np.where(np.isnan(score), np.inf, -score)))
    kept: dict[int, tuple[list[float], list[float]]] = {}
    longest: dict[int, float] = {}
    out = []
    for i, c, a, b in zip(order.tolist(), t["_chain"].to_numpy()[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        starts, ends = kept.setdefault(c, ([], []))
        k = bisect.bisect_left(starts, b) - 1
        far = a - longest.get(c, 0.0)
        while k >= 0 and starts[k] > far:
            shared = min(b, ends[k]) - max(a, starts[k])
            if shared > 0 and shared / (b - a + ends[k] - starts[k] - shared) >= iou:
                break
            k -= 1
        else:
            at = bisect.bisect_right(starts, a)
            starts.insert(at, a)
            ends.insert(at, b)
            longest[c] = max(longest.get(c, 0.0), b - a)
            out.append(i)
    return t.take(pa.array(sorted(out), pa.int64()))


def suppress_overlaps(det: DataFrame, iou: float = 0.5, keys: Sequence[str] = ("recording", "species")) -> DataFrame:
    """Greedy non-maximum suppression in each recording and species: the most confident window stays, those that overlap it by ``iou`` go.

    Of equal windows only the best can stay, so each is one row before anything is ordered: what a task holds of a recording
    is bounded by its distinct windows.  Rows are cut into chains of windows that touch, which no suppression
    crosses; a chain of one stays as it is, and tasks take about TASK_ROWS rows of whole chains.  Windows without length
    overlap nothing.  Rows without confidence come last.  ``iou`` lies above 0 and up to 1.
    """
    if not 0 < iou <= 1:
        raise ValueError("iou must lie above 0 and up to 1")
    row = F.struct(*(F.col(f"`{c}`") for c in det.columns)).alias("row")
    best = F.min(F.struct(F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("c"), F.col("det_id"), row)).alias("b")
    long = det.where("end_s > start_s").groupBy(*keys, "start_s", "end_s").agg(best).select("b.row.*")
    w = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = long.withColumn("_new", F.when(reach.isNull() | (F.col("start_s") >= reach), 1).otherwise(0)).withColumn("_no", F.sum("_new").over(w)).drop("_new")
    chained = cut(chained.withColumn("_chain", F.xxhash64(*keys, "_no")).withColumn("_len", F.count("*").over(Window.partitionBy(*keys, "_no"))).drop("_no"))
    many = chained.where("_len > 1").drop("_len")
    tasks = ceil(many.count() / TASK_ROWS) + 1
    many = many.withColumn("_task", F.pmod("_chain", F.lit(tasks))).groupBy("_task").applyInArrow(lambda t: _suppress(t, iou), StructType([*many.schema.fields, StructField("_task", LongType())]))
    return chained.where("_len = 1").select(*det.columns).unionByName(many.select(*det.columns)).unionByName(det.where("NOT coalesce(end_s > start_s, false)"))


def threshold_counts(det: DataFrame, thresholds: Sequence[float], iou: float = 0.5) -> DataFrame:
    """Detections left by each threshold after suppression, by species.  Suppression is greedy by confidence, so one run serves all thresholds."""
    t = det.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    left = suppress_overlaps(det, iou).select("species", "confidence")
    return left.join(F.broadcast(t), F.col("confidence") >= F.col("threshold")).groupBy("threshold", "species").agg(F.count("*").alias("n"))  # a row a threshold


def loudest(frames: DataFrame, frames_wide: int, quietest: bool = False) -> DataFrame:
    """Each recording's window of ``frames_wide`` energy frames with most (or least) energy; the first on a tie."""
    w = Window.partitionBy("recording").orderBy("frame")
    e = frames.withColumn("_e", F.sum("energy").over(w.rowsBetween(0, frames_wide - 1))).withColumn("_n", F.count("*").over(w.rowsBetween(0, frames_wide - 1)))
    key = F.struct((-F.col("_e") if quietest else F.col("_e")).alias("e"), (-F.col("frame")).alias("f"))
    best = e.where(F.col("_n") == frames_wide).groupBy("recording").agg(F.max(key).alias("b"))
    return best.select("recording", (-F.col("b.f")).alias("frame"), (-F.col("b.e") if quietest else F.col("b.e")).alias("energy"))


def pulse_segments(frames: DataFrame, frame_s: float, share: float = 0.05, min_s: float = 0.02, merge_s: float = 0.1, max_s: float = 2.0) -> DataFrame:
    """Runs of frames above ``share`` of the recording's peak; runs with gaps below ``merge_s`` are one, short ones go, long ones are cut."""
    w = Window.partitionBy("recording").orderBy("frame")
    peak = F.max("energy").over(Window.partitionBy("recording"))
    on = frames.withColumn("_p", peak).where(F.col("energy") > share * F.col("_p")).select("recording", "frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    runs = on.withColumn("_new", F.when(gap.isNull() | ((gap - 1) * frame_s >= merge_s), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    out = runs.groupBy("recording", "_run").agg((F.min("frame") * frame_s).alias("start_s"), ((F.max("frame") + 1) * frame_s).alias("end_s"))
    out = out.where(F.col("end_s") - F.col("start_s") >= min_s)
    return out.select("recording", "start_s", F.least("end_s", F.col("start_s") + max_s).alias("end_s"))


def pulses(frames: DataFrame, share: float = 0.05, min_s: float = 0.15, merge_s: float = 0.10, max_s: float = 1.60) -> DataFrame:
    """``recording, start_s, end_s`` of the pulses in ``frames(recording, frame, energy, fps)``, such as energy_frames makes.

    Runs of frames above ``share`` of the recording's peak; runs shorter than ``min_s`` go, then a run that begins within ``merge_s`` of the
    pulse before it continues that pulse.  A pulse of one run is cut to ``max_s``, and it is the cut end that the next run is measured from.
    Recordings of fewer than 8 frames or without energy have none.
    """
    by = Window.partitionBy("recording").orderBy("frame")
    whole = frames.groupBy("recording").agg(F.max("energy").alias("_peak"), F.count("*").alias("_n")).where("_n >= 8 AND _peak > 0")
    on = frames.join(whole, "recording").where(F.col("energy") / F.col("_peak") > share).select("recording", "frame", "fps")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(by) > 1).cast("int"), F.lit(1))
    runs = on.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by)).groupBy("recording", "_run", "fps").agg(F.min("frame").alias("frame"), F.max("frame").alias("_to"))
    runs = runs.select("recording", "frame", (F.col("frame") / F.col("fps")).alias("_a"), ((F.col("_to") + 1) / F.col("fps")).alias("_b")).where(F.col("_b") - F.col("_a") >= min_s)
    a, b = F.lag("_a").over(by), F.lag("_b").over(by)
    # Beside a run beyond max_s the answer depends on whether that run was itself merged (then its end is not cut).
    near = F.when(b.isNull() | (F.col("_a") - b >= merge_s), False).when((b <= a + max_s) | (F.col("_a") - (a + max_s) < merge_s), True)
    runs = runs.withColumn("_near", near).withColumn("_merged", F.last("_near", ignorenulls=True).over(by))
    runs = runs.withColumn("_pulse", F.sum(F.when(F.col("_merged"), 0).otherwise(1)).over(by))
    out = runs.groupBy("recording", "_pulse").agg(F.min("_a").alias("start_s"), F.max("_b").alias("_b"), F.count("*").alias("_n"))
    return out.select("recording", "start_s", F.when(F.col("_n") == 1, F.least("_b", F.col("start_s") + max_s)).otherwise(F.col("_b")).alias("end_s"))


def bout_windows(pulses: DataFrame, size_s: float, before_s: float, at_least: int) -> DataFrame:
    """Windows that begin ``before_s`` ahead of a pulse and hold the starts of ``at_least`` pulses."""
    upto = F.expr(f"count(1) OVER (PARTITION BY recording ORDER BY start_s RANGE BETWEEN CURRENT ROW AND CAST({size_s - before_s} AS DOUBLE) FOLLOWING)")
    n = pulses.withColumn("pulses", upto)
    return n.where(F.col("pulses") >= at_least).select("recording", F.greatest(F.lit(0.0), F.col("start_s") - before_s).alias("start_s"), "pulses").withColumn("end_s", F.col("start_s") + size_s)


def chunk_windows(recordings: DataFrame, pulses: DataFrame, size_s: float, hop_s: float) -> DataFrame:
    """Windows at a fixed hop with the share of each that pulses fill."""
    grid = sliding_windows(recordings, size_s, hop_s).drop("win_no")
    b = lambda df, lo, hi: df.withColumn("_b", F.explode(F.sequence(F.floor(lo / size_s), F.floor(hi / size_s))))
    p = b(pulses.select("recording", F.col("start_s").alias("_s"), F.col("end_s").alias("_e")), F.col("_s"), F.col("_e"))
    g = b(grid, F.col("start_s"), F.col("end_s"))
    both = g.join(p, ["recording", "_b"]).where((F.col("_s") < F.col("end_s")) & (F.col("_e") > F.col("start_s")))
    shared = both.select("recording", "start_s", "_s", (F.least("end_s", "_e") - F.greatest("start_s", "_s")).alias("_v")).distinct()
    voiced = shared.groupBy("recording", "start_s").agg((F.sum("_v") / size_s).alias("voiced_share"))
    return grid.join(voiced, ["recording", "start_s"], "left").na.fill(0.0, ["voiced_share"])


def augment_to(df: DataFrame, target: int, label: str = "label", key: str = "path", background: str = "Background") -> DataFrame:
    """Repeat the rows of each class in turn to exactly ``target``, with ``aug`` the repeat's number; background stays as it is."""
    n = F.count("*").over(Window.partitionBy(label))
    times = F.when(F.col(label) == background, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(target) / n)).cast("int"))
    rows = df.withColumn("_times", times).withColumn("_i", F.row_number().over(Window.partitionBy(label).orderBy(key))).withColumn("_n", n)
    rows = rows.withColumn("aug", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    keep = (F.col(label) == background) | (F.col("aug") == 0) | (F.col("aug") * F.col("_n") + F.col("_i") <= target)
    return rows.where(keep).drop("_times", "_i", "_n")
