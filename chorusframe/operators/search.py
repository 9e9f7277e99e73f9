"""Threshold search and leave-one-station-out evaluation.

Everything works on histograms ``(station, value) -> calls, fps``: cutoffs join the histogram, never the rows, and what a
fold trains on is the total less its own station.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import hour_fraction
from ..plans.lineage import cut
from .metrics import auc, is_call, is_false, outcome
from .prefix import exact_quantiles, running, spread_by
from .ranking import SIGNALS, effort_by_station, rank_score
from .sampling import draw


COUNTS = ("calls_kept", "calls_lost", "fps_removed", "left")


def histogram(det: DataFrame, column: str, by: Sequence[str] = ("station",)) -> DataFrame:
    return det.groupBy(*by, F.col(column).cast("double").alias("value")).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"), F.count("*").alias("n"))


def quantiles(n: int) -> list[float]:
    return [i / (n + 1) for i in range(1, n + 1)]


def quantile_cuts(det: DataFrame, column: str, n: int) -> DataFrame:
    """The distinct values at n evenly spaced quantiles, linearly interpolated."""
    return exact_quantiles(det, column, quantiles(n)).select(F.explode("q").alias("cut")).distinct()


def flagged(value: Column, cut: Column, flag_when: str) -> Column:
    return F.coalesce(value >= cut if flag_when == "high" else value <= cut, F.lit(False))


def tally(h: DataFrame, gone: Column, by: Sequence[str]) -> DataFrame:
    """Outcome of removing the histogram rows where ``gone``."""
    kept = lambda c: F.sum(F.when(gone, 0).otherwise(F.col(c)))
    lost = lambda c: F.sum(F.when(gone, F.col(c)).otherwise(0))
    out = h.groupBy(*by).agg(kept("calls").alias("calls_kept"), lost("calls").alias("calls_lost"), lost("fps").alias("fps_removed"), F.sum(F.when(gone, 0).otherwise(F.col("calls") + F.col("fps"))).alias("left"))
    return out.withColumn("precision", F.try_divide("calls_kept", "left"))


def sweep(det: DataFrame, column: str, flag_when: str = "high", steps: int = 15, cuts: Sequence[float] | None = None) -> DataFrame:
    """What each cutoff removes; the cutoffs are quantiles, or those given."""
    h = histogram(det, column, ())
    c = quantile_cuts(det, column, steps) if cuts is None else det.sparkSession.createDataFrame([(float(x),) for x in cuts], "cut double")
    return tally(h.join(F.broadcast(c)), flagged(F.col("value"), F.col("cut"), flag_when), ["cut"])  # a row a cutoff


def tag_score_sweep(det: DataFrame, other: Column, tag_flag: str, tag_score: str, cuts: Sequence[float]) -> DataFrame:
    """The other filters, and the tag's where its score reaches each cutoff."""
    base = F.coalesce(other, F.lit(False))
    h = det.groupBy(base.alias("_o"), F.coalesce(tag_flag, F.lit(False)).alias("_t"), F.col(tag_score).alias("value")).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))
    c = det.sparkSession.createDataFrame([(float(x),) for x in cuts], "cut double")
    return tally(h.join(F.broadcast(c)), F.col("_o") | (F.col("_t") & flagged(F.col("value"), F.col("cut"), "high")), ["cut"])


def optimize_thresholds(det: DataFrame, distance: str = "mahalanobis_d2", neighbours: str = "n_neighbours", retention: float = 0.95, steps: int = 12, best: int = 12) -> DataFrame:
    """Distance and neighbour cutoffs searched together, either of them off (null) included, under a floor of calls kept."""
    h = det.groupBy(F.col(distance).alias("d"), F.col(neighbours).alias("k")).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))
    off = det.sparkSession.createDataFrame([(None,)], "cut double")
    values = det.select(F.explode(F.array(*(F.struct(F.lit(k).alias("of"), F.col(c).cast("double").alias("v")) for k, c in (("d", distance), ("k", neighbours))))).alias("x"))
    cuts = cut(exact_quantiles(values.select("x.*"), "v", quantiles(steps), ["of"]).select("of", F.explode("q").alias("cut")).distinct())  # steps rows each
    dc = cuts.where("of = 'd'").select("cut").union(off).withColumnRenamed("cut", "distance_cut")
    nc = cuts.where("of = 'k'").select(F.floor("cut").cast("double").alias("cut")).distinct().union(off).withColumnRenamed("cut", "neighbour_cut")
    grid = F.broadcast(dc.crossJoin(nc))  # (steps + 1) ** 2 rows
    gone = flagged(F.col("d"), F.col("distance_cut"), "high") | flagged(F.col("k"), F.col("neighbour_cut"), "low")
    out = tally(h.join(grid), gone, ["distance_cut", "neighbour_cut"])
    out = out.where(F.col("calls_kept") >= retention * (F.col("calls_kept") + F.col("calls_lost")))
    return out.orderBy(F.desc("precision"), F.desc("calls_kept"), F.desc_nulls_first("distance_cut"), F.desc_nulls_first("neighbour_cut")).limit(best)


def station_holdout(det: DataFrame, column: str, flag_when: str = "low", retention: float = 0.6, steps: int = 25) -> DataFrame:
    """The best cutoff on every other station by name, and what it does on the rest."""
    order = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("station"))
    half = det.select("station").distinct().withColumn("part", F.when(order % 2 == 1, "tuned").otherwise("held_out"))  # a row a station
    h = histogram(det, column).join(half, "station")
    t = tally(h.join(F.broadcast(quantile_cuts(det, column, steps))), flagged(F.col("value"), F.col("cut"), flag_when), ["part", "cut"])
    ok = t.where((F.col("part") == "tuned") & (F.col("calls_kept") >= retention * (F.col("calls_kept") + F.col("calls_lost"))))
    pick = ok.agg(F.max(F.struct(F.coalesce("precision", F.lit(0.0)).alias("p"), (-F.col("cut")).alias("c"))).alias("b")).select((-F.col("b.c")).alias("cut"))
    return t.join(F.broadcast(pick), "cut").select("part", "cut", "calls_kept", "calls_lost", "fps_removed", "left", "precision")


def _folds(h: DataFrame) -> DataFrame:
    """The histogram once for every fold (station) that it trains, and once, ``own``, for its own."""
    f = h.select(F.col("station").alias("fold")).distinct()
    return h.crossJoin(F.broadcast(f)).withColumn("own", F.col("station") == F.col("fold"))  # a row a station


def _choose(train: DataFrame, retention: float, *cols: str) -> DataFrame:
    """For each fold the settings of best precision (then the first in order) that keep their share of calls."""
    ok = train.where(F.col("calls_kept") >= retention * (F.col("calls_kept") + F.col("calls_lost")))
    w = Window.partitionBy("fold").orderBy(F.coalesce("precision", F.lit(0.0)).desc(), *(F.col(c).asc_nulls_first() for c in cols))
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("fold", *cols)


def _with_pooled(test: DataFrame, *extra: str) -> DataFrame:
    sums = test.agg(*(F.sum(c).alias(c) for c in ("calls_kept", "calls_lost", "fps_removed", "left"))).select(F.lit("POOLED").alias("fold"), "*", *(F.lit(None).cast(dict(test.dtypes)[c]).alias(c) for c in extra))
    both = test.select("fold", "calls_kept", "calls_lost", "fps_removed", "left", *extra).unionByName(sums)
    return both.withColumn("precision", F.try_divide("calls_kept", "left"))


def station_cv(det: DataFrame, column: str, flag_when: str = "low", retention: float = 0.9, steps: int = 25) -> DataFrame:
    """Leave-one-station-out: each fold's cutoff comes from the other stations (no cutoff is allowed); a pooled row."""
    h = _folds(histogram(det, column))
    at = F.percentile("value", F.array(*(F.lit(q) for q in quantiles(steps))), F.col("n"))
    no_op = F.when(F.lit(flag_when == "low"), F.min("value") - 1).otherwise(F.max("value") + 1)
    cuts = h.where("NOT own AND value IS NOT NULL").groupBy("fold").agg(F.concat(F.array(no_op), at).alias("q")).select("fold", F.explode("q").alias("cut")).distinct()
    t = tally(h.join(cuts, "fold"), flagged(F.col("value"), F.col("cut"), flag_when), ["fold", "own", "cut"])
    pick = _choose(t.where("NOT own"), retention, "cut")
    return _with_pooled(t.where("own").join(pick, ["fold", "cut"]), "cut")


def two_protocol_cv(det: DataFrame, retention: float = 0.9, cuts: Sequence[int] = tuple(range(-1, 10))) -> DataFrame:
    """Leave-one-station-out for isolation everywhere and the cluster rule where it found an invasion (``flag_invading_cluster``).

    Sums by station and cutoff are made once; what a fold trains on is the sum over all stations less its own.  ``invaded`` says
    whether the cluster rule flags anything at the station; a pooled row has the held-out stations, another all rows uncleaned.
    """
    flag = F.coalesce("flag_invading_cluster", F.lit(False))
    h = det.groupBy("station", F.col("n_neighbours").cast("double").alias("value"), flag.alias("inv")).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))
    c = det.sparkSession.createDataFrame([(float(x),) for x in cuts], "cut double")
    t = cut(tally(h.join(F.broadcast(c)), F.col("inv") | flagged(F.col("value"), F.col("cut"), "low"), ["station", "cut"]).withColumnRenamed("station", "fold"))  # stations x cutoffs
    every = t.groupBy("cut").agg(*(F.sum(x).alias(f"_{x}") for x in COUNTS))
    train = t.join(every, "cut").select("fold", "cut", *((F.col(f"_{x}") - F.col(x)).alias(x) for x in COUNTS)).withColumn("precision", F.try_divide("calls_kept", "left"))
    others = F.count("*").over(Window.partitionBy("cut")) > 1  # a row a station
    pick = _choose(train.withColumn("_others", others).where("_others").drop("_others"), retention, "cut")
    invaded = h.groupBy(F.col("station").alias("fold")).agg(F.max("inv").alias("invaded"))
    out = _with_pooled(t.join(pick, ["fold", "cut"]).join(invaded, "fold"), "cut", "invaded")
    none = h.agg(F.sum("calls").alias("calls_kept"), F.lit(0).cast("bigint").alias("calls_lost"), F.lit(0).cast("bigint").alias("fps_removed"), F.sum(F.col("calls") + F.col("fps")).alias("left"))
    none = none.select(F.lit("UNCLEANED").alias("fold"), "*", F.try_divide("calls_kept", "left").alias("precision"))
    return out.unionByName(none, allowMissingColumns=True)


def gated_recurrence_cv(det: DataFrame, tight: str = "knn_dist", distance: str = "mahalanobis_d2", share: float = 0.25, retention: float = 0.9, steps: int = 25, levels: Sequence[float | None] = (None, 0.5, 0.7, 0.8, 0.9)) -> DataFrame:
    """Leave-one-station-out for the gated recurrence rule: both cutoffs are quantiles of the training stations, and every
    training station must keep its share of calls."""
    h = det.groupBy("station", F.col(tight).alias("t"), F.col(distance).alias("d")).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"), F.count("*").alias("n"))
    h = _folds(h)
    q = lambda c, at: F.percentile(c, F.array(*(F.lit(x) for x in at)), F.col("n"))
    known = [x for x in levels if x is not None]
    cuts = h.where("NOT own").groupBy("fold").agg(F.concat(F.array(F.min("t") - 1), q("t", quantiles(steps))).alias("c"), F.concat(F.array(F.lit(None).cast("double")) if None in levels else F.array().cast("array<double>"), q("d", known)).alias("m"))
    grid = cuts.select("fold", F.explode("c").alias("cut"), "m").select("fold", "cut", F.explode("m").alias("least")).distinct()
    hit = F.coalesce((F.col("t") <= F.col("cut")) & (F.col("least").isNull() | (F.col("d") >= F.col("least"))), F.lit(False))
    per = h.join(grid, "fold").groupBy("fold", "own", "station", "cut", "least").agg(
        F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"), F.sum("calls").alias("calls"), F.sum("fps").alias("fps"),
        F.sum(F.when(hit, F.col("calls")).otherwise(0)).alias("hit_calls"), F.sum(F.when(hit, F.col("fps")).otherwise(0)).alias("hit_fps"),
    )
    acts = F.col("hits") >= share * F.col("n")
    per = per.withColumn("calls_lost", F.when(acts, F.col("hit_calls")).otherwise(0)).withColumn("fps_removed", F.when(acts, F.col("hit_fps")).otherwise(0)).withColumn("calls_kept", F.col("calls") - F.col("calls_lost"))
    per = per.withColumn("left", F.col("calls_kept") + F.col("fps") - F.col("fps_removed"))
    floor = F.min((F.col("calls_kept") >= retention * F.col("calls")).cast("int"))
    train = per.where("NOT own").groupBy("fold", "cut", "least").agg(*(F.sum(c).alias(c) for c in ("calls_kept", "calls_lost", "fps_removed", "left")), floor.alias("ok")).where("ok = 1")
    pick = _choose(train.withColumn("precision", F.try_divide("calls_kept", "left")), retention, "cut", "least")
    own = per.where("own").alias("a").join(pick.alias("b"), (F.col("a.fold") == F.col("b.fold")) & (F.col("a.cut") == F.col("b.cut")) & F.col("a.least").eqNullSafe(F.col("b.least")))
    return _with_pooled(own.select("a.*"), "cut", "least")


def operating_points(det: DataFrame, signals: dict[str, bool] | None = None, levels: Sequence[float] = (0.99, 0.97, 0.95, 0.9, 0.85), steps: int = 12) -> DataFrame:
    """For each share of calls kept, the cutoff or OR-ed pair of cutoffs of two signals with the best precision.

    Rows become a bit mask of the candidates that flag them; masks are counted once and candidates tried on the counts.
    """
    use = {c: up for c, up in (signals or SIGNALS).items() if c in det.columns}
    values = det.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in use))).alias("x")).select("x.*")
    at = {c: None for c in use} | {r["of"]: r["q"] for r in exact_quantiles(values, "v", quantiles(steps), ["of"]).collect()}  # a row a signal
    singles = [(c, "low" if up else "high", float(x)) for c, up in use.items() for x in (at[c] or [])]
    marks = F.array(*(flagged(F.col(c).cast("double"), F.lit(x), when) for c, when, x in singles))
    # A signal's cutoffs are ordered, so its marks are one number: how many of them flag the row.
    level = [sum((F.get(marks, F.lit(i)).cast("int") for i, s in enumerate(singles) if s[0] == c), F.lit(0)).alias(f"_{c}") for c in use]
    per = det.groupBy(*level).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))

    names = list(use)

    def fires(i: int) -> tuple[int, int]:
        """The signal's number and the level from which the candidate flags."""
        c, when, _ = singles[i]
        mine = [j for j, s in enumerate(singles) if s[0] == c]
        k = mine.index(i)
        return names.index(c), len(mine) - k if when == "low" else k + 1

    tries = [(f"{c} {when} {x:.4g}", *fires(i), *fires(i)) for i, (c, when, x) in enumerate(singles)]
    tries += [(f"{tries[i][0]} OR {tries[j][0]}", *fires(i), *fires(j)) for i in range(len(singles)) for j in range(i + 1, len(singles)) if singles[i][0] != singles[j][0]]
    table = det.sparkSession.createDataFrame([(n, *t) for n, t in enumerate(tries)], "_id int, configuration string, _a int, _x int, _b int, _y int")
    mine = F.array(*(F.col(f"_{c}") for c in names))
    gone = (F.get(mine, F.col("_a")) >= F.col("_x")) | (F.get(mine, F.col("_b")) >= F.col("_y"))
    kept = lambda c: F.sum(F.when(gone, 0).otherwise(c))
    # (steps + 1) ** signals counts at most meet a candidate a row
    sums = per.join(F.broadcast(table)).groupBy("_id", "configuration").agg(F.sum("calls").alias("all_calls"), kept(F.col("calls")).alias("calls_kept"), kept(F.col("calls") + F.col("fps")).alias("left"))
    rows = sums.withColumn("precision", F.try_divide("calls_kept", "left")).where("precision IS NOT NULL")
    floors = det.sparkSession.createDataFrame([(float(x),) for x in levels], "keep double")
    ok = rows.join(F.broadcast(floors)).where(F.col("calls_kept") >= F.col("keep") * F.col("all_calls"))
    w = Window.partitionBy("keep").orderBy(F.desc("precision"), "configuration")
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("keep", "configuration", "calls_kept", "left", "precision")


def time_gate_grid(det: DataFrame, min_recall: float = 0.95, starts: Sequence[int] = tuple(range(13)), ends: Sequence[int] = tuple(range(13, 25))) -> DataFrame:
    """Every half-open window of hours that keeps ``min_recall`` of the calls, by precision; counts are by hour first."""
    h = det.where(is_call() | is_false()).groupBy(F.floor(hour_fraction(F.col("detected_at"))).alias("hour")).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))
    grid = det.sparkSession.createDataFrame([(a, b) for a in starts for b in ends], "lo int, hi int")
    inside = (F.col("hour") >= F.col("lo")) & (F.col("hour") < F.col("hi"))
    out = tally(h.join(F.broadcast(grid)), ~inside, ["lo", "hi"])
    out = out.withColumn("recall", F.try_divide(F.col("calls_kept"), F.col("calls_kept") + F.col("calls_lost")))
    return out.where(F.col("recall") >= min_recall).select("lo", "hi", "calls_kept", "left", "recall", "precision")


def gate_effect(det: DataFrame, lo: float, hi: float) -> DataFrame:
    """Precision before and after a time gate, by station."""
    gone = ~((hour_fraction(F.col("detected_at")) >= lo) & (hour_fraction(F.col("detected_at")) < hi))
    before = F.try_divide(F.count_if(is_call()), F.count_if(is_call() | is_false()))
    return det.groupBy("station").agg(before.alias("before"), *outcome(gone))


def neighbour_loso(det: DataFrame, min_recall: float = 0.9) -> DataFrame:
    """Each fold's least number of neighbours, the lowest of best precision on the other stations with enough recall; a pooled and a macro row.

    Outcomes change only just above an observed number, so those cuts and 0 stand for every whole number up to the maximum.
    """
    h = histogram(det, "n_neighbours").where("station IS NOT NULL")
    at = F.coalesce("value", F.lit(-2.0)).alias("at")  # rows without a number go at every cut; cut 0 comes from -1
    per = h.select("station", at, "calls", "fps")
    none = det.sparkSession.createDataFrame([(-1.0, 0, 0)], "at double, calls bigint, fps bigint")
    every = per.groupBy("at").agg(F.sum("calls").alias("calls"), F.sum("fps").alias("fps")).unionByName(none)
    folds = h.select(F.col("station").alias("fold")).distinct()
    own = per.select(F.col("station").alias("fold"), "at", F.col("calls").alias("_c"), F.col("fps").alias("_f"))
    train = every.crossJoin(F.broadcast(folds)).join(own, ["fold", "at"], "left")  # a row a station
    train = train.select("fold", "at", *((F.col(c) - F.coalesce(o, F.lit(0))).alias(c) for c, o in (("calls", "_c"), ("fps", "_f"))))
    whole = Window.partitionBy("fold")
    upto = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = train.select("fold", (F.col("at") + 1).alias("cut"), F.sum("calls").over(upto).alias("calls_lost"), F.sum("calls").over(whole).alias("_calls"), (F.sum(F.col("calls") + F.col("fps")).over(whole) - F.sum(F.col("calls") + F.col("fps")).over(upto)).alias("left"))
    t = t.where("cut >= 0").withColumn("calls_kept", F.col("_calls") - F.col("calls_lost")).withColumn("precision", F.try_divide("calls_kept", "left"))
    test = h.withColumnRenamed("station", "fold").join(_choose(t, min_recall, "cut"), "fold")
    test = tally(test, F.coalesce(F.col("value") < F.col("cut"), F.lit(True)), ["fold", "cut"])
    pooled = _with_pooled(test, "cut")
    macro = test.agg(F.avg("precision").alias("precision")).select(F.lit("MACRO").alias("fold"), "precision")
    return pooled.unionByName(macro, allowMissingColumns=True)


def confidence_sweep(det: DataFrame, cuts: Sequence[float] = tuple(x / 20 for x in range(8, 21)), recall: float = 0.9) -> DataFrame:
    """Recall, false positives kept and cut, and precision at each confidence threshold; the highest that keeps ``recall`` of the calls is ``suggested``."""
    h = histogram(det, "confidence", ())
    c = det.sparkSession.createDataFrame([(float(x),) for x in cuts], "cut double")
    out = tally(h.join(F.broadcast(c)), F.col("value") < F.col("cut"), ["cut"])
    out = out.withColumn("recall", F.try_divide(F.col("calls_kept"), F.col("calls_kept") + F.col("calls_lost"))).withColumn("fps_kept", F.col("left") - F.col("calls_kept"))
    out = out.withColumn("fps_cut", F.try_divide("fps_removed", F.col("fps_removed") + F.col("fps_kept")))
    best = F.max(F.when(F.col("recall") >= recall, F.col("cut"))).over(Window.partitionBy(F.lit(0)))  # a row a threshold
    return out.withColumn("suggested", F.coalesce(F.col("cut") == best, F.lit(False)))


def confidence_spread(det: DataFrame, percentiles: Sequence[int] = (0, 10, 25, 50, 75, 90, 100)) -> DataFrame:
    """``species, verdict, n, percentile, confidence``: how confidence is spread among the calls and the false positives of each species."""
    rows = det.where((is_call() | is_false()) & F.col("confidence").isNotNull())
    q = exact_quantiles(rows, "confidence", [p / 100 for p in percentiles], ["species", "verdict"])
    each = F.explode(F.arrays_zip(F.array(*(F.lit(p) for p in percentiles)).alias("p"), F.col("q").alias("q"))).alias("x")
    return q.select("species", "verdict", "n", each).select("species", "verdict", "n", F.col("x.p").alias("percentile"), F.col("x.q").alias("confidence"))


def best_balanced(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """The observed value that splits best by balanced accuracy (at or above is positive); the smallest on a tie."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("cut")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    out = running(per, [], [F.desc("cut")], {"tp": F.col("p"), "fp": F.col("q")})
    whole = per.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    out = out.crossJoin(whole).withColumn("balanced", (F.try_divide("tp", "all_p") + 1 - F.try_divide("fp", "all_q")) / 2)
    return out.agg(F.max(F.struct("balanced", (-F.col("cut")).alias("c"))).alias("b")).select((-F.col("b.c")).alias("cut"), F.col("b.balanced").alias("balanced_accuracy"))


def recall_threshold(df: DataFrame, score: str, recall: float, by: Sequence[str] = ()) -> DataFrame:
    """The score that keeps ``recall`` of the calls: the order statistic at floor((1 - recall) * n), from counts by value."""
    per = df.where(is_call() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("v")).agg(F.count("*").alias("n"))
    whole = per.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.sum("n").alias("all"))
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    upto = running(per, by, [F.col("v").asc()], {"upto": F.col("n")})
    out = upto.join(whole, functools.reduce(lambda a, b: a & b, on)) if by else upto.crossJoin(whole)  # whole is one row
    return out.where(F.col("upto") > F.floor((1 - recall) * F.col("all"))).groupBy(*by).agg(F.min("v").alias("threshold"))


def _threshold_elsewhere(scores: DataFrame, recall: float) -> DataFrame:
    """``station, loso``: recall_threshold() of the calls of all other stations.

    Counts by value lie in range partitions; sums by partition and station show in which partition a station's threshold
    lies, and only that partition's counts are looked at.
    """
    per = spread_by(scores.where(is_call() & F.col("score").isNotNull()).groupBy("station", F.col("score").alias("v")).agg(F.count("*").alias("n")), [F.col("v").asc(), F.col("station").asc()])
    parts = cut(per.groupBy("_p", "station").agg(F.sum("n").alias("n")))
    folds = scores.select(F.col("station").alias("fold")).distinct()
    others = parts.groupBy("_p").agg(F.sum("n").alias("n")).crossJoin(folds)  # a row for each partition and station
    own = parts.select("_p", F.col("station").alias("fold"), F.col("n").alias("own"))
    others = others.join(own, ["_p", "fold"], "left").select("_p", "fold", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))
    w = Window.partitionBy("fold").orderBy("_p")
    at = others.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("fold"))).withColumn("rank", F.floor((1 - recall) * F.col("all")))
    at = at.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select("_p", "fold", (F.col("rank") - F.col("upto") + F.col("n")).alias("left"))
    near = per.join(at, "_p").where("station <> fold").groupBy("fold", "left", "v").agg(F.sum("n").alias("n"))
    near = near.withColumn("upto", F.sum("n").over(Window.partitionBy("fold").orderBy("v")))  # within one range partition
    return near.where(F.col("upto") > F.col("left")).groupBy(F.col("fold").alias("station")).agg(F.min("v").alias("loso"))


def fold_masks(manifest: DataFrame, stations: Sequence[str]) -> DataFrame:
    """For each fold and clip: train if it cannot be from the fold's station, evaluate if it can only be, else neither."""
    folds = manifest.sparkSession.createDataFrame([(s,) for s in stations], "fold string")
    may = F.array_contains("possible_stations", F.col("fold"))
    role = F.when(~may, "train").when(may & (F.size("possible_stations") == 1), "evaluate").otherwise("left_out")
    return manifest.join(F.broadcast(folds)).withColumn("role", role)


def score_folds(scores: DataFrame, deployed: float = 0.5, recall: float = 0.95) -> DataFrame:
    """By station: precision and calls kept at the deployed threshold, at the threshold of matched recall on its own calls, and at that of the other stations."""
    own = recall_threshold(scores, "score", recall, ("station",)).withColumnRenamed("threshold", "matched")
    rows = scores.join(own, "station", "left").join(_threshold_elsewhere(scores, recall), "station", "left")
    out = []
    for name, cut in (("deployed", F.lit(deployed)), ("matched", F.col("matched")), ("loso", F.col("loso"))):
        kept, left = F.count_if(is_call() & (F.col("score") >= cut)), F.count_if((is_call() | is_false()) & (F.col("score") >= cut))
        out += [kept.alias(f"{name}_calls"), F.try_divide(kept, left).alias(f"{name}_precision")]
    return rows.groupBy("station").agg(F.count("*").alias("detections"), F.count_if(is_call()).alias("calls"), *out)


def gated_folds(scores: DataFrame, hour: Column, gate: tuple[float, float], recall: float = 0.95) -> DataFrame:
    """score_folds() of what lies inside a time gate, which its thresholds come from too: by station the precision there without any threshold, and
    for its own threshold of matched recall and that of the other stations the calls retained, false positives removed and precision.

    A station with nothing inside has 0 detections and nulls.  Rows without an hour lie outside.
    """
    inside = scores.where((hour >= gate[0]) & (hour < gate[1]) & (is_call() | is_false()))
    own = recall_threshold(inside, "score", recall, ("station",)).withColumnRenamed("threshold", "matched")
    rows = inside.join(own, "station", "left").join(_threshold_elsewhere(inside, recall), "station", "left")
    out = [F.count("*").alias("gated_detections"), F.try_divide(F.count_if(is_call()), F.count("*")).alias("gated_precision")]
    for name in ("matched", "loso"):
        above = F.col("score") >= F.col(name)
        calls, false = F.count_if(is_call() & above), F.count_if(is_false() & above)
        known = lambda c: F.when(F.max(name).isNotNull(), c)  # noqa: B023, E731
        out += [
            F.max(name).alias(f"{name}_threshold"), known(F.try_divide(calls, F.count_if(is_call()))).alias(f"{name}_calls_retained"),
            known(1 - F.try_divide(false, F.count_if(is_false()))).alias(f"{name}_fps_removed"), F.try_divide(calls, calls + false).alias(f"{name}_precision"),
        ]
    return scores.select("station").distinct().join(rows.groupBy("station").agg(*out), "station", "left").na.fill(0, ["gated_detections"])


def available_candidates(det: DataFrame, names: Sequence[str]) -> list[str]:
    """The named columns that are numeric, present and not constant."""
    types = dict(det.dtypes)
    have = [n for n in names if types.get(n, "").split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    row = det.agg(*((F.min(n) < F.max(n)).alias(n) for n in have)).first() if have else {}
    return [n for n in have if row[n]]


def candidates_alone(det: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean average precision of each signal in both directions.

    A single signal's rank orders rows as its values do, missing ones first, so all orders are sorted in one job, without ranks.
    """
    det = cut(det.select("station", "det_id", "verdict", *(n for n in names if n in det.columns)))
    tries = [(n, up) for n in available_candidates(det, names) for up in (True, False)]
    ways = det.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(tries)], "way int, signal string, larger_is_genuine boolean")
    each = F.array(*(F.struct(F.lit(i).alias("way"), (F.col(n) if up else -F.col(n)).cast("double").alias("v")) for i, (n, up) in enumerate(tries))).cast("array<struct<way: int, v: double>>")
    rows = det.where(is_call() | is_false()).select("station", "det_id", is_call().cast("int").alias("hit"), F.explode(each).alias("x")).select("x.way", "station", "x.v", "det_id", "hit")
    placed = running(rows, ["way", "station"], [F.col("v").desc_nulls_first(), F.col("det_id").asc()], {"pos": F.lit(1).cast("bigint"), "cum": F.col("hit")})
    ap = placed.groupBy("way", "station").agg(F.avg(F.when(F.col("hit") == 1, F.col("cum") / F.col("pos"))).alias("ap"))
    return ways.join(ap.groupBy("way").agg(F.avg("ap").alias("mean_ap")), "way", "left").select("signal", "larger_is_genuine", "mean_ap")


def station_precision(det: DataFrame, signals: dict[str, bool]) -> DataFrame:
    return effort_by_station(det.transform(rank_score(signals))).select("station", "average_precision")


def added_to_baseline(det: DataFrame, baseline: dict[str, bool], extra: dict[str, bool]) -> DataFrame:
    """By station: average precision of the baseline, with the extra signal, and the difference."""
    a = station_precision(det, baseline).withColumnRenamed("average_precision", "baseline")
    b = station_precision(det, baseline | extra).withColumnRenamed("average_precision", "extended")
    return a.join(b, "station").withColumn("delta", F.col("extended") - F.col("baseline"))


def delta_interval(deltas: DataFrame, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Bootstrap over stations of the mean ``delta``: its 2.5 and 97.5 percentiles, t, and the mean without the two largest.

    Draws are hashes of (seed, round, draw), so they do not depend on partitioning.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("station")
    rows = deltas.where("delta IS NOT NULL").withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row a station
    draws = rows.select("m").distinct().join(deltas.sparkSession.range(rounds).withColumnRenamed("id", "round")).select("round", "m", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("k"))
    draws = draws.withColumn("i", F.floor(draw(seed, "round", "k") * F.col("m")))
    means = draws.join(F.broadcast(rows.select("i", "delta")), "i").groupBy("round").agg(F.avg("delta").alias("mean"))
    ci = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    top = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("delta"), "station"))
    base = rows.withColumn("top", top).agg(F.count("*").alias("stations"), F.avg("delta").alias("mean"), F.try_divide(F.avg("delta"), F.stddev_samp("delta") / F.sqrt(F.count("*"))).alias("t"), F.avg(F.when(F.col("top") > 2, F.col("delta"))).alias("mean_without_top2"))
    return base.crossJoin(ci).select("stations", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "t", "mean_without_top2")


def gate_table(df: DataFrame, column: str, positive: Column, cuts: Sequence[float]) -> DataFrame:
    """Share of positives and negatives at or above each cutoff."""
    h = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    c = df.sparkSession.createDataFrame([(float(x),) for x in cuts], "cut double")
    on = F.col("value") >= F.col("cut")
    out = h.join(F.broadcast(c)).groupBy("cut").agg(F.try_divide(F.sum(F.when(on, F.col("p"))), F.sum("p")).alias("positives_kept"), F.try_divide(F.sum(F.when(on, F.col("q"))), F.sum("q")).alias("negatives_kept"))
    return out.na.fill(0.0)


def gate_grid(df: DataFrame, first: str, seconds: Sequence[str], positive: Column, cuts: Sequence[float], shares: Sequence[float]) -> DataFrame:
    """``cut, share, criterion, low, limit, positives_kept, negatives_kept``: a cutoff on ``first`` together with a second criterion.

    The criterion is the column of ``seconds`` with the largest AUC (of equal ones the first); if even that is below one half, small
    values are the good ones (``low``).  Its limits give up each share of the positives by themselves.  A missing value passes nothing;
    without positives, or values to compare, there are no rows.  Rows are counted by how many cutoffs and limits they pass, so the shuffle has
    a row for each such pair.
    """
    known = {c: a for c in seconds if (a := auc(df, c, positive).first()["auc"]) is not None}  # a number a criterion
    best = max(known, key=known.get, default=seconds[0])
    low, cuts, shares = known.get(best, 0.0) < 0.5, sorted(map(float, cuts)), sorted(map(float, shares))
    limits = exact_quantiles(df.where(positive), best, [1 - x if low else x for x in shares]).select("q")  # one row, from loose to strict
    passed = lambda tests: sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
    a = passed(F.col(first) >= x for x in cuts)
    b = passed((F.col(best) <= F.col("q")[j]) if low else (F.col(best) >= F.col("q")[j]) for j in range(len(shares)))
    counts = df.crossJoin(F.broadcast(limits)).groupBy(a.alias("a"), b.alias("b"), "q").agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    of = lambda values: F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(values))))
    grid = counts.withColumn("c", of(cuts)).withColumn("s", of(shares))
    on = (F.col("a") > F.col("c.i")) & (F.col("b") > F.col("s.i"))
    kept = lambda n: F.try_divide(F.sum(F.when(on, F.col(n)).otherwise(0)), F.sum(n)).alias
    out = grid.groupBy(F.col("c.x").alias("cut"), F.col("s.x").alias("share"), F.get("q", F.col("s.i")).alias("limit")).agg(kept("p")("positives_kept"), kept("n")("negatives_kept"))
    return out.select("cut", "share", F.lit(best).alias("criterion"), F.lit(low).alias("low"), "limit", "positives_kept", "negatives_kept")


def confidence_baseline(det: DataFrame, removed: Column) -> DataFrame:
    """A rule against dropping as many of the least confident rows (by det_id where tied): the two precisions and the difference."""
    gone = F.coalesce(removed, F.lit(False))
    rows = det.where(is_call() | is_false())
    rule = rows.agg(F.count_if(gone).alias("removed"), F.try_divide(F.count_if(is_call() & ~gone), F.count_if(~gone)).alias("rule_precision"))
    k = rule.first()["removed"]
    per = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(is_call()).alias("calls"))
    upto = cut(running(per, [], [F.asc_nulls_first("confidence")], {"upto": F.col("n")}))
    left = upto.where(F.col("upto") > k).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    edge = upto.where((F.col("upto") > k) & (F.col("upto") - F.col("n") < k)).select("confidence", (k - F.col("upto") + F.col("n")).alias("more")).first()  # a value that is dropped in part
    if edge:
        tied = rows.where(F.col("confidence").eqNullSafe(F.lit(edge["confidence"]))).select("det_id", is_call().cast("int").alias("hit"))
        tied = running(tied, [], [F.col("det_id").asc()], {"position": F.lit(1).cast("bigint")}).where(F.col("position") <= edge["more"]).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("h"), F.count("*").alias("m"))
        left = left.crossJoin(tied).select((F.col("calls") - F.col("h")).alias("calls"), (F.col("n") - F.col("m")).alias("n"))  # one row each
    baseline = left.select(F.try_divide("calls", "n").alias("baseline_precision"))
    return rule.withColumn("removed", F.col("removed").cast("int")).crossJoin(baseline).withColumn("advantage", F.col("rule_precision") - F.col("baseline_precision"))


def suggest_threshold(det: DataFrame, keep_share: float) -> DataFrame:
    """The confidence that leaves that share of detections."""
    per = det.where("confidence IS NOT NULL").groupBy("confidence").agg(F.count("*").alias("n"))
    upto = running(per, [], [F.desc("confidence")], {"upto": F.col("n")})
    k = per.agg(F.greatest(F.lit(1), F.floor(F.sum("n") * F.lit(float(keep_share)))).cast("int").alias("kept"))
    return upto.crossJoin(k).where(F.col("upto") >= F.col("kept")).groupBy("kept").agg(F.max("confidence").alias("threshold"))  # k is one row
