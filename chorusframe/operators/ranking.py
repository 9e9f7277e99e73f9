"""Ranking within stations, review effort, and the review queue."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import KEYS
from .prefix import running
from .sessions import EPISODE_GAP_S, assign_episodes

#: Signals and whether a larger value is more likely genuine.
SIGNALS = {"confidence": True, "softmax_margin": True, "n_neighbours": True, "mahalanobis_d2": False}


def _ranks(det: DataFrame, columns: dict[str, bool], group: str, nulls: str) -> DataFrame:
    """``_k, _g, _v, _pct``: the percentile of each value of each column (by number) in each group, from counts by value."""
    values = F.array(*(F.struct(F.lit(k).alias("_k"), (-F.col(c) if up else F.col(c)).cast("double").alias("_v")) for k, (c, up) in enumerate(columns.items())))
    per = det.select(F.col(group).alias("_g"), F.explode(values).alias("x")).groupBy("x._k", "_g", "x._v").agg(F.count("*").alias("_n"))
    order = F.col("_v").asc_nulls_last() if nulls == "top" else F.col("_v").asc_nulls_first()
    upto = running(per, ["_k", "_g"], [order], {"_upto": F.col("_n")})
    size = det.groupBy(F.col(group).alias("_h")).agg(F.count("*").alias("_all"))
    mean = F.col("_upto") - F.col("_n") + 1 + (F.col("_n") - 1) / 2
    return upto.join(size, F.col("_g").eqNullSafe(F.col("_h"))).select("_k", "_g", "_v", (mean / F.col("_all")).alias("_pct"))


def _with_ranks(det: DataFrame, columns: dict[str, bool], group: str, nulls: str) -> DataFrame:
    """Adds ``_pct0``, ``_pct1`` and so on."""
    ranks, out = cut(_ranks(det, columns, group, nulls)), det
    for k, (c, up) in enumerate(columns.items()):
        r = ranks.where(F.col("_k") == k).select(F.col("_g").alias(f"_g{k}"), F.col("_v").alias(f"_v{k}"), F.col("_pct").alias(f"_pct{k}"))
        v = (-F.col(c) if up else F.col(c)).cast("double")
        out = out.join(r, F.col(group).eqNullSafe(F.col(f"_g{k}")) & v.eqNullSafe(F.col(f"_v{k}"))).drop(f"_g{k}", f"_v{k}")
    return out


def percentile_rank(det: DataFrame, column: str, name: str, group: str = "station", larger_first: bool = False, nulls: str = "top") -> DataFrame:
    """Adds ``name``: rank over the group's size, ties averaged.  Missing values tie at the top, or with ``nulls="bottom"`` at the bottom.

    The default keeps the convention that a missing signal never counts against a detection.
    """
    return _with_ranks(det, {column: larger_first}, group, nulls).withColumnRenamed("_pct0", name)


def rank_score(signals: dict[str, bool] | None = None, group: str = "station", nulls: str = "top") -> Callable[[DataFrame], DataFrame]:
    """Mean within-station percentile of the signals that the table has; null if it has none."""

    def run(det: DataFrame) -> DataFrame:
        use = {c: not up for c, up in (signals or SIGNALS).items() if c in det.columns}
        if not use:
            return det.withColumn("rank_score", F.lit(None).cast("double"))
        names = [f"_pct{k}" for k in range(len(use))]
        return _with_ranks(det, use, group, nulls).withColumn("rank_score", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)

    return run


def prefix_count(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Number all rows from 1 in the given order without gathering them in one task."""
    return running(df, [], order, {name: F.lit(1).cast("bigint")})


def effort_curve(det: DataFrame, fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75), score: str = "rank_score", group: str = "station") -> DataFrame:
    """Calls found in the best share of each station's budget, taken over all stations in one order, with the ceiling.

    The ceiling is what any order could find: for each station no more calls than its calls or its share of the budget.
    """
    rows = det.where("verdict IN ('call', 'false_positive')").select(group, "det_id", (F.col("verdict") == "call").cast("int").alias("hit"), F.col(score).alias("s"))
    placed = prefix_count(rows, [F.col("s").desc_nulls_last(), F.col("det_id").asc()])
    cuts = det.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    total = rows.agg(F.count("*").alias("n"), F.sum("hit").alias("calls"))
    budget = cuts.crossJoin(total).withColumn("k", F.bround(F.col("n") * F.col("fraction")).cast("bigint"))  # a row a fraction
    found = placed.join(F.broadcast(budget), F.col("position") <= F.col("k")).groupBy("fraction").agg(F.sum("hit").alias("found"))
    per = rows.groupBy(group).agg(F.count("*").alias("m"), F.sum("hit").alias("h"))
    top = per.crossJoin(cuts).withColumn("b", F.bround(F.col("m") * F.col("fraction"))).groupBy("fraction").agg(F.sum(F.least(F.col("b"), F.col("h"))).cast("bigint").alias("ceiling"))
    out = budget.join(found, "fraction", "left").join(top, "fraction").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select("fraction", "k", "found", "calls", "ceiling", F.try_divide("found", "calls").alias("recall"), F.try_divide("found", "ceiling").alias("of_ceiling"))


def effort_by_station(det: DataFrame, fraction: float = 0.5, score: str = "rank_score", group: str = "station") -> DataFrame:
    """Each station's calls found in its own best share, recall, ceiling, average precision and that of a random order."""
    rows = det.where("verdict IN ('call', 'false_positive')").withColumn("hit", (F.col("verdict") == "call").cast("int"))
    rows = running(rows.select(group, "det_id", "hit", score), [group], [F.col(score).desc_nulls_last(), F.col("det_id").asc()], {"pos": F.lit(1).cast("bigint"), "cum": F.col("hit")})
    size = rows.groupBy(F.col(group).alias("_h")).agg(F.count("*").alias("n"))
    rows = rows.join(size, F.col(group).eqNullSafe(F.col("_h")))
    k = F.bround(F.col("n") * fraction)
    out = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.sum("hit").alias("calls"), F.coalesce(F.sum(F.when(F.col("pos") <= k, F.col("hit"))), F.lit(0)).alias("found"),
        F.avg(F.when(F.col("hit") == 1, F.col("cum") / F.col("pos"))).alias("average_precision"),
    )
    out = out.withColumn("ceiling", F.least(F.col("calls"), F.bround(F.col("n") * fraction).cast("bigint")))
    return out.withColumn("recall", F.try_divide("found", "calls")).withColumn("random_precision", F.col("calls") / F.col("n"))


def ranking_comparison(det: DataFrame, signals: dict[str, bool] | None = None, fraction: float = 0.5) -> DataFrame:
    """Mean average precision over stations of the combined score and of each signal alone."""
    use = {c: up for c, up in (signals or SIGNALS).items() if c in det.columns}
    out = None
    for name, chosen in {"combined": use, **{c: {c: up} for c, up in use.items()}}.items():
        e = effort_by_station(det.transform(rank_score(chosen)), fraction)
        e = e.agg(F.avg("average_precision").alias("mean_ap"), F.avg(F.try_divide("found", "ceiling")).alias("mean_of_ceiling")).select(F.lit(name).alias("signals"), "*")
        out = e if out is None else out.unionByName(e)
    return out


def build_queue(det: DataFrame, gap_s: float = EPISODE_GAP_S, limit: int | None = None) -> DataFrame:
    """Detections with their episode's best rank score, the one to listen to first, and the order of review.

    Without any signal, episodes come in time order.
    """
    ranked = det if "rank_score" in det.columns else det.transform(rank_score())
    ranked = ranked.transform(assign_episodes(gap_s))
    w = Window.partitionBy(*KEYS, "episode_no")
    best = F.row_number().over(w.orderBy(F.col("rank_score").desc_nulls_last(), "start_s", "det_id")) == 1
    out = ranked.withColumn("episode_rank", F.max("rank_score").over(w)).withColumn("episode_size", F.count("*").over(w)).withColumn("listen_first", best)
    order = [F.col("episode_rank").desc_nulls_last(), *(F.col(c).asc() for c in (*KEYS, "episode_no")), F.col("rank_score").desc_nulls_last(), F.col("start_s").asc(), F.col("det_id").asc()]
    return prefix_count(out, order, "queue_no") if limit is None else out.orderBy(*order).limit(limit)


def most_suspect(flagged: DataFrame, n: int, order: Sequence[Column] = ()) -> DataFrame:
    """The n detections to export for a look: most flags first, then the least confident."""
    return flagged.where("n_flags > 0").orderBy(*(order or (F.desc("n_flags"), F.asc_nulls_first("confidence"), F.asc("det_id")))).limit(n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in the order given (which should end in a unique column)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
