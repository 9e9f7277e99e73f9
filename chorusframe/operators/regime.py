"""Whether a station's detections hold a tight cluster of a foreign sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .prefix import exact_quantiles, running

MIN_FRACTION, MIN_RATIO, MIN_ROWS = 0.25, 2.0, 10
INVADED, NORMAL = "invaded", "normal"


def station_regimes(det: DataFrame, tight: str = "knn_dist", distance: str = "mahalanobis_d2", group: str = "station", min_fraction: float = MIN_FRACTION, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per station: where its tightness has the largest ratio between neighbours in order, what lies on either side, and the verdict.

    The cluster is everything up to that gap.  It is invading if it is large enough, the gap wide enough, and its
    median distance to the training data above that of the rest.
    """
    known = det.where(F.col(tight).isNotNull()).select(group, "det_id", F.col(tight).alias("t"), F.col(distance).alias("d"))
    rows = cut(running(known, [group], [F.col("t").asc(), F.col("det_id").asc()], {"pos": F.lit(1).cast("bigint")}))
    size = rows.groupBy(group).agg(F.count("*").alias("m"))
    after = rows.select(group, (F.col("pos") - 1).alias("pos"), F.col("t").alias("next"))
    rows = rows.join(after, [group, "pos"], "left").join(size, group)
    ratio = F.col("next") / F.greatest("t", F.lit(1e-9))
    lowest = F.greatest(F.lit(1), F.floor(F.col("m") * min_fraction))
    rows = rows.withColumn("ratio", F.when(F.col("pos") >= lowest, ratio))
    best = rows.groupBy(group).agg(F.max("m").alias("m"), F.max(F.when(F.col("ratio").isNotNull(), F.struct("ratio", (-F.col("pos")).alias("at")))).alias("best"))
    cluster = best.select(group, "m", F.col("best.ratio").alias("gap_ratio"), (-F.col("best.at")).alias("cluster"))
    halves = rows.join(cluster.select(group, "cluster"), group).where("cluster IS NOT NULL").select(group, (F.col("pos") <= F.col("cluster")).alias("near"), "d")
    medians = exact_quantiles(halves, "d", [0.5], [group, "near"])
    sides = medians.groupBy(group).agg(F.max(F.when(F.col("near"), F.col("q")[0])).alias("cluster_distance"), F.max(F.when(~F.col("near"), F.col("q")[0])).alias("rest_distance"))
    out = det.groupBy(group).agg(F.count("*").alias("n")).join(cluster, group, "left").join(sides, group, "left")
    verdict = (
        F.when(F.coalesce("m", F.lit(0)) < MIN_ROWS, "too few detections")
        .when(F.col("gap_ratio").isNull() | (F.col("gap_ratio") < min_ratio), "no gap")
        .when((F.col("cluster") < min_fraction * F.col("m")) | (F.col("cluster") >= F.col("m")), "cluster too small")
        .when(F.col("cluster_distance").isNull() | F.col("rest_distance").isNull(), "no distance values")
        .when(F.col("cluster_distance") <= F.col("rest_distance"), "cluster is the familiar side")
        .otherwise(INVADED)
    )
    return out.withColumn("verdict", verdict).withColumn("cluster_fraction", F.col("cluster") / F.col("m"))


def flag_invading_cluster(det: DataFrame, tight: str = "knn_dist", group: str = "station", **options) -> DataFrame:
    """Adds ``flag_invading_cluster`` and ``station_regime``."""
    found = station_regimes(det, tight=tight, group=group, **options).where(F.col("verdict") == INVADED).select(group, F.col("cluster").alias("_cluster"))
    out = running(det, [group], [F.col(tight).asc_nulls_last(), F.col("det_id").asc()], {"_pos": F.lit(1).cast("bigint")}).join(found, group, "left")
    flag = F.coalesce(F.col("_pos") <= F.col("_cluster"), F.lit(False)) & F.col(tight).isNotNull()
    return out.withColumn("flag_invading_cluster", flag).withColumn("station_regime", F.when(F.col("_cluster").isNotNull(), INVADED).otherwise(NORMAL)).drop("_pos", "_cluster")
