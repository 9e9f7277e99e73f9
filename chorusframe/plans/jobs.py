"""The two batch jobs: flag detections, and evaluate flags against review."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import disagreement
from ..functions.scores import entropy, margin
from ..operators import metrics, ranking, search, sessions
from ..operators.gates import distance_flag, merge_flags, tag_flag
from ..operators.matching import match_review
from ..operators.neighbours import flag_isolated, knn_distance
from ..operators.regime import flag_invading_cluster, station_regimes
from .lineage import cut


def run_cleanup(det: DataFrame, suspicious_tags: Sequence[str] = (), k: int = 5, percentile: float = 0.95) -> DataFrame:
    """All signals and flags that the table's columns allow, in one plan, then ``n_flags`` and ``flag_reason``."""
    if "probs" in det.columns:
        det = det.withColumn("softmax_margin", margin(F.col("probs"))).withColumn("softmax_entropy", entropy(F.col("probs")))
    if "features" in det.columns:
        det = knn_distance(det, k)
    if "mahalanobis_d2" in det.columns:
        det = det.transform(distance_flag(percentile))
    if "tag_top" in det.columns:
        det = det.transform(tag_flag(suspicious_tags))
    det = det.transform(flag_isolated())
    if {"knn_dist", "mahalanobis_d2"} <= set(det.columns):
        det = flag_invading_cluster(det)
    return det.transform(merge_flags())


def review_queue(flagged: DataFrame) -> DataFrame:
    return ranking.build_queue(flagged)


#: Signals whose cutoffs are swept, and the end at which each speaks for a false positive.
SWEPT = {"mahalanobis_d2": "high", "n_neighbours": "low", "confidence": "low", "softmax_margin": "low", "knn_dist": "low"}
HELD_OUT = ("knn_dist", "confidence", "n_neighbours")
TAG_CUTS = tuple(x / 20 for x in range(1, 20))
_REPORTED = {"cleanup", "flag_reason", "n_flags", "n_neighbours", "mahalanobis_d2", "softmax_margin", "softmax_entropy", "knn_dist", "tag_top", "tag_score", "flag_tag", "flag_invading_cluster"}


def cleanup_reports(matched: DataFrame, flags: Sequence[str]) -> dict[str, Callable[[], DataFrame]]:
    """What can be reported of a matched table, by name; a report is worked out when it is called.  Those whose columns the table lacks are left out."""
    # A detection may answer several reviews: rows go by the review's id.
    hit = matched.where("cleanup IS NOT NULL").withColumn("det_id", F.col("review_id"))
    if flags and "n_flags" not in hit.columns:
        hit = hit.withColumn("n_flags", sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0)))
    have, ranked = set(hit.columns), hit.transform(ranking.rank_score())
    out: dict[str, Callable[[], DataFrame]] = {
        "summary": lambda: metrics.summarize_review(matched), "stations": lambda: metrics.station_species(matched), "evaluation": lambda: metrics.evaluate(matched),
        "confusion": lambda: metrics.confusion(matched), "disagreements": lambda: matched.withColumn("disagreement", disagreement(F.col("verdict"), F.col("cleanup"))),
        "event_effort": lambda: sessions.event_effort(hit), "episode_effort": lambda: sessions.episode_effort(hit), "durations": lambda: sessions.duration_summary(hit),
        "effort_curve": lambda: ranking.effort_curve(ranked), "effort_by_station": lambda: ranking.effort_by_station(ranked), "ranking_signals": lambda: ranking.ranking_comparison(hit),
        "operating_points": lambda: search.operating_points(hit), "confidence": lambda: search.confidence_sweep(hit),
        "against_confidence": lambda: search.confidence_baseline(hit, F.col("cleanup") == "suspicious"),
    }
    if flags:
        out |= {"per_filter": lambda: metrics.per_filter(hit, flags), "combinations": lambda: metrics.filter_combinations(hit, flags), "votes": lambda: metrics.vote_analysis(hit, most=len(flags))}
    for c, end in SWEPT.items():
        if c in have:
            out[f"sweep_{c}"] = lambda c=c, end=end: search.sweep(hit, c, end)
            if end == "low":
                out[f"station_cv_{c}"] = lambda c=c: search.station_cv(hit, c)
            if c in HELD_OUT:
                out[f"held_out_{c}"] = lambda c=c: search.station_holdout(hit, c)
    if {"mahalanobis_d2", "n_neighbours"} <= have:
        out["thresholds"] = lambda: search.optimize_thresholds(hit)
    if {"mahalanobis_d2", "knn_dist"} <= have:
        out |= {"triage": lambda: station_regimes(hit), "gated_recurrence_cv": lambda: search.gated_recurrence_cv(hit)}
    if {"n_neighbours", "flag_invading_cluster"} <= have:
        out["two_protocol_cv"] = lambda: search.two_protocol_cv(hit)
    if "tag_top" in have:
        out["tag_classes"] = lambda: metrics.tag_classes(hit)
    if {"flag_tag", "tag_score"} <= have:
        others = F.lit(False)
        for f in flags:
            if f != "flag_tag":
                others = others | F.coalesce(F.col(f), F.lit(False))
        out["tag_scores"] = lambda: search.tag_score_sweep(hit, others, "flag_tag", "tag_score", TAG_CUTS)
    return out


def evaluate_cleanup(review: DataFrame, cleaned: DataFrame, flags: Sequence[str], exclude: Sequence[str] = (), tolerance: int = 1, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every report on a cleanup run (see ``cleanup_reports``), or those of ``only``, from one matched table that is written once."""
    keep = tuple(c for c in cleaned.columns if c in {*_REPORTED, *flags} and c not in review.columns)
    matched = match_review(review.where(~F.coalesce(F.col("station").isin(*exclude), F.lit(False))) if exclude else review, cleaned, tolerance, keep=keep)
    return {name: make() for name, make in cleanup_reports(cut(matched), flags).items() if only is None or name in only}
