"""Assembly of a training manifest without station leakage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import drop_hot_negatives
from ..operators.matching import apply_review
from ..operators.quality import cross_label_duplicates
from ..operators.ranking import keep_first
from ..operators.windows import augment_to


def reviewed_clips(review: DataFrame, clips: DataFrame, target: str, background: str = "Background") -> DataFrame:
    """Reviewed clips that are on disk, labelled by their verdict."""
    label = F.when(F.col("verdict") == "call", F.lit(target)).otherwise(F.lit(background))
    named = clips.select("path", "station", F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    judged = review.where("verdict IN ('call', 'false_positive')").select("file", "verdict", "recording", "start_s")
    return judged.join(named, "file").select("path", label.alias("label"), "station", F.lit("review").alias("source"), F.lit(True).alias("verified"), "recording", "start_s")


def missing_reviewed(review: DataFrame, clips: DataFrame) -> DataFrame:
    """How many judged rows have their clip, how many do not, and the first file that is missing."""
    named = clips.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file")).distinct().withColumn("here", F.lit(True))
    judged = review.where("verdict IN ('call', 'false_positive')").join(named, "file", "left")
    return judged.agg(F.count("here").alias("found"), F.count_if(F.col("here").isNull()).alias("missing"), F.min(F.when(F.col("here").isNull(), F.col("file"))).alias("example"))


def best_copies(manifest: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """One row a path, human-verified first; then one a content that came under several labels, best-attested source first."""
    one = keep_first(manifest, ["path"], [F.desc("verified"), F.col("source"), F.col("label")])
    mixed = cross_label_duplicates(one.where(F.col(content_hash).isNotNull()), content_hash, "label").select(content_hash)
    clash = one.join(mixed, content_hash, "left_semi")
    rest = one.join(mixed, content_hash, "left_anti")
    return rest.unionByName(keep_first(clash, [content_hash], [F.desc("verified"), F.col("source"), F.col("path")]).select(*rest.columns))


def build_manifest(parts: Sequence[DataFrame], review: DataFrame, scores: DataFrame, target_rows: int, hot: float = 0.9, machine: Sequence[str] = ("auto",), background: str = "Background") -> DataFrame:
    """Union, review, priority dedupe, score prune, content dedupe, augmentation; every part has
    ``path, label, station, source, verified, species, recording, start_s, content_hash``."""
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    said = apply_review(all_rows.withColumn("_was", F.coalesce("verified", F.lit(False))).drop("verified"), review, background)
    reviewed = said.withColumn("verified", F.col("verified") | F.col("_was")).drop("_was")
    kept = best_copies(reviewed)
    pruned = drop_hot_negatives(kept, scores, hot, machine, background).where(~F.col("dropped")).drop("dropped", "spared")
    return augment_to(pruned, target_rows)

