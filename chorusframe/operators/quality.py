"""Checks on manifests, indexes and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import to_count, to_flag
from .metrics import table_fingerprint


def validate_manifest(manifest: DataFrame, key: str = "path") -> DataFrame:
    """Each kind of violation with its count and up to five keys, the smallest."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = {f"blank_{c}": blank(c) for c in ("path", "label", "source") if c in manifest.columns}
    if "verified" in manifest.columns:
        checks["bad_verified"] = to_flag(F.col("verified")).isNull()
    for c in ("aug", "row"):
        if c in manifest.columns:
            checks[f"bad_{c}"] = to_count(F.col(c)).isNull()
    if "ok" in manifest.columns:
        checks["bad_ok"] = to_flag(F.col("ok")).isNull()
    if {"station", "possible_stations"} <= set(manifest.columns):
        checks["station_not_possible"] = (F.coalesce("station", F.lit("")) != "") & ~F.coalesce(F.array_contains("possible_stations", F.col("station")), F.lit(False))
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))
    rows = manifest.select(F.col(key).alias("_k"), F.explode(found).alias("violation"))
    top = F.row_number().over(Window.partitionBy("violation").orderBy("_k"))
    return rows.withColumn("_r", top).groupBy("violation").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.col("_k")))).alias("examples"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def provenance_conflicts(manifest: DataFrame, key: str = "path", columns: Sequence[str] = ("label", "source", "station")) -> DataFrame:
    """Keys that come with more than one provenance."""
    return manifest.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("versions")).where("versions > 1")


def verdict_conflicts(review: DataFrame, keys: Sequence[str]) -> DataFrame:
    return review.groupBy(*keys).agg(F.count_distinct("verdict").alias("verdicts"), F.count("*").alias("n")).where("verdicts > 1")


def contiguous_rows(index: DataFrame, row: str = "row") -> DataFrame:
    """Whether a row column is exactly 0..n-1."""
    out = index.agg(F.count("*").alias("n"), F.min(row).alias("first"), F.max(row).alias("last"), F.count_distinct(row).alias("distinct"))
    ok = (F.col("n") == 0) | ((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("distinct") == F.col("n")))
    return out.withColumn("contiguous", ok)


def cross_label_duplicates(df: DataFrame, content_hash: str, label: str) -> DataFrame:
    """Contents under more than one label."""
    return df.groupBy(content_hash).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1")


def check_lock(df: DataFrame, locks: DataFrame, name: str) -> DataFrame:
    """One row: whether the stored fingerprint of ``name`` is the table's.  No stored one counts as a failure."""
    now = table_fingerprint(df).select(F.lit(name).alias("name"), F.concat_ws(":", "rows", "xor", "total").alias("current"))
    stored = locks.where(F.col("name") == name).select("name", F.col("fingerprint").alias("stored"))
    return now.join(stored, "name", "left").withColumn("ok", F.coalesce(F.col("stored") == F.col("current"), F.lit(False)))


def missing_report(df: DataFrame, column: str, key: str) -> DataFrame:
    """How many rows lack ``column``, and the smallest key among them."""
    gone = F.col(column).isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(gone).alias("missing"), F.min(F.when(gone, F.col(key))).alias("example"))
