"""Class statistics of feature vectors and distances to them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import exact_quantiles


@dataclass
class ClassStatistics:
    """Means by class and the inverse of the pooled within-class covariance."""

    means: dict[str, np.ndarray]
    inverse: np.ndarray


def class_statistics(df: DataFrame, label: str, vec: str, ridge: float = 1e-3) -> ClassStatistics:
    """From sums and sums of products that each task makes and Spark adds up: a row a class and moment reaches the driver."""
    rows = df.where(F.col(vec).isNotNull()).select(F.col(label).cast("string").alias("c"), F.col(vec).cast("array<double>").alias("v"))

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in it:
            x = np.array(b.column("v").to_pylist(), float)
            c = np.array(b.column("c").to_pylist(), object)
            for k in set(c):
                m = x[c == k]
                part = np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])
                total[k] = total[k] + part if k in total else part
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(t), pa.string()), pa.array(np.arange(len(t))), pa.array(t)], names=["c", "at", "s"])

    found: dict[str, dict[int, float]] = {}
    for r in rows.mapInArrow(sums, "c string, at bigint, s double").groupBy("c", "at").agg(F.sum("s").alias("s")).collect():
        found.setdefault(r["c"], {})[r["at"]] = r["s"]
    if not found:
        raise ValueError("no vectors to fit on")
    d = int((np.sqrt(4 * max(map(len, found.values())) - 3) - 1) / 2)
    n = {c: t[0] for c, t in found.items()}
    means = {c: np.array([t[1 + i] for i in range(d)]) / n[c] for c, t in found.items()}
    scatter = sum(np.array([t[1 + d + i] for i in range(d * d)]).reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c, t in found.items())
    cov = scatter / max(sum(n.values()) - 1, 1) + ridge * np.eye(d)
    return ClassStatistics(means, np.linalg.inv(cov))


def with_distance(df: DataFrame, stats: ClassStatistics, vec: str, label: str | None = None, name: str = "mahalanobis_d2") -> DataFrame:
    """Squared Mahalanobis distance to the row's class, or without ``label`` to the nearest; null for a class or vector that is missing."""
    order = sorted(stats.means)
    centre = np.stack([stats.means[c] for c in order])
    inverse = stats.inverse

    @F.pandas_udf("double")
    def distance(v: pd.Series, c: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        at = {k: i for i, k in enumerate(order)}
        ok = v.notna().to_numpy() & (c.isin(order).to_numpy() | (c == "").to_numpy())
        if ok.any():
            x = np.stack(v[ok].to_numpy()).astype(float)
            d = x[:, None, :] - centre[None, :, :]
            all_d = np.einsum("nki,ij,nkj->nk", d, inverse, d)
            pick = [at.get(k) for k in c[ok]]
            out[ok] = [row.min() if p is None else row[p] for row, p in zip(all_d, pick, strict=True)]
        return pd.Series(out)

    of = F.coalesce(F.col(label).cast("string"), F.lit("\0")) if label else F.lit("")
    d = distance(F.col(vec).cast("array<double>"), of)
    return df.withColumn(name, F.when(~F.isnan(d), d))


def class_cutoffs(df: DataFrame, label: str, distance: str, percentiles: Sequence[int] = (50, 75, 90, 95, 97, 99)) -> DataFrame:
    """``species, percentile``: a map from each percentile to the distance of the class's own rows."""
    found = exact_quantiles(df.select(F.col(label).cast("string").alias("species"), F.col(distance).alias("d")), "d", [p / 100 for p in percentiles], ["species"])
    return found.select("species", F.map_from_arrays(F.array(*(F.lit(p) for p in percentiles)), "q").alias("percentile"))


def write_statistics(spark: SparkSession, stats: ClassStatistics, fingerprint: str, path: str) -> None:
    """Append a model's statistics to the store, a row a class, under the fingerprint of the model that made the vectors."""
    inverse = stats.inverse.ravel().tolist()
    rows = [(fingerprint, c, m.tolist(), inverse) for c, m in sorted(stats.means.items())]
    spark.createDataFrame(rows, "fingerprint string, species string, mean array<double>, inverse array<double>").write.mode("append").parquet(path)


def lookup_statistics(df: DataFrame, store: DataFrame) -> DataFrame:
    """Join class statistics by (fingerprint, species); statistics of another model never stand in."""
    return df.join(store, ["fingerprint", "species"], "left")
