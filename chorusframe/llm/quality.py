"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class has its mean and covariance; a covariance is shrunk towards the pooled one and towards its own
diagonal.  The score is the logistic of the log-density difference, whose Mahalanobis terms come from the inverses of Cholesky factors, cached with the model.  The classes are fitted from sums of the
features and of their products over all labelled rows, which Spark adds up; the driver gets one row for each
class and moment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import Scratch, byte_column, in_slices

POOLED, DIAGONAL, RIDGE = 0.5, 0.05, 1e-2
FEATURES = (
    "log_words", "log_word_length", "letters", "upper", "digits", "symbols", "stops", "distinct", "commonest", "repeated_lines",
    "log_line_length", "symbol_ends", "short_words", "capital_words", "entropy", "repeated_pairs",
)
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 stop or comma, 5 symbol, 6 white space, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[ord(c) for c in ".,;:?'"]] = 4
_KIND[[ord(c) for c in "!#$%&*+/<=>@\\^_`|~{}[]()\"-"]] = 5
_KIND[[32, *range(9, 14)]] = 6
_SYMBOLS = tuple(bytes([b]) for b in np.flatnonzero(_KIND == 5))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text; shares as square roots, sizes as logarithms."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_KIND, count, 8)
    size = len(text) - kind[6]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    p = count[count > 0] / len(text)
    pairs = n - 1
    share = [
        (kind[1] + kind[2] + kind[7]) / size, kind[2] / size, kind[3] / size, kind[5] / size, kind[4] / size,
        len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines),
        sum(w.endswith(_SYMBOLS) for w in words) / n, sum(len(w) <= 3 for w in words) / n, sum(65 <= w[0] <= 90 for w in words) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs else 0.0,
    ]
    s = np.sqrt(share)
    return [
        float(np.log1p(n)), float(np.log(size / n)), *s[:5].tolist(), *s[5:8].tolist(), float(np.log(len(text) / max(len(lines), 1))),
        *s[8:11].tolist(), float(-(p * np.log2(p)).sum()), float(s[11]),
    ]


@dataclass
class Discriminant:
    prior: float  # log odds of class 1
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors, one a class
    logdets: np.ndarray

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant | float:
        """From each class's count, sums and sums of products.  With a class missing: its opposite's prior as a constant score."""
        if n.min() == 0:
            return float((n[1] + 1) / (n.sum() + 2))
        means = sums / n[:, None]
        scatter = products - n[:, None, None] * np.einsum("ki,kj->kij", means, means)
        pooled = scatter.sum(axis=0) / n.sum()
        factors, logdets = [], []
        for k in (0, 1):
            few = POOLED + (1 - POOLED) * len(FEATURES) / (len(FEATURES) + n[k])  # small classes lean on the pooled matrix
            cov = (1 - few) * scatter[k] / n[k] + few * pooled
            cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(len(FEATURES))
            chol = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(chol))
            logdets.append(2 * np.log(np.diag(chol)).sum())
        return cls(float(np.log(n[1] / n[0])), means, np.array(factors), np.array(logdets))

    def score(self, x: np.ndarray) -> np.ndarray:
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        z = self.prior + 0.5 * (far[0] + self.logdets[0] - far[1] - self.logdets[1])
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3 are never learnt from; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(it):
            x = [statistics(t) for t in byte_column(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {kind}, x array<double>")


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant | float:
    """Fit on every labelled row that is not held out; labels other than 0 and 1 are left out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("y"))
    rows = features.join(known, "doc_id").select("y", "x")
    d = len(FEATURES)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in it:
            y, x = batch.column("y").to_numpy(), np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
            for k in (0, 1):
                m = x[y == k]
                total[k] += np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "v"])

    found = {r["at"]: r["v"] for r in rows.mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    total = np.array([found.get(i, 0.0) for i in range(2 * (1 + d + d * d))]).reshape(2, -1)
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def scorer(model: Discriminant | float):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series(np.full(len(x), model))
        return pd.Series(model.score(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

    return score


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null texts and those without words have statistics of zero and are scored like any other; rows that repeat
    a doc_id are scored each, and learnt from each where labelled; an empty table gives no rows; further
    columns are never inputs.  Without labels of both classes all scores are the smoothed share of class 1.
    """
    tmp = Scratch(docs.sparkSession)
    features = tmp.write(featured(docs, id_col, text_col), keep=True)
    score = scorer(train(features, labels))
    out = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with the columns of ``docs``, whose score reaches ``at_least``.  Statistics are computed once, beside the documents."""
    tmp = Scratch(docs.sparkSession)
    place, names = docs.columns.index(text_col), docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # mapInArrow can't take names with dots

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(it):
            x = pa.array([statistics(t) for t in byte_column(batch.column(place))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, x], names=[*batch.schema.names, "x"])

    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)), StructField("x", ArrayType(DoubleType()))])
    measured = tmp.write(docs.toDF(*plain).mapInArrow(run, schema), keep=True)
    score = scorer(train(measured.select(F.col(plain[names.index(id_col)]).alias("doc_id"), "x"), labels))
    return measured.where(score("x") >= at_least).select(*plain).toDF(*names)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
