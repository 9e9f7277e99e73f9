"""Logistic probes, one left-out station a fold, all folds fitted at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .metrics import auc

MOST_FOLDS = 10_000
CELLS = 1 << 21  # numbers that a task works on at once


def _newton_sums(rows: DataFrame, folds: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """By fold, over the rows of all other stations: log loss, its gradient and the upper half of its Hessian, in one job."""
    at, d = {s: i for i, s in enumerate(folds)}, weights.shape[1]
    one, two = np.triu_indices(d)
    width = 1 + d + len(one)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(folds), width))
        for b in it:
            x_all = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y_all = b.column("y").to_numpy(zero_copy_only=False)
            own_all = np.array([at.get(s, -1) for s in b.column("station").to_pylist()])
            step = max(1, CELLS // (len(folds) + width))
            for i in range(0, len(y_all), step):
                x, y, own = x_all[i : i + step], y_all[i : i + step, None], own_all[i : i + step]
                z = x @ weights.T
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                parts = np.logaddexp(0, z) - y * z, p - y, p * (1 - p)
                rest = np.flatnonzero(own >= 0)
                for part in parts:
                    part[rest, own[rest]] = 0  # a row trains every fold but its own station's
                total[:, 0] += parts[0].sum(0)
                total[:, 1 : 1 + d] += parts[1].T @ x
                total[:, 1 + d :] += parts[2].T @ (x[:, one] * x[:, two])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "s"])

    out = np.zeros((len(folds), width))
    for r in rows.mapInArrow(sums, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():  # ``width`` numbers a fold
        out.flat[r["at"]] = r["s"]
    return out


def _fit(rows: DataFrame, folds: Sequence[str], penalty: np.ndarray, steps: int) -> np.ndarray:
    """Newton steps, halved where the loss would rise, of all folds at once."""
    d = penalty.shape[1]
    upper = np.triu_indices(d)
    best, move, least = np.zeros(penalty.shape), np.zeros(penalty.shape), np.full(len(folds), np.inf)
    settled = np.zeros(len(folds), bool)
    for _ in range(steps):
        tried = best + move
        got = _newton_sums(rows, folds, tried)
        loss = got[:, 0] + (penalty * tried**2).sum(1) / 2
        for i in np.flatnonzero(~settled):
            if loss[i] > least[i] + 1e-9 * abs(least[i]):
                move[i] /= 2
            else:
                best[i], least[i] = tried[i], loss[i]
                h = np.zeros((d, d))
                h[upper] = got[i, 1 + d :]
                h += np.triu(h, 1).T + np.diag(penalty[i])
                move[i] = -np.linalg.lstsq(h, got[i, 1 : 1 + d] + penalty[i] * best[i], rcond=None)[0]
            if np.abs(move[i]).max() < 1e-9:
                settled[i], move[i] = True, 0
        if settled.all():
            return best
    raise ValueError(f"{np.count_nonzero(~settled)} of {len(folds)} fits have not settled after {steps} steps")


def probe_probabilities(df: DataFrame, features: Sequence[str], positive: str = "positive", l2: float = 10.0, least: int = 20, steps: int = 100) -> DataFrame:
    """``station, positive, probability``: each row's probability from a logistic regression on the rows of all other stations.

    Features are standardised by what a fold trains on; ``l2`` weighs half the squared coefficients, the intercept is free.  Means
    and variances come from a row a station, and a Newton step is one job for all folds, over rows written once.  A station with
    fewer than ``least`` rows or with one class has no fold, nor has one whose others have one class; its rows still train the
    others.  Rows with a null or NaN feature, or a null station or ``positive``, take no part.  Fits that do not settle (without
    ``l2``, on classes that a plane separates) are an error, as are more than ``MOST_FOLDS`` stations, a row each at the driver.
    """
    x = [F.col(c).cast("double") for c in features]
    whole = F.col("station").isNotNull() & F.col(positive).isNotNull()
    for c in x:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    rows = df.where(whole).select(F.col("station").cast("string").alias("station"), F.col(positive).cast("double").alias("y"), *(c.alias(f"_{i}") for i, c in enumerate(x)))
    per = rows.groupBy("station").agg(F.count("*").alias("n"), F.sum("y").alias("p"), *(f(f"_{i}").alias(f"{k}{i}") for i in range(len(x)) for k, f in (("m", F.avg), ("v", F.var_pop))))
    got = per.orderBy("station").limit(MOST_FOLDS + 1).collect()
    if len(got) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} stations")
    n, p = (np.array([r[k] for r in got], float) for k in ("n", "p"))
    apart = (n >= least) & (p > 0) & (p < n) & (p.sum() > p) & (n.sum() - p.sum() > n - p)
    if not apart.any():
        return df.sparkSession.createDataFrame([], "station string, positive boolean, probability double")
    mean, var = (np.array([[r[f"{k}{i}"] for i in range(len(x))] for r in got], float).reshape(len(got), len(x)) for k in ("m", "v"))

    def moments(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = of @ mean / of.sum()
        return centre, of @ (var + (mean - centre) ** 2) / of.sum()

    # All folds share features scaled by the whole table; the penalty makes up for the scale of a fold's own training rows.
    centre, spread = moments(n)
    spread = np.where(spread > 1e-20 * np.maximum(1, centre**2), np.sqrt(spread), 1.0)
    folds, penalty = [], []
    for i in np.flatnonzero(apart):
        v = moments(np.where(np.arange(len(n)) == i, 0, n))[1] / spread**2
        folds.append(got[i]["station"])
        penalty.append([0.0, *np.where(v > 1e-20, l2 * v, max(l2, 1.0))])  # a feature that is constant in training gets no weight
    scaled = F.array(F.lit(1.0), *((F.col(f"_{i}") - float(centre[i])) / float(spread[i]) for i in range(len(x))))
    rows = cut(rows.select("station", "y", scaled.alias("x")))
    weights = _fit(rows, folds, np.array(penalty), steps)
    at, d = {s: i for i, s in enumerate(folds)}, len(x) + 1

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = np.array([at.get(s, -1) for s in b.column("station").to_pylist()], int)
            b, own = b.filter(pa.array(own >= 0)), own[own >= 0]
            z = (b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * weights[own]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("station"), pa.array(b.column("y").to_numpy(zero_copy_only=False) > 0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=["station", "positive", "probability"])

    return rows.mapInArrow(score, "station string, positive boolean, probability double")


def probe_loso(df: DataFrame, features: Sequence[str], positive: str = "positive", **fit: float) -> DataFrame:
    """``station, auc`` of probe_probabilities(), which names the stations that have one."""
    scored = probe_probabilities(df, features, positive, **fit)
    return auc(scored, "probability", F.col("positive"), ("station",)).select("station", "auc")
