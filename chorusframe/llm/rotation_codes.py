"""One-bit codes of randomly rotated vectors, with the scalars that make inner-product estimates unbiased.

A unit vector o is rotated by h random orthogonal matrices, stacked over sqrt(h) as E(o); its code is the signs x of
E(o) over sqrt(hD), and its factor f = <x, E(o)>.  For a unit query q, <x, E(q)> / f estimates <o, q> without bias, and
the error is at most eps * sqrt((1 - f^2) / f^2 / h / (D - 1)) with a probability that grows fast with eps.

Two codes are enough where neither vector is at hand: with other rotations E' for the second, its own code gives
y = E'^T x' / f', an unbiased stand-in for the vector, which then serves as the query of the first code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 4.0


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, seed]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid(v: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, and every component a finite number."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, dim, vec`` of the valid rows, vec as little-endian doubles."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(valid(F.col("v")))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = [np.array(x, "<f8") for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([len(x) for x in v], pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "dim", "vec"])

    return rows.mapInArrow(pack, f"vec_id {kind}, dim int, vec binary")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def stacked(m: np.ndarray, turns: range, seed: int) -> np.ndarray:
    """E(m), a row each, without the factor 1 / sqrt(h)."""
    return np.concatenate([m @ rotation(m.shape[1], seed + t).T for t in turns], axis=1)


def encode(m: np.ndarray, turns: range, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (one byte each) and factors of the rows of ``m``."""
    o = stacked(unit(m), turns, seed)
    return o > 0, np.abs(o).sum(axis=1) / (len(turns) * np.sqrt(m.shape[1]))


def deviation(factor: np.ndarray, turns: int, dim: int) -> np.ndarray:
    return np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / turns / max(dim - 1, 1))


def signs(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits.shape[1]))


def estimates(bits: np.ndarray, factor: np.ndarray, queries: np.ndarray, turns: range, seed: int, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """For each query vector and code: the estimated cosine, and for each code the bound of its error."""
    q = stacked(unit(queries), turns, seed).astype(np.float32) / np.float32(np.sqrt(len(turns)))
    est = (q @ signs(bits).T) / factor[None, :].astype(np.float32)
    return est, eps * deviation(factor, len(turns), queries.shape[1]) + 1e-5


class Codes:
    """Codes of an even number of rotations with a factor for each half of them: estimated cosines of any two, and their bounds."""

    def __init__(self, bits: np.ndarray, factors: np.ndarray, dim: int, seed: int):
        h = bits.shape[1] // dim // 2
        self.one, two = signs(bits[:, : h * dim]), signs(bits[:, h * dim :])
        y = sum(two[:, t * dim : (t + 1) * dim] @ rotation(dim, seed + h + t).astype(np.float32) for t in range(h)) / np.sqrt(h)
        y = (y / factors[:, 1:]).astype(np.float32)
        self.one /= factors[:, :1].astype(np.float32)
        self.seen = stacked(y, range(h), seed).astype(np.float32) / np.float32(np.sqrt(h))
        self.first, self.second = deviation(factors[:, 0], h, dim), deviation(factors[:, 1], h, dim)
        self.norm = np.sqrt((y * y).sum(axis=1))

    def estimates(self, rows: slice, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
        est = self.one[rows] @ self.seen[rows].T
        far = np.outer(self.first[rows], self.norm[rows]) ** 2 + self.second[rows][None, :] ** 2
        return (est + est.T) / 2, eps * np.sqrt(np.maximum(far, far.T)) + 1e-4


def cosines(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``m`` with ``q``, row sums in one order so that equal rows get equal values."""
    return (m * q).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((q * q).sum()))
