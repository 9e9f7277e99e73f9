"""Rows that share a bucket meet in pairs of bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TASK_ROWS = 8192


def block_pairs(rows: DataFrame, group: str, block: int, tmp: Scratch) -> DataFrame:
    """Each row once for every pair of blocks of its group that it takes part in: adds ``x <= y`` (block numbers), ``side`` and ``task``.

    A group of up to ``block`` rows is one block, met with itself; many such groups share a task of about
    TASK_ROWS rows, and each block pair of a larger group has a task of its own.
    """
    size = tmp.write(rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1"))  # a table of its own, so that a join with a hot group can be split
    small = size.agg(F.sum(F.when(F.col("_n") <= block, F.col("_n")))).first()[0] or 0
    out = rows.join(size, group).withColumn("_k", F.ceil(F.col("_n") / block))
    out = out.withColumn("_i", F.pmod(F.xxhash64("key"), F.col("_k"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
    x, y = F.least("_i", "_j"), F.greatest("_i", "_j")
    shared = F.pmod(F.xxhash64(group), F.lit(ceil(small / TASK_ROWS) + 1))
    task = F.when(F.col("_k") == 1, F.xxhash64(F.lit("small"), shared)).otherwise(F.xxhash64(group, x, y))
    return out.select(*rows.columns, x.alias("x"), y.alias("y"), (F.col("_i") > F.col("_j")).cast("int").alias("side"), task.alias("task"))


def meetings(t: pa.Table, group: str) -> Iterator[slice]:
    """The block pairs of a task, one by one, as places in the table sorted by group, x and y."""
    names, x, y = t[group].to_numpy(), t["x"].to_numpy(), t["y"].to_numpy()
    cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows], strict=True):
        yield slice(lo, hi)


class Undecided:
    """The rows of pairs that sketches do not decide, each with its later partners' positions in the meeting."""

    SCHEMA = "task bigint, meeting int, pos int, key binary, partners binary"

    def __init__(self, task: int):
        self.task, self.number = task, 0
        self.cols: list[list] = [[] for _ in range(5)]

    def add(self, keys: pa.ChunkedArray, a: np.ndarray, b: np.ndarray) -> None:
        """The pairs (a, b), a < b and sorted, of one meeting's rows."""
        some = np.unique(np.concatenate([a, b]))
        place = np.searchsorted(some, b).astype("<u4")
        lo, hi = np.searchsorted(a, some), np.searchsorted(a, some, "right")
        self.number += 1
        new = [self.task] * len(some), [self.number] * len(some), range(len(some)), keys.take(pa.array(some, pa.int64())).to_pylist(), [place[i:j].tobytes() for i, j in zip(lo, hi, strict=True)]
        for col, x in zip(self.cols, new, strict=True):
            col += x

    def table(self) -> pa.Table:
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
        return pa.table([pa.array(c, k) for c, k in zip(self.cols, kinds, strict=True)], names=[x.split()[0] for x in self.SCHEMA.split(", ")])


def decided(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Of a task's undecided rows (with what was fetched for them): each meeting's rows and its pairs of positions."""
    t = t.sort_by([("meeting", "ascending"), ("pos", "ascending")])
    cuts = (np.flatnonzero(np.diff(t["meeting"].to_numpy())) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
        part = t.slice(lo, hi - lo)
        later = [np.frombuffer(x, "<u4") for x in part["partners"].to_pylist()]
        yield part, np.repeat(np.arange(len(later)), [len(x) for x in later]), np.concatenate(later).astype(np.int64)


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of n things."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = find(int(a)), find(int(b))
        if ra != rb:
            parent[rb] = ra
            out.append((int(a), int(b)))
    return out
