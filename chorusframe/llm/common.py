"""Helpers that the training-data operators share: scratch tables, word hashes, row packing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a local session (tests) gets one of its own and a cluster's is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_kept: dict[str, list[str]] = {}


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


def note_kept(spark: SparkSession, path: str) -> str:
    """Note a path that a returned result reads, for release()."""
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the tables and archives that this session's results read, once these results are no longer needed."""
    _remove(spark, _kept.get(spark.sparkContext.applicationId, []))


def free_name(columns: list[str], name: str) -> str:
    """``name``, or that with more underscores in front, which none of ``columns`` is called."""
    while name.lower() in (c.lower() for c in columns):
        name = "_" + name
    return name


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those not kept, ``release`` the others.

    A written table outlives the executor that wrote it, and a lost task is rerun from it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, shared_dir(spark), []

    def path(self, keep: bool = False) -> str:
        p = f"{self.root}/scratch-{uuid.uuid4().hex}"
        if keep:
            note_kept(self.spark, p)
        else:
            self.paths.append(p)
        return p

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        p = self.path(keep)
        df.write.parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self) -> None:
        """Remove every table written without ``keep`` so far."""
        _remove(self.spark, self.paths)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> Column:
    """16 bytes that name a text; a null text is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that sums of hashes become uniform keys."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(h, words), np.uint64, len(words))


def runs_of(h: np.ndarray, w: int, base: int) -> np.ndarray:
    """A key for each run of ``w`` hashes: a polynomial in an odd base modulo 2**64, finalised."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(w):
        out = out * _U(base) + h[k : k + n]
    return mix(out)


def in_slices(batches, size: int = SLICE_BYTES):
    """Arrow batches cut so that a slice has about ``size`` bytes, or one row: what a task makes of a slice stays small beside long texts."""
    for batch in batches:
        rows = max(1, int(size * batch.num_rows / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_column(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
