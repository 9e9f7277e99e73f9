"""Near-duplicate embeddings through binary codes of random rotations.

Each distinct vector is stored with one code: its sign bits under several independent rotations, and two correction
factors.  Slices of the bits key hash tables.  Codes and factors alone meet in the buckets: unbiased estimates
with confidence bounds clear most pairs, and the rows of the pairs that stay undecided fetch their vectors for exact
cosines.  A pair that shares several buckets counts in the first of its tables only.  Buckets beyond a block are cut into
pairs of blocks, so no task gets all of one; links leave a block as counts and a spanning forest; equal vectors
are one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .meetings import Undecided, block_pairs, decided, forest, meetings
from .rotation_codes import Codes, encode, matrix, packed, valid

BLOCK, MISS, BOUND = 1024, 1e-5, 5.0


def table_shape(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables: buckets of about 16 unrelated vectors, a linked pair missed with probability MISS."""
    bits = min(30, max(8, ceil(log2(max(n, 1) / 16 + 1))))
    same = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(MISS) / log(1 - same))


def code_of(m: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``bits`` sign bits of each row, from an even number of rotations, and a factor for each half of these."""
    h = ceil(bits / m.shape[1] / 2)
    one, two = encode(m, range(h), seed), encode(m, range(h, 2 * h), seed)
    return np.concatenate([one[0], two[0]], axis=1), np.stack([one[1], two[1]], axis=1)


def _undecided(t: pa.Table, bits: int, tables: int, threshold: float, seed: int) -> pa.Table:
    """Within each bucket's block pair: the rows of the pairs that codes do not clear and no earlier table has."""
    t = t.sort_by([("dim", "ascending"), ("bucket", "ascending"), ("x", "ascending"), ("y", "ascending")])
    out, dims = Undecided(t["task"][0].as_py()), t["dim"].to_numpy()
    cuts = (np.flatnonzero(np.diff(dims)) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
        same_dim, dim = t.slice(start, end - start), int(dims[start])
        h = ceil(bits * tables / dim / 2)
        codes = np.unpackbits(np.frombuffer(b"".join(same_dim["code"].to_pylist()), np.uint8).reshape(end - start, -1), axis=1, count=2 * h * dim)
        known = Codes(codes, np.stack([same_dim["f1"].to_numpy(), same_dim["f2"].to_numpy()], axis=1), dim, seed)
        sides, x, y, bucket = (same_dim[c].to_numpy() for c in ("side", "x", "y", "bucket"))
        for at in meetings(same_dim, "bucket"):
            est, bound = known.estimates(at, BOUND)
            maybe = np.triu(est + bound >= threshold, 1)
            if x[at.start] != y[at.start]:
                maybe &= sides[at, None] != sides[None, at]
            a, b = np.nonzero(maybe)
            slices, table = codes[at, : bits * tables].reshape(-1, tables, bits), int(bucket[at.start]) >> 51
            first = np.ones(len(a), bool)
            for k in range(0, len(a), 8192):
                first[k : k + 8192] = (slices[a[k : k + 8192]] == slices[b[k : k + 8192]]).all(axis=2).argmax(axis=1) == table
            if first.any():
                out.add(same_dim["key"].slice(at.start, at.stop - at.start), a[first], b[first])
    return out.table()


def _linked(t: pa.Table, threshold: float) -> pa.Table:
    """Within each meeting: the exact cosines of the undecided pairs; each class's links (counting members) and a forest of them, both as rows."""
    key, other, count = [], [], []
    for part, a, b in decided(t):
        keys, weight = part["key"].to_pylist(), part["n"].to_numpy()
        m = matrix(part["vec"], part["dim"][0].as_py())
        norm = np.sqrt((m * m).sum(axis=1))
        cos = np.empty(len(a))
        for at in range(0, len(a), 65536):
            i, j = a[at : at + 65536], b[at : at + 65536]
            cos[at : at + 65536] = (m[i] * m[j]).sum(axis=1) / (norm[i] * norm[j])
        a, b = a[cos >= threshold], b[cos >= threshold]
        links = np.bincount(a, weight[b], len(keys)) + np.bincount(b, weight[a], len(keys))
        tree = forest(np.stack([a, b], axis=1), len(keys))
        some = np.flatnonzero(links)
        key += [keys[i] for i in some] + [keys[i] for i, _ in tree]
        other += [None] * len(some) + [keys[j] for _, j in tree]
        count += [int(links[i]) for i in some] + [0] * len(tree)
    return pa.table({"key": pa.array(key, pa.binary()), "other": pa.array(other, pa.binary()), "links": pa.array(count, pa.int64())})


def undecided_pairs(coded: DataFrame, bits: int, tables: int, threshold: float, seed: int, tmp: Scratch) -> DataFrame:
    """``task, meeting, pos, key, partners``: what exact cosines have to decide, from ``key, dim, code, f1, f2``."""

    def buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(bits)).astype(np.int64)
        for b in it:
            out = []
            for code, dim in zip(b.column("code").to_pylist(), b.column("dim").to_pylist(), strict=True):
                s = np.unpackbits(np.frombuffer(code, np.uint8), count=bits * tables).reshape(tables, bits).astype(np.int64)
                out.append((s @ weight + (((np.arange(tables) << 20) + dim % (1 << 20)) << 31)).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], names=[*b.schema.names, "bucket"])

    kind = "key binary, dim int, code binary, f1 double, f2 double"
    hashed = coded.select("key", "dim", "code", "f1", "f2").mapInArrow(buckets, f"{kind}, bucket array<bigint>")
    hashed = tmp.write(hashed.select("key", "dim", "code", "f1", "f2", F.explode("bucket").alias("bucket")))
    met = block_pairs(hashed, "bucket", BLOCK, tmp)
    return met.groupBy("task").applyInArrow(lambda t: _undecided(t, bits, tables, threshold, seed), Undecided.SCHEMA)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link where their cosine, in double precision, is at least ``threshold``; n_links counts rows, so
    equal vectors link with each other.  Vectors that are null, zero or hold null or non-finite components link
    with nothing and are their own components, and vectors of different lengths do not link.  Rows that
    repeat a vec_id are vectors of their own; a component whose vec_ids are all null has a null component_id.
    An empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark)
    rows = packed(vectors, id_col, vec_col)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def keyed(it):
        for b in it:
            key = [hashlib.blake2b(x, digest_size=16).digest() for x in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.binary())], names=[*b.schema.names, "key"])

    rows = tmp.write(rows.mapInArrow(keyed, f"vec_id {kind}, dim int, vec binary, key binary"))
    classes = tmp.write(rows.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    bits, tables = table_shape(classes.count(), threshold)

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for dim in sorted(set(b.column("dim").to_pylist())):
                part = pa.table(b).filter(pc.equal(b.column("dim"), dim))
                code, factor = code_of(matrix(part["vec"], dim), bits * tables, seed)
                packed_code = pa.array([x.tobytes() for x in np.packbits(code, axis=1)], pa.binary())
                yield from pa.table({"key": part["key"], "dim": part["dim"], "code": packed_code, "f1": factor[:, 0], "f2": factor[:, 1]}).combine_chunks().to_batches()

    codes = tmp.write(classes.select("key", "dim", "vec").mapInArrow(coded, "key binary, dim int, code binary, f1 double, f2 double"))
    undecided = tmp.write(undecided_pairs(codes, bits, tables, threshold, seed, tmp))
    met = undecided.join(classes.select("key", "dim", "vec", "n"), "key").groupBy("task")
    met = tmp.write(met.applyInArrow(lambda t: _linked(t, threshold), "key binary, other binary, links bigint"))
    links = met.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    found = components(spark, met.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")), tmp)
    whole = classes.select("key", "n", "least").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = tmp.write(whole)
    least = tmp.write(whole.groupBy("root").agg(F.min("least").alias("component_id")))
    answer = whole.join(least, "root").join(links, "key", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(answer, "key").select("vec_id", "n_links", "component_id")
    alone = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(~valid(F.col("_v")))
    out = out.union(alone.select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    out = tmp.write(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), keep=True)
    tmp.drop()
    return out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("component_id", F.col("component_id").cast("bigint"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN k ON k.x = e.vec_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = e.vec_id
"""
