"""Nearest neighbours by cosine through one-bit codes of randomly rotated vectors.

Queries meet the packed bits and correction factors of all candidates, in blocks of bounded size; candidates' vectors
stay where they are.  A first pass finds each query's best estimates over all blocks, whose exact scores set the
query's bar.  A second pass marks every candidate whose estimate plus error bound reaches a query's bar, one bit
for a query and candidate.  Only marked candidates fetch their vectors, once for a block of queries, and are
reranked exactly.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, parts
from .rotation_codes import EPS, cosines, encode, estimates, matrix, packed

#: Rows of a block of queries and of candidates; bits of a code at least; estimates a query scores for its bar, times k.
QUERY_BLOCK, CANDIDATE_BLOCK, CODE_BITS, LIKELY = 1024, 32768, 512, 4
#: Queries whose estimates are held at once.
STEP = 128


def turns(dim: int) -> range:
    return range(max(1, ceil(CODE_BITS / dim)))


def _block(queries: pa.Table, codes: pa.Table, seed: int, eps: float):
    """The queries in order of qid, STEP at a time: their place, estimates (own id: -inf) and the codes' bounds."""
    dim = codes["dim"][0].as_py()
    q = matrix(queries["vec"], dim)
    bits = np.unpackbits(np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(codes.num_rows, -1), axis=1, count=dim * len(turns(dim)))
    factor, mine, ids = codes["factor"].to_numpy(), queries["query_id"].to_numpy(), codes["vec_id"].to_numpy()
    for at in range(0, len(q), STEP):
        est, bound = estimates(bits, factor, q[at : at + STEP], turns(dim), seed, eps)
        est[mine[at : at + STEP, None] == ids[None, :]] = -np.inf
        yield at, est, bound


def _likely(queries: pa.Table, codes: pa.Table, k: int, seed: int) -> pa.Table:
    qid, cid, score = [], [], []
    if queries.num_rows and codes.num_rows:
        queries = queries.sort_by("qid")
        own, ids = queries["qid"].to_numpy(), codes["cid"].to_numpy()
        n = min(LIKELY * k, codes.num_rows)
        for at, est, _ in _block(queries, codes, seed, EPS):
            top = np.argpartition(-est, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(est, top, axis=1)
            row, col = np.nonzero(value > -np.inf)
            qid.append(own[at + row])
            cid.append(ids[top[row, col]])
            score.append(value[row, col])
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
    return pa.table({"qid": join(qid, np.int64), "cid": join(cid, np.int64), "est": join(score, np.float64)})


_MARKED = "dim int, g bigint, c bigint, cid bigint, mask binary"


def _marked(queries: pa.Table, codes: pa.Table, seed: int, eps: float) -> pa.Table:
    schema = pa.schema([("dim", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("cid", pa.int64()), ("mask", pa.binary())])
    if not queries.num_rows or not codes.num_rows:
        return schema.empty_table()
    queries = queries.sort_by("qid")
    bar, keep = queries["bar"].to_numpy(), np.zeros((codes.num_rows, queries.num_rows), bool)
    for at, est, bound in _block(queries, codes, seed, eps):
        keep[:, at : at + STEP] = ((est + bound[None, :] >= bar[at : at + STEP, None]) & (est > -np.inf)).T
    some = np.flatnonzero(keep.any(axis=1))
    mask = [x.tobytes() for x in np.packbits(keep[some], axis=1)]
    found = codes.select(["dim", "g", "c", "cid"]).take(pa.array(some))
    return pa.table([*found.columns, pa.array(mask, pa.binary())], schema=schema)


def _exact(queries: pa.Table, marked: pa.Table, k: int) -> pa.Table:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and marked.num_rows:
        queries = queries.sort_by("qid")
        dim, q_ids, ids = queries["dim"][0].as_py(), queries["query_id"].to_pylist(), marked["vec_id"].to_numpy()
        q, m = matrix(queries["vec"], dim), matrix(marked["vec"], dim)
        keep = np.unpackbits(np.frombuffer(b"".join(marked["mask"].to_pylist()), np.uint8).reshape(len(m), -1), axis=1, count=len(q)).astype(bool)
        for i in range(len(q)):
            rank = np.flatnonzero(keep[:, i])
            exact = cosines(m[rank], q[i])
            top = np.lexsort((ids[rank], -exact))[:k]
            out["query_id"] += [q_ids[i]] * len(top)
            out["vec_id"] += ids[rank[top]].tolist()
            out["score"] += exact[top].tolist()
    return pa.table([pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], names=list(out))


def _each(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.withColumn(column, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))


def marked_pairs(queries: DataFrame, candidates: DataFrame, k: int, seed: int, eps: float, id_col: str, vec_col: str, tmp: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries ``qid, query_id, dim, vec, g``, once for every block ``c``, the candidates ``cid, vec_id, dim, vec`` and the pairs to rerank: ``dim, g, c, cid, mask``."""

    def rows(df: DataFrame) -> DataFrame:
        return packed(df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).alias("_v")).where("_id IS NOT NULL"), "_id", "_v")

    def code(it):
        for b in it:
            for dim in sorted(set(b.column("dim").to_pylist())):
                part = pa.table(b).filter(pc.equal(b.column("dim"), dim))
                bits, factor = encode(matrix(part["vec"], dim), turns(dim), seed)
                coded = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
                yield from part.append_column("code", coded).append_column("factor", pa.array(factor)).combine_chunks().to_batches()

    q = tmp.write(rows(queries).select(F.monotonically_increasing_id().alias("qid"), F.col("vec_id").alias("query_id"), "dim", "vec"))
    c = rows(candidates).mapInArrow(code, "vec_id bigint, dim int, vec binary, code binary, factor double")
    c = tmp.write(c.select(F.monotonically_increasing_id().alias("cid"), "vec_id", "dim", "vec", "code", "factor"), keep=True)
    n, n_q = c.count(), max(1, ceil(q.count() / QUERY_BLOCK))
    n_c = max(1, ceil(n / CANDIDATE_BLOCK), min(ceil(parts(q.sparkSession) / n_q), ceil(n / 2048)))
    q = q.withColumn("g", F.pmod(F.xxhash64("qid"), F.lit(n_q)))
    codes = _each(c.select("cid", "vec_id", "dim", "code", "factor", F.pmod(F.xxhash64("cid"), F.lit(n_c)).alias("c")), "g", n_q)
    codes = codes.groupBy("dim", "g", "c")
    likely = _each(q, "c", n_c).groupBy("dim", "g", "c").cogroup(codes).applyInArrow(lambda a, b: _likely(a, b, k, seed), "qid bigint, cid bigint, est double")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("est"), "cid"))
    likely = likely.withColumn("_r", best).where(F.col("_r") <= LIKELY * k).select("qid", "cid")

    def scored(it):
        for b in it:
            score = [float(cosines(np.frombuffer(v, "<f8")[None, :], np.frombuffer(w, "<f8"))[0]) for v, w in zip(b.column("vec").to_pylist(), b.column("with").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(score, pa.float64())], names=["qid", "score"])

    pairs = likely.join(c.select("cid", "vec"), "cid").join(q.select("qid", F.col("vec").alias("with")), "qid").select("qid", "vec", "with")
    bars = pairs.mapInArrow(scored, "qid bigint, score double").groupBy("qid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # LIKELY * k at most
    bars = bars.select("qid", F.get("s", F.lit(k - 1)).alias("bar"))
    q = _each(tmp.write(q.join(bars, "qid", "left").na.fill(-2.0, ["bar"]), keep=True), "c", n_c)
    pairs = q.groupBy("dim", "g", "c").cogroup(codes).applyInArrow(lambda a, b: _marked(a, b, seed, eps), _MARKED)
    return q, c.select("cid", "vec_id", "vec"), tmp.write(pairs, keep=True)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, seed: int = 11, eps: float = EPS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest candidates of another id, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, and vectors of different
    lengths are not compared; a query without candidates has no rows.  Rows that repeat an id stay rows; ids
    are whole numbers (of any type, returned as bigint), and null ids take no part.  Empty tables give no rows;
    further columns are ignored.
    """
    tmp = Scratch(candidates.sparkSession)
    q, c, pairs = marked_pairs(queries, candidates, k, seed, eps, id_col, vec_col, tmp)
    tmp.drop()
    found = q.groupBy("dim", "g", "c").cogroup(pairs.join(c, "cid").groupBy("dim", "g", "c")).applyInArrow(lambda a, b: _exact(a, b, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_reranked(queries: DataFrame, candidates: DataFrame, k: int = 5, seed: int = 11, eps: float = EPS, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The part of all pairs whose exact cosine search() computes."""
    tmp = Scratch(candidates.sparkSession)
    q, c, pairs = marked_pairs(queries, candidates, k, seed, eps, id_col, vec_col, tmp)

    def ones(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8)).sum())], pa.int64())], names=["n"])

    n = pairs.select("mask").mapInArrow(ones, "n bigint").select(F.sum("n")).first()[0] or 0
    tmp.drop()
    return n / max(q.select("qid").distinct().count() * c.count(), 1)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows.where("vec_id % 50 = 0"), rows)


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
             AND len([x for x in embedding if x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
