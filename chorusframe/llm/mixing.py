"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of about ``block_words`` words by a hash of its documents.  A source's target
is a number of whole passes over its blocks and a part of one more: those blocks are its quota.  The tree
splits the quotas among the output shards: the root has all shards and all quotas, and each node gives its
left half a multivariate-hypergeometric draw of its blocks, so that every shard is a uniform draw from the
whole mix and the quotas are met exactly.  Draws are seeded by node; any task finds the shard of a block by
walking down from the root, and nothing but one row per source is held in common.  In a source, blocks go
to the shards in a permuted order, each pass with its own; documents are shuffled within their shard.
"""

from __future__ import annotations

from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

BLOCK_WORDS, SHARD_BLOCKS = 65_536, 16
#: Blocks that numpy's draws can hold; blocks grow where a mix would have more.  A document up to this part of its target is taken whole or not at all.
MOST_BLOCKS, TOLERANCE = 900_000_000, 0.01
#: Sources the driver may hold (a row each); more is an error.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its size and the excess is shared again."""
    out, free = [0.0] * len(sizes), [i for i, (n, w) in enumerate(zip(sizes, weights, strict=True)) if n and w]
    left = float(total)
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def shard_of(source: np.ndarray, unit: np.ndarray, quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """The shard of each (source, unit), unit counting a source's quota from 0: a walk down the splitting tree."""
    out, whole = np.zeros(len(unit), np.int64), sum(quotas)

    def first(shard: int) -> int:  # blocks of all shards before this one
        return shard * whole // shards

    stack = [(0, shards, np.array(quotas, np.int64), np.arange(len(unit)), unit.copy())]
    while stack:
        lo, hi, have, rows, rank = stack.pop()
        if hi - lo == 1:
            out[rows] = lo
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, first(mid) - first(lo), method="marginals")
        goes = rank < left[source[rows]]
        if goes.any():
            stack.append((lo, mid, left, rows[goes], rank[goes]))
        if not goes.all():
            stack.append((mid, hi, have - left, rows[~goes], rank[~goes] - left[source[rows[~goes]]]))
    return out


def _odd_step(n: int, seed: int) -> int:
    """A step coprime to n, for the permutation i -> (step * i + shift) % n."""
    step = int(np.random.default_rng([seed, n]).integers(1, max(n, 2)))
    while gcd(step, n) != 1:
        step = step % n + 1
    return step


def mix_plan(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 7, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, placements`` and the columns ``keep``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``total`` times all words; a target stops
    at ``most`` times its source's words.  ``placements`` has one ``(copy, shard, words)`` for each time that the
    mix takes the document; ``taken`` is the sum of words.  All copies are whole.  The document in which a
    source's target ends is taken or left, whichever comes nearer to the target, where it holds up to TOLERANCE of it;
    a larger one gives its first words only (its placement has fewer words than its size).
    A null text has no words and is never taken; rows that repeat a doc_id count each; an empty table gives no
    rows; further columns are ignored.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark)
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed))  # rows that share an id are spread by their texts
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("_h"), *keep)
    if not keep:
        base = tmp.write(base, keep=True)
    rows = base.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in rows]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], total * sum(sizes), most)
    passes = [int(t // n) if n else 0 for t, n in zip(aims, sizes, strict=True)]
    rest = [int(t) - p * n for t, p, n in zip(aims, passes, sizes, strict=True)]
    block_words = max(block_words, ceil((sum(aims) + sum(sizes)) / MOST_BLOCKS))
    blocks = [max(1, ceil(n / block_words)) for n in sizes]
    table = spark.createDataFrame(
        [(r.source, i, n, t, p, x, b, _odd_step(b, seed), (seed * (i + 1)) % b) for i, (r, n, t, p, x, b) in enumerate(zip(rows, sizes, aims, passes, rest, blocks, strict=True))],
        "s string, s_no int, source_size bigint, target double, passes int, rest bigint, blocks bigint, step bigint, shift bigint",
    )
    # One row per source, at most MAX_SOURCES: its size is bounded.
    dealt = base.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("_h", F.lit(1)), F.col("blocks")))
    # The part pass takes blocks in permuted order until the rest is met; its last block is cut inside.
    sums = dealt.groupBy("s_no", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("rest", "blocks", "step", "shift", "passes")))
    sums = sums.withColumn("rank", F.pmod(F.col("block") * F.col("step") + F.col("shift"), F.col("blocks"))).withColumn("super", F.floor(F.col("rank") / 1024))
    sums = tmp.write(sums)
    inner = Window.partitionBy("s_no", "super").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("s_no").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = sums.groupBy("s_no", "super").agg(F.sum("words").alias("w")).withColumn("base", F.coalesce(F.sum("w").over(outer), F.lit(0))).drop("w")
    placed = sums.withColumn("in", F.coalesce(F.sum("words").over(inner), F.lit(0))).join(supers, ["s_no", "super"])
    placed = tmp.write(placed.withColumn("room", F.col("rest") - F.col("in") - F.col("base")).drop("super", "in", "base"))
    # Quotas in blocks: whole passes, and the blocks of the part pass.
    part = {r.s_no: r.q for r in placed.where("room > 0").groupBy("s_no").agg(F.max("rank").alias("q")).collect()}
    quotas = [p * b + part.get(i, -1) + 1 for i, (p, b) in enumerate(zip(passes, blocks, strict=True))]
    shards = max(1, ceil(sum(quotas) / shard_blocks))

    @F.pandas_udf("bigint")
    def shard(source: pd.Series, unit: pd.Series) -> pd.Series:
        return pd.Series(shard_of(source.to_numpy(np.int64), unit.to_numpy(np.int64), quotas, shards, seed))

    units = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes")))).where("copy < passes OR room > 0")
    # The part pass takes a prefix of the permuted ranks, so its units follow those of the whole passes without gaps.
    units = units.withColumn("unit", F.col("copy") * F.col("blocks") + F.pmod(F.col("rank") + F.when(F.col("copy") < F.col("passes"), F.col("copy")).otherwise(0), F.col("blocks")))
    units = units.withColumn("shard", shard(F.col("s_no"), F.col("unit")))
    units = units.groupBy("s_no", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("units"), F.first("room").alias("room"))
    units = tmp.write(units, keep=True)
    tmp.drop()
    in_block = Window.partitionBy("s_no", "block").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(units, ["s_no", "block"], "left")
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.coalesce(F.sum("size").over(in_block), F.lit(0))))
    out = out.withColumn("_part", left)
    nearest = F.when(F.col("_part") * 2 >= F.col("size"), F.col("size")).otherwise(0)
    out = out.withColumn("_left", F.when((F.col("_part") < F.col("size")) & (F.col("size") <= TOLERANCE * F.col("target")), nearest).otherwise(F.col("_part")))
    words = lambda u: F.when(u["copy"] < F.col("passes"), F.col("size")).otherwise(F.col("_left"))
    spots = F.transform("units", lambda u: F.struct(u["copy"].alias("copy"), u["shard"].alias("shard"), words(u).cast("bigint").alias("words")))
    out = out.withColumn("placements", F.filter(F.coalesce(spots, F.array()), lambda x: x["words"] > 0))
    taken = F.aggregate("placements", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "placements", *keep)


def mix(docs: DataFrame, text_col: str = "text", shard_col: str = "_shard", order_col: str = "_order", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy, with its shard and its order in the shard.

    The text of a copy that is cut has its first words joined by one space.  ``shard_col`` and ``order_col`` must not be
    columns of ``docs`` (see common.free_name).
    """
    if {shard_col, order_col} & set(docs.columns):
        raise ValueError("shard_col or order_col is a column of the documents")
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, source_col)]
    boxed = docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.col(text_col).alias("t"), F.struct(*rest).alias("_rest"))
    plan = mix_plan(boxed, keep=("_rest",), **options | {"id_col": "i", "source_col": "s", "text_col": "t"}).select("doc_id", "source", "size", "_rest", F.explode("placements").alias("_spot"))
    text = F.col("_rest").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("_spot.words").cast("int")), " ")
    text = F.when(F.col("_spot.words") < F.col("size"), cut).otherwise(text)
    named = {id_col: F.col("doc_id"), source_col: F.col("source"), text_col: text}
    order = F.xxhash64("_spot.shard", "_spot.copy", F.col("doc_id").cast("string"))
    kept = [named[c] if c in named else F.col("_rest").getField(c) for c in docs.columns]
    return plan.select(*(x.alias(c) for x, c in zip(kept, docs.columns, strict=True)), F.col("_spot.shard").alias(shard_col), order.alias(order_col))


def write_shards(mixed: DataFrame, path: str, shards: int, shard_col: str = "_shard", order_col: str = "_order") -> None:
    """One folder per shard, its documents shuffled."""
    mixed.repartition(shards, shard_col).sortWithinPartitions(shard_col, order_col).drop(order_col).write.partitionBy(shard_col).parquet(path)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", F.size("placements").alias("copies"))
