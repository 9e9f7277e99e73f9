"""A training corpus from ``documents``: filter, deduplicate, redact, mix, pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it returned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorusframe.llm import minhash, mixing, packing, pii, quality
from chorusframe.llm.common import free_name, note_kept, shared_dir


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of changed texts; null texts keep what they had."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shard, order = free_name(docs.columns, "_shard"), free_name(docs.columns, "_order")
    mix = mixing.mix(docs, shard_col=shard, order_col=order)
    return _measured(mix.repartition(shard).sortWithinPartitions(shard, order).drop(shard, order))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("pii", redacted), ("mixing", mixed), ("packing", packed)]

#: Trained models, minhash and tokens are beyond SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = note_kept(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
