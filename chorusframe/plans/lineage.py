"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from the session's checkpoint folder.

    Where the session names none, a local session (tests) gets one of its own; a cluster's is refused, as its executors share no local folder.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the session's checkpoint folder, which driver and executors share."""
    if not spark.sparkContext.getCheckpointDir():
        cut(spark.range(0))
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
