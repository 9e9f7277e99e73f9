"""The detection table that all operators take, and the adapter at its edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("station", "recording", "species")
DETECTIONS = T.StructType(
    [
        T.StructField("det_id", T.LongType()),
        T.StructField("station", T.StringType()),
        T.StructField("recording", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("start_s", T.DoubleType()),
        T.StructField("end_s", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detected_at", T.TimestampNTZType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("cleanup", T.StringType()),
    ]
)
ALIASES = {
    "station": ("site",),
    "recording": ("source_file", "file"),
    "start_s": ("start_time", "start"),
    "end_s": ("end_time", "end"),
    "confidence": ("conf", "score"),
}
REQUIRED = ("station", "recording", "species", "start_s")


def normalise_detections(df: DataFrame) -> DataFrame:
    """Rename known aliases, turn NaN into null, and fail on a missing key column.

    Further columns are kept.  A missing ``det_id`` is derived from the row's keys.
    """
    for name, others in ALIASES.items():
        if name not in df.columns:
            found = next((o for o in others if o in df.columns), None)
            if found:
                df = df.withColumnRenamed(found, name)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"detections lack {', '.join(missing)}")
    types = dict(df.dtypes)
    clean = {c: F.nanvl(F.col(c), F.lit(None).cast(t)).cast(t) for c, t in types.items() if t in ("double", "float")}
    clean["start_s"] = clean.get("start_s", F.col("start_s")).cast("double")
    df = df.withColumns(clean)
    if "det_id" not in df.columns:
        df = df.withColumn("det_id", F.xxhash64(*REQUIRED, *(c for c in ("confidence",) if c in df.columns)))
    return df
