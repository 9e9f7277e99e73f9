"""Readers of the files that detection pipelines leave behind; all with explicit schemas."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators.ranking import keep_first
from ..plans.lineage import cut
from .paths import open_path

DETECTION_CSV = "start_time double, end_time double, species string, confidence double, low_freq_ratio double, ood_distance double"
CLEANUP_CSV = (
    "station string, det_id bigint, species string, source_file string, start_time double, end_time double, confidence double, softmax_margin double, softmax_entropy double, "
    "knn_dist double, mahalanobis_d2 double, flag_mahal boolean, tag_top string, tag_score double, flag_tag boolean, n_neighbours int, flag_isolated boolean, "
    "station_regime string, flag_invading_cluster boolean, n_flags int, flag_reason string"
)
REVIEW_CSV = "indir string, infile string, manualid string"
HEADER_PIECE, LONGEST_HEADER = 1 << 14, 1 << 20  # bytes
MOST_SENT = 100_000  # files whose layouts are broadcast, some hundred bytes each
GENERATED = r"(summary|cleanup_vs_review|report)[^/]*\.csv$"


def _plain(name: str) -> str:
    return name.strip().strip('"').replace("*", "").replace(" ", "").lower()


def _first_line(path: str) -> str:
    """The first line with anything in it, from no more of the file than that takes; "" if there is none."""
    raw = b""
    with open_path(path) as f:
        while len(raw) < LONGEST_HEADER:
            more = f.read(HEADER_PIECE)
            raw += more
            whole = raw.lstrip() if not more else re.match(rb"(?s)\s*([^\r\n]+)[\r\n]", raw)
            if not more:
                return whole.splitlines()[0].decode("utf-8", "replace") if whole else ""
            if whole:
                return whole[1].decode("utf-8", "replace")
    raise ValueError(f"{path} has no header line in its first {LONGEST_HEADER} bytes")


def header_layouts(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``_path, at, width`` of CSV files ``path, _path``: where each of ``columns`` stands in the header (-1: nowhere; the last of equal
    names), and the number of names.  Only first lines are read, inside tasks; files without any line are left out.
    """
    want = [_plain(c) for c in columns]

    def layouts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                found = [(p, line) for p, q in zip(some.column("_path").to_pylist(), some.column("path").to_pylist(), strict=True) if (line := _first_line(q).lstrip("\ufeff"))]
                names = [[_plain(n) for n in next(csv.reader([line]))] for _, line in found]
                at = [{n: k for k, n in enumerate(row)} for row in names]
                parts = [pa.array([p for p, _ in found], pa.string()), pa.array([[a.get(w, -1) for w in want] for a in at], pa.list_(pa.int32())), pa.array([len(n) for n in names], pa.int32())]
                yield pa.RecordBatch.from_arrays(parts, names=["_path", "at", "width"])

    return files.select("path", "_path").mapInArrow(layouts, "_path string, at array<int>, width int")


def read_layouts(spark: SparkSession, paths: Sequence[str], glob: str, schema: str, skip: str = "") -> DataFrame:
    """CSV files whose headers vary in order, case and optional columns: the columns of ``schema`` by name, null where a file lacks
    one, and ``_path``.

    Files are listed without contents, and their first lines read inside tasks.  All contents are then one scan of as many text columns as
    the widest header has; where layouts differ, a file's own is joined to its rows by path, broadcast up to ``MOST_SENT`` files.
    The driver gets the number of files and whether they agree.
    """
    want = [c.strip().rsplit(" ", 1) for c in schema.split(",")]

    def found(reader: DataFrameReader, form: str) -> DataFrame:
        df = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format(form).load(list(paths)).withColumn("_path", F.col("_metadata.file_path"))
        return df.where(~F.lower("_path").rlike(skip)) if skip else df

    listed = found(spark.read, "binaryFile").where("length > 0").select("path", "_path")
    heads = cut(header_layouts(listed, [n for n, _ in want]))
    all_ = heads.agg(F.count("*").alias("files"), F.max("width").alias("width"), F.min("at").alias("least"), F.max("at").alias("most")).first()
    if not all_["files"]:
        return spark.createDataFrame([], f"{schema}, _path string")
    names = [f"c{i}" for i in range(all_["width"])]
    rows = found(spark.read.schema(", ".join(f"{c} string" for c in names)).option("header", True), "csv")
    if all_["least"] == all_["most"]:
        values = [F.col(names[i]) if i >= 0 else F.lit(None) for i in all_["least"]]
    else:
        at = heads.select("_path", "at")
        rows = rows.join(F.broadcast(at) if all_["files"] <= MOST_SENT else at, "_path")
        values = [F.get(F.array(*(F.col(c) for c in names)), F.col("at")[k]) for k in range(len(want))]
    return rows.select(*(v.cast(t).alias(n) for v, (n, t) in zip(values, want, strict=True)), "_path")


def read_detections(spark: SparkSession, root: str, suffix: str = "_detections.csv") -> DataFrame:
    """Every ``*_detections.csv`` under ``root``: station is the first folder below it, recording the file's name.

    ``det_id`` is a hash of the row's keys, so it does not depend on the order of files.
    """
    rows = read_layouts(spark, [root], f"*{suffix}", DETECTION_CSV)
    inside = F.regexp_replace("_path", rf"^.*?\Q{root.rstrip('/').removeprefix('file://')}\E/", "")
    rows = rows.withColumn("station", F.when(F.contains(inside, F.lit("/")), F.split(inside, "/")[0]).otherwise("")).withColumn("recording", F.regexp_replace(parse.base_name(F.col("_path")), rf"\Q{suffix}\E$", ""))
    rows = rows.withColumnRenamed("start_time", "start_s").withColumnRenamed("end_time", "end_s").drop("_path")
    return rows.withColumn("det_id", F.xxhash64("station", "recording", "species", "start_s", "confidence"))


def read_detections_wallclock(spark: SparkSession, root: str, species: Sequence[str] = ()) -> DataFrame:
    """read_detections with ``detected_at``; recordings whose name has no start time keep a null one."""
    det = read_detections(spark, root)
    if species:
        det = det.where(F.col("species").isin(*species))
    return det.withColumn("detected_at", parse.detected_at(parse.recording_start(F.col("recording")), F.col("start_s")))


def unparsed(det: DataFrame) -> DataFrame:
    """How many rows and recordings have no start time."""
    gone = F.col("detected_at").isNull()
    return det.agg(F.count("*").alias("rows"), F.count_if(gone).alias("unparsed_rows"), F.count_distinct(F.when(gone, F.col("recording"))).alias("unparsed_recordings"))


def read_reviews(spark: SparkSession, paths: str | Sequence[str], blank_is_confirmed: bool = True) -> DataFrame:
    """Review CSVs as strings, whatever the case, spaces and asterisks of their headers; generated summaries are skipped."""
    raw = read_layouts(spark, [paths] if isinstance(paths, str) else paths, "*.csv", REVIEW_CSV, GENERATED)
    bad = raw.groupBy("_path").agg(*(F.count(c).alias(c) for c in ("indir", "infile"))).where("indir = 0 OR infile = 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['_path']} lacks folder or file names")
    return review_rows(raw.withColumnRenamed("infile", "file").withColumnRenamed("manualid", "manual_id"), blank_is_confirmed)


def review_rows(raw: DataFrame, blank_is_confirmed: bool = True) -> DataFrame:
    """``indir, file, manual_id`` -> the review table."""
    name, tag = F.col("file"), F.col("manual_id")
    rows = raw.select(
        "file", parse.site_from_indir(F.col("indir")).alias("station"), parse.species_from_indir(F.col("indir"), name).alias("species"), F.coalesce(parse.clip_recording(name), F.lit("")).alias("recording"),
        parse.clip_start(name).alias("start_s"), parse.clip_confidence(name).alias("confidence"), F.coalesce("manual_id", F.lit("")).alias("manual_id"), parse.verdict(tag, blank_is_confirmed).alias("verdict"),
    )
    return rows.withColumn("review_id", F.xxhash64("station", "species", "file", "manual_id"))


def read_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """The clean and suspicious tables of a cleanup run in one, tagged."""
    one = lambda name: read_layouts(spark, [folder], f"{name}_detections.csv", CLEANUP_CSV).drop("_path").withColumn("cleanup", F.lit(name))
    both = one("clean").unionByName(one("suspicious"), allowMissingColumns=True)
    return both.withColumn("recording", parse.recording_stem(F.col("source_file"))).withColumnRenamed("start_time", "start_s").drop("source_file")


def build_labelled(cleanup: DataFrame, real: Sequence[str], empty: Sequence[str], target: str, never: Sequence[str] = ()) -> DataFrame:
    """Labels without review: clean target detections where it lives are 1; all of them where it does not, and all of ``never``, are 0.

    Of rows that agree in station, recording, species and start the first rule wins.
    """
    parts = [
        (cleanup.where(F.col("station").isin(*real) & (F.col("species") == target) & (F.col("cleanup") == "clean")), 1),
        (cleanup.where(F.col("station").isin(*empty) & (F.col("species") == target)), 0),
        (cleanup.where(F.col("species").isin(*never)), 0),
    ]
    rows = reduce(DataFrame.unionByName, [df.withColumn("label", F.lit(y)).withColumn("_rule", F.lit(i)) for i, (df, y) in enumerate(parts)])
    return keep_first(rows, ["station", "recording", "species", "start_s"], [F.col("_rule"), F.col("det_id")]).drop("_rule")


def clip_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Exported clips by path and name; only paths are read.  A name of another shape keeps start -1 and a null confidence."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path")
    return catalog_clips(files)


def catalog_clips(files: DataFrame) -> DataFrame:
    name = parse.base_name(F.col("path"))
    return files.select(
        "path", F.regexp_replace(name, r"(?i)\.wav$", "").alias("clip_id"), parse.clip_species(name).alias("species"), parse.clip_recording(name).alias("recording"), parse.clip_start(name).alias("start_s"),
        parse.clip_confidence(name).alias("confidence"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("station"),
    )


def audio_files(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Recordings under ``root`` as a binaryFile table, those below excluded prefixes marked ``skipped``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(root)
    gone = F.lit(False)
    for p in exclude:
        gone = gone | F.contains(F.col("path"), F.lit(p.rstrip("/") + "/"))
    return files.withColumn("skipped", gone)
