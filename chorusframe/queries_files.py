"""Registered queries that write files from the given tables into the shared folder, read them back and work on them."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scores
from .operators import audio, gates, ranking, search, vectors, windows
from .plans import manifest
from .plans.lineage import shared_path
from .queries import DET, MAN, RECS, SIG, SQL, VEC_SPARK, m, micro, query
from .schema import normalise_detections
from .sources import readers, sinks

#: Detections whose recordings carry their start time in their names, but for one in five.
CLOCK = f"SELECT det_id, station, CASE WHEN substr(recording, 7) = '4' THEN concat('X', recording) ELSE concat('S20210224T0', substr(recording, 7), '3000_', station) END AS recording, species, start_s, end_s, confidence FROM ({DET}) d"
RATE = 100  # of the recordings written here, whose amplitude is 500 + 300 * (k * 37 % 100) in second k


@query(f"SELECT station, recording, species, start_s, end_s, {m('confidence', 'confidence')} FROM det", det=DET)
def s1_s10_detection_files(det):
    """Files by recording, one of them without detections, written and read."""
    root = shared_path(det.sparkSession, "detections")
    empty = det.select("station", F.concat("recording", F.lit("_silent")).alias("recording")).distinct()
    sinks.write_detection_files(det, det.select("station", "recording").union(empty), root)
    return readers.read_detections(det.sparkSession, root).select("station", "recording", "species", "start_s", "end_s", micro("confidence").alias("confidence"))


@query(
    "SELECT station, recording, species, start_s, CASE WHEN recording LIKE 'S%_ST%' THEN TIMESTAMP '2021-02-24 00:30:00' + to_hours(CAST(substr(recording, 12, 1) AS INT)) + to_seconds(start_s) END AS detected_at FROM det",
    det=CLOCK,
)
def s2_wallclock_files(det):
    root = shared_path(det.sparkSession, "detections")
    sinks.write_detection_files(det, det.select("station", "recording"), root)
    return readers.read_detections_wallclock(det.sparkSession, root).select("station", "recording", "species", "start_s", "detected_at")


@query("SELECT count(*) AS rows, count(*) FILTER (recording LIKE 'X%') AS unparsed_rows, count(DISTINCT CASE WHEN recording LIKE 'X%' THEN recording END) AS unparsed_recordings FROM det", det=CLOCK)
def q7_unparsed_names(det):
    root = shared_path(det.sparkSession, "detections")
    sinks.write_detection_files(det, det.select("station", "recording"), root)
    return readers.unparsed(readers.read_detections_wallclock(det.sparkSession, root))


@query("SELECT station, det_id, species, recording, start_s, n_flags, CASE WHEN n_flags = 0 THEN 'clean' ELSE 'suspicious' END AS cleanup FROM (SELECT *, CAST(CASE WHEN flag_tag THEN 1 ELSE 0 END + CASE WHEN flag_isolated THEN 1 ELSE 0 END AS INT) AS n_flags FROM sig)", sig=SIG)
def s4_s11_cleanup_files(sig):
    root = shared_path(sig.sparkSession, "cleanup")
    flagged = sig.drop("cleanup").withColumn("n_flags", F.col("flag_tag").cast("int") + F.col("flag_isolated").cast("int"))
    sinks.write_cleanup_files(flagged, root)
    return readers.read_cleanup(sig.sparkSession, root).select("station", "det_id", "species", "recording", "start_s", "n_flags", "cleanup")


@query("SELECT cleanup, count(*) AS n, count(*) FILTER (n_flags > 0) AS flagged FROM (SELECT CASE WHEN flag_tag OR flag_isolated THEN 'suspicious' ELSE 'clean' END AS cleanup, CASE WHEN flag_tag THEN 1 ELSE 0 END + CASE WHEN flag_isolated THEN 1 ELSE 0 END AS n_flags FROM sig) GROUP BY cleanup", sig=SIG)
def s11_write_cleanup(sig):
    root = shared_path(sig.sparkSession, "cleanup")
    sinks.write_cleanup(sig.drop("cleanup").withColumn("n_flags", F.col("flag_tag").cast("int") + F.col("flag_isolated").cast("int")), root)
    return sig.sparkSession.read.parquet(root).groupBy(F.col("cleanup").cast("string").alias("cleanup")).agg(F.count("*").alias("n"), F.count_if(F.col("n_flags") > 0).alias("flagged"))


def _amplitude(second: np.ndarray) -> np.ndarray:
    return 500 + 300 * (second * 37 % 100)


def _recordings(recs: DataFrame) -> DataFrame:
    """Writes a recording for each row of ``recs`` (a recording of several stations once), and gives the files."""
    root = shared_path(recs.sparkSession, "audio")

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for station, name, seconds in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(RATE)
                    w.writeframes(np.repeat(_amplitude(np.arange(int(seconds))), RATE).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([f"{station}/{name}.wav"]), pa.array([out.getvalue()], pa.binary())], names=["file", "content"])

    sinks.save_named(recs.select("station", "recording", "duration_s").mapInArrow(make, "file string, content binary"), root)
    return readers.audio_files(recs.sparkSession, root, ["/ST03"])


@query("SELECT recording, station = 'ST03' AS skipped FROM recs", recs=RECS)
def s7_audio_listing(recs):
    return _recordings(recs).select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("recording"), "skipped")


@query(f"SELECT recording, duration_s, {RATE} AS sample_rate FROM recs WHERE station <> 'ST03'", recs=RECS)
def s8_recording_catalog(recs):
    return audio.recording_catalog(_recordings(recs).where("NOT skipped")).where("error IS NULL").select("recording", "duration_s", "sample_rate")


_AMP = "(500 + 300 * (({0}) * 37 % 100)) / 32768.0::DOUBLE"
#: Windows of two seconds at every second; a recording's length is a whole number of seconds.
WINDOWS = f"""w AS (SELECT station, recording, CAST(s AS INT) AS win_no, CAST(s AS DOUBLE) AS start_s, {_AMP.format('s')} AS a, {_AMP.format('s + 1')} AS b, duration_s FROM (SELECT *, unnest(range(0, CAST(greatest(0, floor(duration_s - 2)) AS BIGINT) + 1)) AS s FROM recs)),
v AS (SELECT *, CASE WHEN start_s + 1 < duration_s THEN sqrt((a * a + b * b) / 2) ELSE sqrt(a * a / 2) END AS rms, CASE WHEN start_s + 1 < duration_s THEN greatest(a, b) ELSE a END AS peak FROM w)"""


@query(f"WITH {WINDOWS} SELECT recording, win_no, start_s, start_s + 2 AS end_s, CAST(floor(rms * 1e4 + 0.5) AS BIGINT) AS rms, CAST(floor(peak * 1e4 + 0.5) AS BIGINT) AS peak, CAST(floor(peak / rms * 1e3 + 0.5) AS BIGINT) AS crest, true AS complete FROM v", recs=RECS)
def x1_window_features(recs):
    f = audio.window_features(_recordings(recs))
    whole = F.forall(F.array(*audio.FEATURES), lambda x: x.isNotNull() & ~F.isnan(x))
    at = lambda c, k: F.floor(F.col(c) * k + 0.5).cast("bigint").alias(c)
    return f.select("recording", "win_no", "start_s", "end_s", at("rms", 1e4), at("peak", 1e4), at("crest", 1e3), whole.alias("complete"))


@query(f"WITH {WINDOWS} SELECT det_id, CAST(floor(peak * 1e4 + 0.5) AS BIGINT) AS peak FROM det LEFT JOIN v ON det.recording = v.recording AND det.start_s = v.start_s", recs=RECS, det=DET)
def x2_annotated_detections(recs, det):
    return audio.annotate(det, audio.window_features(_recordings(recs)), "peak").select("det_id", F.floor(F.col("peak") * 1e4 + 0.5).cast("bigint").alias("peak"))


def _loudness(x: np.ndarray, rate: int) -> np.ndarray:
    p = np.abs(x).max(axis=1)
    return np.stack([p, 1 - p], axis=1)


@query(f"WITH {WINDOWS} SELECT recording, start_s, CAST(floor(peak * 1e4 + 0.5) AS BIGINT) AS p FROM v", recs=RECS)
def x3_x4_scored_windows(recs):
    """Scores whose width is checked twice: by the job and, against the class table, by an expression."""
    s = audio.score_windows(_recordings(recs), _loudness, 2)
    return s.select("recording", "start_s", F.floor(scores.checked(F.col("probs"), 2)[0] * 1e4 + 0.5).cast("bigint").alias("p"))


@query(f"WITH {WINDOWS} SELECT recording, start_s, CASE WHEN peak > 0.5 AND peak >= 0.7 THEN 'flag' ELSE 'keep' END AS screen FROM v", recs=RECS)
def x5_background_screen(recs):
    s = audio.score_windows(_recordings(recs), _loudness, 2)
    s = s.withColumn("species", F.when(F.col("probs")[0] > F.col("probs")[1], "loud").otherwise("Background")).withColumn("confidence", F.array_max("probs"))
    return audio.background_screen(s, "loud", 0.7).select("recording", "start_s", "screen")


#: Clips from half a second before to half a second after; a sample of the recording's second s becomes its amplitude less one when it is scaled anew.
CLIPS = f"""c AS (SELECT det_id, greatest(0, start_s - 0.5)::DOUBLE AS clip_start_s, CAST(floor(greatest(0, start_s - 0.5) * {RATE}) AS BIGINT) AS a, CAST(floor(least(duration_s, end_s + 0.5) * {RATE}) AS BIGINT) AS b FROM det JOIN recs USING (recording)),
v AS (SELECT det_id, clip_start_s, a, b, unnest(range(a // {RATE}, greatest((b - 1) // {RATE}, a // {RATE}) + 1)) AS s FROM c)"""


@query(
    f"WITH {CLIPS} SELECT det_id, clip_start_s, 44 + 2 * greatest(b - a, 0) AS bytes, CAST(sum(greatest(least((s + 1) * {RATE}, b) - greatest(s * {RATE}, a), 0) * (499 + 300 * (s * 37 % 100))) AS BIGINT) AS samples FROM v GROUP BY det_id, clip_start_s, a, b",
    recs=RECS, det=DET,
)
def x6_cut_clips(recs, det):
    """Clips' lengths and the sum of their samples."""

    @F.udf("bigint")
    def total(clip: bytes) -> int:
        return int(np.frombuffer(clip[44:], "<i2").sum(dtype=np.int64))

    return audio.cut_clips(det, _recordings(recs)).select("det_id", "clip_start_s", F.length("clip").cast("bigint").alias("bytes"), total("clip").alias("samples"))


@query(
    f"SELECT recording, CAST(s AS BIGINT) AS frame, CAST(floor(pow((500 + 300 * (s * 37 % 100)) / 32768.0::DOUBLE, 2) * {RATE} * 1e6 + 0.5) AS BIGINT) AS energy FROM (SELECT recording, unnest(range(0, CAST(duration_s AS BIGINT))) AS s FROM recs)",
    recs=RECS,
)
def w17_frames_from_audio(recs):
    """Energy of each second of the recordings, read in ranges of fifty seconds."""
    f = audio.energy_frames(_recordings(recs), hop=RATE, n_fft=None, range_s=50.0)
    return f.select("recording", "frame", F.floor(F.col("energy") * 1e6 + 0.5).cast("bigint").alias("energy"))


@query(
    f"""WITH f AS (SELECT recording, s, pow((500 + 300 * (s * 37 % 100)) / 32768.0::DOUBLE, 2) AS energy FROM (SELECT recording, unnest(range(0, CAST(duration_s AS BIGINT))) AS s FROM recs)),
o AS (SELECT recording, s, s - row_number() OVER (PARTITION BY recording ORDER BY s) AS run FROM (SELECT *, max(energy) OVER (PARTITION BY recording) AS peak, count(*) OVER (PARTITION BY recording) AS n FROM f) WHERE energy / peak > 0.2 AND n >= 8),
r AS (SELECT recording, CAST(min(s) AS DOUBLE) AS a, CAST(max(s) + 1 AS DOUBLE) AS b FROM o GROUP BY recording, run HAVING count(*) >= 2)
SELECT recording, a AS start_s, least(b, a + 3) AS end_s FROM r""",
    recs=RECS,
)
def w18_pulses_from_audio(recs):
    """Pulses of at least two seconds, cut to three; runs are at least a second apart, so none are merged."""
    f = audio.energy_frames(_recordings(recs), hop=RATE, n_fft=None, range_s=50.0)
    return windows.pulses(f, share=0.2, min_s=2.0, merge_s=0.5, max_s=3.0)


@query(vec=VEC_SPARK)
def s14_statistics_store(vec):
    """Statistics are found under the fingerprint that they were stored with, and never for another model."""
    spark, path = vec.sparkSession, shared_path(vec.sparkSession, "statistics")
    vectors.write_statistics(spark, vectors.class_statistics(vec, "label", "v"), "model-a", path)
    rows = vec.select("vec_id", F.col("label").cast("string").alias("species"), F.when(F.col("vec_id") % 2 == 0, "model-a").otherwise("model-b").alias("fingerprint"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(f"{c}_size")
    return vectors.lookup_statistics(rows, spark.read.parquet(path)).select("vec_id", size("mean"), size("inverse"))


SQL["s14_statistics_store"] = "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 64 END AS mean_size, CASE WHEN vec_id % 2 = 0 THEN 4096 END AS inverse_size FROM embeddings"


@query(
    "WITH f AS (SELECT det_id, confidence, CASE WHEN flag_tag THEN 1 ELSE 0 END + CASE WHEN flag_isolated THEN 1 ELSE 0 END + CASE WHEN flag_mahal THEN 1 ELSE 0 END AS n_flags FROM sig) SELECT det_id, n_flags FROM f WHERE n_flags > 0 ORDER BY n_flags DESC, confidence NULLS FIRST, det_id LIMIT 100",
    sig=SIG,
)
def t4_most_suspect(sig):
    n = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("flag_isolated", "flag_mahal")), F.coalesce(F.col("flag_tag").cast("int"), F.lit(0)))
    return ranking.most_suspect(sig.withColumn("n_flags", n), 100).select("det_id", "n_flags")


@query("SELECT det_id, row_number() OVER (ORDER BY cleanup NULLS LAST, species DESC, confidence DESC, det_id) AS position FROM sig", sig=SIG)
def t6_sorted_rows(sig):
    order = [F.col("cleanup").asc_nulls_last(), F.col("species").desc(), F.col("confidence").desc(), F.col("det_id").asc()]
    return ranking.prefix_count(sig, order).select("det_id", "position")


@query("SELECT count(*) FILTER (doc_id IS NOT NULL) AS found, count(*) FILTER (doc_id IS NULL) AS missing, min(concat(CAST(det_id AS VARCHAR), '.wav')) FILTER (doc_id IS NULL) AS example FROM det LEFT JOIN (SELECT DISTINCT doc_id FROM man) m ON det_id = doc_id", man=MAN, det=DET)
def j10_missing_clips(man, det):
    review = det.withColumn("file", F.concat(F.col("det_id").cast("string"), F.lit(".wav")))
    return manifest.missing_reviewed(review, man.select("path"))


@query("SELECT det_id, station, recording, start_s, confidence FROM det", det=DET)
def p10_normalised(det):
    raw = det.select("det_id", F.col("station").alias("site"), F.col("recording").alias("source_file"), F.col("start_s").cast("string").alias("start_time"), "species", F.col("confidence").alias("conf"))
    return normalise_detections(raw).select("det_id", "station", "recording", "start_s", "confidence")


@query("SELECT unnest(['confidence', 'n_neighbours', 'mahalanobis_d2']) AS name FROM (SELECT count(*) AS n FROM sig) WHERE n > 1", sig=SIG)
def l20_available_candidates(sig):
    names = search.available_candidates(sig.withColumn("constant", F.lit(1.0)), ["confidence", "n_neighbours", "species", "constant", "absent", "mahalanobis_d2"])
    return sig.sparkSession.createDataFrame([(n,) for n in names], "name string")


@query("SELECT path, min(label) AS label, count(*) AS n FROM (SELECT path, label FROM man UNION ALL SELECT path, label FROM man WHERE doc_id % 5 = 0) GROUP BY path", man=MAN)
def u1_unequal_columns(man):
    """A union of parts with different columns, as the manifest makes it."""
    more = man.where("doc_id % 5 = 0").select("path", "label", F.lit("extra").alias("note"))
    return man.select("path", "label", "source").unionByName(more, allowMissingColumns=True).groupBy("path").agg(F.min("label").alias("label"), F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT * FROM sig WHERE station <> 'ST03') SELECT species, count(*) FILTER (cleanup IS NOT NULL) AS matched, count(*) FILTER (cleanup IS NULL) AS unmatched, count(*) FILTER (cleanup = 'suspicious' AND flag_tag) AS tagged FROM r GROUP BY species",
    sig=SIG,
)
def s16_report_tables(sig):
    """Reports written as tables and read back."""
    path = shared_path(sig.sparkSession, "report")
    rows = sig.transform(gates.exclude_stations(["ST03"]))
    by = rows.groupBy("species").agg(F.count("cleanup").alias("matched"), F.count_if(F.col("cleanup").isNull()).alias("unmatched"), F.count_if((F.col("cleanup") == "suspicious") & F.col("flag_tag")).alias("tagged"))
    sinks.write_report({"species": by}, path)
    return sig.sparkSession.read.parquet(f"{path}/species")
