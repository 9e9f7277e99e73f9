"""Readers, writers, audio jobs, manifests and streams on small files."""

import math
import random
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chorusframe.operators import audio, gates, matching, windows
from chorusframe.plans import jobs, manifest
from chorusframe.sources import readers, sinks
from chorusframe.streaming import events


def write_wav(path, seconds, hz, rate=8000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(20000 * math.sin(2 * math.pi * hz * i / rate))) for i in range(int(seconds * rate))))


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    write_wav(root / "s1" / "low.wav", 5.5, 300)
    write_wav(root / "s1" / "high.wav", 3.0, 3000)
    write_wav(root / "old" / "skip.wav", 1.0, 300)
    (root / "s1" / "broken.wav").write_bytes(b"nothing")
    return root


def test_catalog_reports_unreadable_files(spark, recordings):
    files = readers.audio_files(spark, f"file://{recordings}", [f"{recordings}/old"])
    assert files.where("skipped").count() == 1
    got = {r["recording"]: r for r in audio.recording_catalog(files.where("NOT skipped")).collect()}
    assert got["low"]["duration_s"] == 5.5 and got["high"]["sample_rate"] == 8000 and got["broken"]["error"]


def test_window_features_tell_low_from_high(spark, recordings):
    files = readers.audio_files(spark, f"file://{recordings}/s1")
    got = audio.window_features(files)
    assert [r["start_s"] for r in got.where("recording = 'low'").orderBy("win_no").collect()] == [0.0, 1.0, 2.0, 3.0, 3.5]
    ratio = {r["recording"]: r["r"] for r in got.groupBy("recording").agg(F.avg("low_freq_ratio").alias("r")).collect()}
    assert ratio["low"] > 0.95 and ratio["high"] < 0.05


def test_scores_keep_their_width(spark, recordings):
    files = readers.audio_files(spark, f"file://{recordings}/s1")
    got = audio.score_windows(files, lambda x, rate: np.tile([0.2, 0.8], (len(x), 1)), 2)
    assert got.count() == 7 and got.first()["probs"] == [0.2, 0.8]
    with pytest.raises(Exception, match="expected 3 scores"):
        audio.score_windows(files, lambda x, rate: np.ones((len(x), 2)), 3).count()


def test_clips_hold_the_padded_window(spark, recordings):
    det = spark.createDataFrame([(1, "low", 0.2, 2.2), (2, "low", 2.0, 4.0), (3, "gone", 0.0, 2.0)], "det_id bigint, recording string, start_s double, end_s double")
    got = {r["det_id"]: r for r in audio.cut_clips(det, readers.audio_files(spark, f"file://{recordings}/s1")).collect()}
    assert set(got) == {1, 2} and got[1]["clip_start_s"] == 0.0 and got[2]["clip_start_s"] == 1.5
    assert len(audio.decode(bytes(got[2]["clip"]))[0]) == 3 * 8000


def plain_features(x, rate):
    """All fourteen features with explicit sums instead of transforms."""
    n = len(x)

    def power(y):
        k = np.arange(len(y) // 2 + 1)
        return np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(len(y))) / len(y)) @ y) ** 2

    hann = lambda m: 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / (m - 1))
    p, hz = power(x * hann(n)) + 1e-20, np.arange(n // 2 + 1) * rate / n
    frame = int(0.02 * rate)
    env = np.array([math.sqrt(sum(v * v for v in x[i : i + frame]) / frame) for i in range(0, n // frame * frame, frame)])
    rms, peak = math.sqrt(sum(v * v for v in x) / n), max(abs(v) for v in x)
    beat = power(env - env.mean())
    beat_hz = np.arange(len(env) // 2 + 1) / (0.02 * len(env))
    slow = [i for i, f in enumerate(beat_hz) if 1 < f < 20]
    best = max(slow, key=lambda i: beat[i])
    band = [i for i, f in enumerate(hz) if 400 <= f <= 1200]
    inside, whole = sum(p[i] for i in band), sum(p)
    frames = [power(x[i : i + 256] * hann(256)) for i in range(0, n - 255, 128)]
    rows = [i for i in range(129) if 400 <= i * rate / 256 <= 1200]
    energy = np.array([f[rows].sum() for f in frames])
    tops = np.array([rows[int(np.argmax(f[rows]))] * rate / 256 for f, e in zip(frames, energy, strict=True) if e >= np.median(energy)])
    return {
        "rms": rms, "peak": peak, "low_freq_ratio": sum(p[i] for i in range(len(p)) if hz[i] <= 1500) / whole, "band_fraction": inside / whole, "centroid_hz": sum(hz * p) / whole,
        "flatness": math.exp(sum(math.log(v) for v in p) / len(p)) / (whole / len(p)), "crest": peak / rms, "env_cv": np.std(env) / np.mean(env), "onset_rate": sum(b - a > 0.5 * env.mean() for a, b in zip(env, env[1:], strict=False)) / (n / rate),
        "pulse_share": beat[best] / sum(beat[i] for i in slow), "pulse_hz": beat_hz[best], "band_log_ratio": math.log10((inside + 1e-20) / (whole - inside + 1e-20)), "fm_spread_hz": tops.std(), "low_mod_cv": energy.std() / energy.mean(),
    }


@pytest.fixture(scope="module")
def sweeps(tmp_path_factory):
    """A pulsed sweep with some noise, mono of 16 bits and stereo of 32, and two short files."""
    root, rate = tmp_path_factory.mktemp("sweeps"), 4000
    t = np.arange(int(9.3 * rate)) / rate
    x = np.sin(2 * np.pi * (300 + 90 * t) * t) * (0.3 + 0.6 * (np.sin(2 * np.pi * 0.7 * t) > 0.2)) * 0.8 + np.random.default_rng(1).normal(0, 0.01, len(t))
    for name, y, width in (("mono", x, 2), ("stereo", np.stack([x, x[::-1]], 1), 4), ("short", x[:2500], 2), ("empty", x[:0], 2)):
        with wave.open(str(root / f"{name}.wav"), "wb") as w:
            w.setnchannels(y.ndim)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes((np.clip(y, -1, 1) * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes())
    (root / "broken.wav").write_bytes(b"RIFFxx")
    return root


def test_features_over_ranges_equal_a_plain_version(spark, sweeps):
    files = readers.audio_files(spark, f"file://{sweeps}")
    got = {(r["recording"], r["win_no"]): r for r in audio.window_features(files, range_s=2.5).collect()}
    expected = 0
    for name in ("mono", "stereo", "short"):
        x, rate = audio.decode((sweeps / f"{name}.wav").read_bytes())
        for i, s in enumerate(audio.window_starts(len(x) / rate, 2.0, 1.0)):
            part = x[int(s * rate) : int(s * rate) + 2 * rate].astype(float)
            want = plain_features(np.pad(part, (0, 2 * rate - len(part))), rate)
            assert got[name, i]["start_s"] == s and set(want) == set(audio.FEATURES)
            for c, v in want.items():
                assert got[name, i][c] == pytest.approx(v, rel=2e-3, abs=1e-6), (name, i, c)
            expected += 1
    assert len([k for k in got if k[0] != "empty"]) == expected


def test_scores_do_not_depend_on_ranges(spark, sweeps):
    files = readers.audio_files(spark, f"file://{sweeps}")
    score = lambda x, rate: np.stack([np.abs(x).max(axis=1), x.sum(axis=1)], axis=1)
    by = [sorted((r["recording"], r["win_no"], r["start_s"], *r["probs"]) for r in audio.score_windows(files, score, 2, batch=b, range_s=s).collect()) for b, s in ((256, 1e6), (1, 1.0), (2, 3.3))]
    assert by[0] == by[1] == by[2] and len(by[0]) > 18


def plain_pulses(x, rate, hop=64, n_fft=512, low=100, high=1500, share=0.05, least=0.15, gap=0.10, most=1.6):
    """The envelope of a padded whole recording, and its pulses one run after the other."""
    y = np.pad(x.astype(float), n_fft // 2)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    hz = np.arange(n_fft // 2 + 1) * rate / n_fft
    env = np.array([(np.abs(np.fft.rfft(y[i : i + n_fft] * hann)) ** 2)[(hz >= low) & (hz < high)].sum() for i in range(0, len(x) + 1, hop)])
    loud, fps, found = env / env.max() > share, rate / hop, []
    edges = np.flatnonzero(np.diff(np.r_[False, loud, False].astype(int)))
    for a, b in zip(edges[::2] / fps, edges[1::2] / fps, strict=True):
        if b - a >= least:
            if found and a - found[-1][1] < gap:
                found[-1][1] = b
            else:
                found.append([a, min(b, a + most)])
    return env, found


def test_frames_and_pulses_of_recordings(spark, tmp_path):
    rate, rng = 4000, np.random.default_rng(5)
    for k in range(6):
        x = rng.normal(0, 0.001, int(rate * (7 + k)))
        at = 0
        while at < len(x) - rate // 10:  # tones of many lengths, gaps around the limits
            n = int(rate * rng.choice([0.08, 0.2, 0.3, 1.0, 2.2]))
            x[at : at + n] += 0.5 * np.sin(2 * np.pi * 600 * np.arange(len(x[at : at + n])) / rate)
            at += n + int(rate * rng.choice([0.12, 0.16, 0.2, 0.5]))
        with wave.open(str(tmp_path / f"r{k}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    frames = audio.energy_frames(readers.audio_files(spark, f"file://{tmp_path}"), hop=64, n_fft=512, range_s=1.7)
    got, merged = frames.collect(), 0
    pulses = windows.pulses(frames).collect()
    for k in range(6):
        x, _ = audio.decode((tmp_path / f"r{k}.wav").read_bytes())
        env, found = plain_pulses(x, rate)
        mine = sorted((r["frame"], r["energy"]) for r in got if r["recording"] == f"r{k}")
        assert [f for f, _ in mine] == list(range(len(env))) and np.allclose([e for _, e in mine], env, rtol=1e-6, atol=1e-9)
        assert sorted((r["start_s"], r["end_s"]) for r in pulses if r["recording"] == f"r{k}") == [tuple(p) for p in found]
        merged += sum(b - a > 1.6 for a, b in found)
    assert merged and len(pulses) > 20


def test_clips_equal_slices_and_contents_are_never_shuffled(spark, sweeps):
    rows = [(i, ("mono", "stereo", "short", "broken", "gone")[i % 5], 0.37 * i, 0.37 * i + 1.1) for i in range(30)]
    det = spark.createDataFrame(rows, "det_id bigint, recording string, start_s double, end_s double")
    files = readers.audio_files(spark, f"file://{sweeps}")
    clips = audio.cut_clips(det, files)
    got = {r["det_id"]: r for r in clips.collect()}
    assert set(got) == {i for i, name, *_ in rows if name in ("mono", "stereo", "short")}
    for i, name, a, b in rows:
        if i in got:
            x, rate = audio.decode((sweeps / f"{name}.wav").read_bytes())
            a = max(0.0, a - 0.5)
            want = (np.clip(x[int(a * rate) : int(min(len(x) / rate, b + 0.5) * rate)], -1, 1) * 32767).astype("<i2")
            with wave.open(__import__("io").BytesIO(bytes(got[i]["clip"]))) as w:
                assert w.getframerate() == rate and w.readframes(w.getnframes()) == want.tobytes()
            assert got[i]["clip_start_s"] == a
    for df in (clips, audio.window_features(files), audio.energy_frames(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan and "ReadSchema: struct<path:string>" in plan


def test_missing_audio_is_counted_or_refused(spark):
    det = spark.createDataFrame([(1, "a"), (2, "b")], "det_id int, recording string")
    recs = spark.createDataFrame([("a", "/x/a.wav")], "recording string, path string")
    got = matching.require_some(matching.attach_audio(det, recs), "path")
    assert got.where("path IS NULL").count() == 1
    with pytest.raises(ValueError, match="all 2 rows"):
        matching.require_some(matching.attach_audio(det, recs.where("recording = 'z'")), "path")


def test_detection_files(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    head = "start_time,end_time,species,confidence,low_freq_ratio\n"
    (tmp_path / "s1" / "S20210224T175957188+0100_x_detections.csv").write_text(head + "1.0,3.0,a,0.9,0.5\n4.0,6.0,b,0.8,\n")
    (tmp_path / "s1" / "noname_detections.csv").write_text(head + "1.0,3.0,a,0.7,\n")
    (tmp_path / "s1" / "empty_detections.csv").write_text(head)
    got = readers.read_detections_wallclock(spark, str(tmp_path), ["a"])
    rows = {r["recording"]: r for r in got.collect()}
    assert set(rows) == {"S20210224T175957188+0100_x", "noname"} and {r["station"] for r in rows.values()} == {"s1"}
    assert str(rows["S20210224T175957188+0100_x"]["detected_at"]) == "2021-02-24 17:59:58" and rows["noname"]["detected_at"] is None
    assert readers.unparsed(got).first()["unparsed_rows"] == 1


def test_review_headers_vary(spark, tmp_path):
    (tmp_path / "one.csv").write_text("INDIR,IN FILE,MANUAL ID\n/d/Sp/S1,Sp__r__00012s__conf0.8.wav,\n/d/Sp/S1,Sp__r__00013s__conf0.8.wav,Noise\n")
    (tmp_path / "two.csv").write_text("in file,Manual ID*,INDIR,other\nSp__r__00014s__conf0.8.wav,pyow,/d/Sp/S2,x\n")
    (tmp_path / "cleanup_vs_review.csv").write_text("a,b\n1,2\n")
    got = {r["start_s"]: r for r in readers.read_reviews(spark, str(tmp_path)).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {12: "call", 13: "false_positive", 14: "call"}
    assert got[14]["station"] == "S2" and got[12]["species"] == "Sp"
    assert readers.read_reviews(spark, str(tmp_path), blank_is_confirmed=False).where("verdict = 'unreviewed'").count() == 1


def test_written_cleanup_and_incremental_append(spark, tmp_path, det):
    flagged = det([0, 100, 200]).withColumn("flag_isolated", F.col("det_id") == 1).transform(gates.merge_flags())
    sinks.write_cleanup(flagged, f"file://{tmp_path}/c")
    assert spark.read.parquet(f"file://{tmp_path}/c").groupBy("cleanup").count().count() == 2
    rows = det([0, 1, 2]).select("det_id", "start_s")
    sinks.append_new(rows.where("det_id < 2"), f"file://{tmp_path}/a", ["det_id"])
    sinks.append_new(rows, f"file://{tmp_path}/a", ["det_id"])
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 3


def test_manifest_prefers_reviewed_copies(spark):
    cols = "path string, label string, station string, source string, verified boolean, species string, recording string, start_s double, content_hash string"
    part = spark.createDataFrame([("p1", "x", "s", "auto", False, "x", "r", 1.0, "h1"), ("p1", "x", "s", "human", True, "x", "r", 1.0, "h1"), ("p2", "Background", "s", "auto", False, "x", "r", 2.0, "h2"), ("p3", "x", "s", "auto", False, "x", "r", 3.0, "h3"), ("p4", "y", "s", "human", True, "y", "q", 9.0, "h3")], cols)
    review = spark.createDataFrame([("r", 3.0, "call")], "recording string, start_s double, verdict string")
    scores = spark.createDataFrame([("p2", 0.99)], "path string, target_score double")
    got = {r["path"]: r for r in manifest.build_manifest([part], review, scores, 1, machine=["auto"]).collect()}
    assert "p2" not in got and got["p1"]["source"] == "human"
    assert len({"p3", "p4"} & set(got)) == 1  # one content, two labels


def test_excluding_a_station_changes_every_report(spark, det):
    rng = random.Random(0)
    rows = [(10 * i, "call" if rng.random() < 0.5 else "false_positive", f"s{i % 2}") for i in range(40)]
    review = det(rows).withColumnRenamed("det_id", "review_id")
    cleaned = det(rows).drop("verdict", "station", "confidence").withColumn("cleanup", F.lit("clean")).withColumn("flag_isolated", F.col("det_id") % 3 == 0)
    whole = jobs.evaluate_cleanup(review, cleaned, ("flag_isolated",))
    part = jobs.evaluate_cleanup(review, cleaned, ("flag_isolated",), exclude=["s1"])
    assert whole["evaluation"].where("species = 'ALL'").first()["matched"] == 40
    assert part["evaluation"].where("species = 'ALL'").first()["matched"] == 20
    # Confidence is the same in all rows, so every cutoff removes all calls and none is allowed.
    assert {name for name, df in part.items() if df.count() == 0} == {"operating_points", "held_out_confidence"}
    # n_flags is worked out from the flags
    votes = {r["at_least"]: r["left"] for r in whole["votes"].collect()}
    assert votes == {0: 40, 1: 40 - whole["disagreements"].where("flag_isolated").count()} and votes[1] < 40
    some = jobs.evaluate_cleanup(review, cleaned, ("flag_isolated",), only=["votes", "sweep_confidence"])
    assert set(some) == {"votes", "sweep_confidence"}


def test_every_report_of_a_whole_table(spark):
    names = "det_id bigint, station string, recording string, species string, start_s double, confidence double, verdict string, n_neighbours bigint, mahalanobis_d2 double, softmax_margin double, knn_dist double, tag_top string, tag_score double, flag_tag boolean, flag_isolated boolean, flag_invading_cluster boolean, cleanup string"
    rng = random.Random(1)
    rows = [(i, f"s{i % 3}", f"r{i % 6}", "a", 20.0 * (i // 6), rng.random(), rng.choice(["call", "false_positive"]), rng.randrange(4), rng.random() * 9, rng.random(), rng.random(), rng.choice("xy"), rng.random(), rng.random() < 0.4, rng.random() < 0.4, i % 3 == 1, rng.choice(["clean", "suspicious"])) for i in range(90)]
    table = spark.createDataFrame(rows, names)
    review = table.select(F.col("det_id").alias("review_id"), "station", "recording", "species", "start_s", "confidence", "verdict")
    got = jobs.evaluate_cleanup(review, table.drop("station", "confidence", "verdict"), ("flag_tag", "flag_isolated"))
    want = {"stations", "disagreements", "effort_curve", "effort_by_station", "ranking_signals", "operating_points", "against_confidence", "triage", "two_protocol_cv", "gated_recurrence_cv", "tag_classes", "tag_scores", "thresholds", "votes"}
    assert want | {f"sweep_{c}" for c in jobs.SWEPT} | {f"held_out_{c}" for c in jobs.HELD_OUT} <= set(got)
    for df in got.values():
        df.collect()
    kinds = {r["disagreement"]: r["n"] for r in got["disagreements"].groupBy("disagreement").agg(F.count("*").alias("n")).collect()}
    assert sum(kinds.values()) == 90
    found = {r["tag_top"]: (r["n"], r["calls"]) for r in got["tag_classes"].collect()}
    assert found == {t: (sum(r[11] == t for r in rows), sum(r[11] == t and r[6] == "call" for r in rows)) for t in "xy"}
    base = got["against_confidence"].first()
    assert base["removed"] == sum(r[16] == "suspicious" for r in rows)
    at = {round(r["cut"], 2): (r["calls_kept"], r["fps_removed"]) for r in got["tag_scores"].collect()}
    gone = [r[14] or (r[13] and r[12] >= 0.5) for r in rows]
    assert at[0.5] == (sum(r[6] == "call" and not g for r, g in zip(rows, gone, strict=True)), sum(r[6] != "call" and g for r, g in zip(rows, gone, strict=True)))


def test_stream_events_match_batch_sessions(spark, tmp_path):
    rows = [(f"2021-02-24 00:00:{s:02d}",) for s in (0, 1, 2, 4, 10, 11, 30)]
    df = spark.createDataFrame(rows, "t string").select(F.lit("s").alias("station"), F.lit("r").alias("recording"), F.lit("a").alias("species"), F.lit(0.5).alias("confidence"), F.col("t").cast("timestamp_ntz").alias("detected_at"))
    df.write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([("2021-02-25 00:00:00",)], "t string").select(F.lit("s").alias("station"), F.lit("r").alias("recording"), F.lit("z").alias("species"), F.lit(0.5).alias("confidence"), F.col("t").cast("timestamp_ntz").alias("detected_at"))
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.stream_events(stream).writeStream.outputMode("append").format("memory").queryName("call_events").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    late.write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    assert sorted(r["windows"] for r in spark.table("call_events").where("species = 'a'").collect()) == [1, 2, 4]


def _batches(rows):
    yield pa.RecordBatch.from_pylist([{"file": f, "content": c} for f, c in rows], schema=pa.schema([("file", pa.string()), ("content", pa.binary())]))


def test_only_committed_attempts_are_seen(tmp_path):
    root = tmp_path / "out"
    writer = sinks.named_files()({"root": f"file://{root}", "header": "h"}).writer(None, False)
    rows = [("a/x.csv", b"1\n"), ("a/x.csv", b"2\n"), ("b/y.csv", None)]
    first, second = writer.write(_batches(rows)), writer.write(_batches(rows))  # two attempts of one partition

    def broken():
        yield from _batches([("a/x.csv", b"half")])
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(broken())
    seen = lambda: sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and "_staged" not in str(p))
    assert first.folder != second.folder and seen() == []
    writer.commit([second])
    assert seen() == ["_SUCCESS", "a/x.csv", "b/y.csv"] and not list(root.glob("_staged*"))
    assert (root / "a/x.csv").read_text() == "h\n1\n2\n" and (root / "b/y.csv").read_text() == "h\n" and (root / "_SUCCESS").read_text() == "2"
    again = sinks.named_files()({"root": f"file://{root}"}).writer(None, False)
    again.abort([again.write(_batches([("c.csv", b"x")]))])
    assert "c.csv" not in seen() and not list(root.glob("_staged*"))


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    fail = F.udf(lambda i: b"x" if i < 900 else 1 // 0, "binary")
    rows = spark.range(1000, numPartitions=4).select(F.concat(F.lit("f"), F.floor(F.col("id") / 10).cast("string")).alias("file"), fail("id").alias("content"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        sinks.save_named(rows, f"file://{tmp_path}/o")
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    assert sinks.save_named(rows.where("id < 900"), f"file://{tmp_path}/o") == 90
    assert len(list((tmp_path / "o").glob("f*"))) == 90


def test_headers_are_read_without_contents_and_layouts_meet_rows_by_path(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "one.csv").write_bytes(b"\xef\xbb\xbfX,\"the, other\",Y\r\n1,z,2\r\n3,z\r\n")
    (tmp_path / "two.csv").write_text("\n\n y ,x*\n5,6\n" + "7,8\n" * 20_000)
    (tmp_path / "three%20.csv").write_text("x")
    (tmp_path / "four.csv").write_text("other\n9\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n")
    (tmp_path / "long.csv").write_text(",".join(f"n{i}" for i in range(9000)) + ",x\n" + "," * 9000 + "11\n")
    got = readers.read_layouts(spark, [str(tmp_path)], "*.csv", "x int, y int", "long").groupBy("x", "y").count().collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 2, 1), (3, None, 1), (6, 5, 1), (8, 7, 20_000), (None, None, 1)]
    assert [tuple(r)[:2] for r in readers.read_layouts(spark, [str(tmp_path / "long.csv")], "*.csv", "x int, y int").collect()] == [(11, None)]
    assert readers.read_layouts(spark, [str(tmp_path)], "*.tsv", "x int").collect() == []

    def plan(df):
        return df._jdf.queryExecution().toString()

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(str(tmp_path)).select("path", F.col("_metadata.file_path").alias("_path"))
    assert "content" not in plan(readers.header_layouts(listed, ["x"])).split("Physical Plan")[1]
    one = readers.read_layouts(spark, [str(tmp_path / "two.csv")], "*.csv", "x int")
    assert "Join" not in plan(one) and "BroadcastHashJoin" in plan(readers.read_layouts(spark, [str(tmp_path)], "*.csv", "x int", "long"))


def test_layouts_of_many_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    monkeypatch.setattr(readers, "MOST_SENT", 1)
    got = readers.read_layouts(spark, [str(tmp_path)], "*.csv", "x int, y int")
    assert {(r["x"], r["y"]) for r in got.collect()} == {(1, 2), (2, 1)}


def test_a_file_without_line_ends_is_no_csv(tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * (readers.LONGEST_HEADER + readers.HEADER_PIECE))
    with pytest.raises(ValueError, match="no header line"):
        readers._first_line(f"file:{tmp_path}/a.csv")
