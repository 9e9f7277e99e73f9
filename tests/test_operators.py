import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chorusframe import queries, queries_jobs  # noqa: F401
from chorusframe.functions import parse
from chorusframe.operators import gates, matching, metrics, neighbours, prefix, quality, ranking, regime, sampling, search, vectors, windows
from chorusframe.schema import normalise_detections
from chorusframe.views import DET, view


def column(df, name, order="det_id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_normalise_renames_and_turns_nan_into_null(spark):
    df = spark.createDataFrame([("s", "f", "a", 1.0, float("nan"))], "site string, source_file string, species string, start_time double, conf double")
    row = normalise_detections(df).first()
    assert (row["station"], row["recording"], row["start_s"], row["confidence"]) == ("s", "f", 1.0, None)
    with pytest.raises(ValueError, match="species"):
        normalise_detections(df.drop("species"))


def test_percentile_rank_ties_and_missing(spark):
    df = spark.createDataFrame([(i, "s", v) for i, v in enumerate([1.0, 2.0, 2.0, None, None, 5.0])], "det_id int, station string, v double")
    got = column(ranking.percentile_rank(df, "v", "p"), "p")
    assert got == pytest.approx([1 / 6, 2.5 / 6, 2.5 / 6, 5.5 / 6, 5.5 / 6, 4 / 6])
    worst = column(ranking.percentile_rank(df, "v", "p", nulls="bottom"), "p")
    assert worst[3] == pytest.approx(1.5 / 6)


def test_neighbours_include_both_ends_and_same_second(det):
    assert column(det([0, 30, 30, 61]).transform(neighbours.count_neighbours()), "n_neighbours") == [2, 2, 2, 0]


def test_prefix_count_numbers_all_rows(spark):
    df = spark.range(1000).withColumn("s", F.pmod(F.col("id") * 7919, F.lit(1000)))
    got = ranking.prefix_count(df, [F.col("s").desc(), F.col("id").asc()]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 1001)) and [r["s"] for r in got] == sorted((r["s"] for r in got), reverse=True)


def test_review_matches_within_a_second_by_preference(det):
    review = det([(10, "call"), (20, "call"), (40, "call")]).withColumnRenamed("det_id", "review_id")
    found = det([11, 9, 20, 43]).withColumn("cleanup", F.lit("clean"))
    got = column(matching.match_review(review, found), "det_id", "review_id")
    assert got == [1, 2, None]  # one second earlier wins over one later


def test_review_does_not_cross_species(det):
    review = det([(10, "call")]).withColumnRenamed("det_id", "review_id")
    assert column(matching.match_review(review, det([10], species="b").withColumn("cleanup", F.lit("clean"))), "det_id", "review_id") == [None]


def test_touching_windows_are_not_detected(det):
    calls = det([10]).withColumn("call_id", F.col("det_id"))
    assert matching.overlapping(calls, det([12])).count() == 0
    assert matching.overlapping(calls, det([11.5])).count() == 1


def test_recall_of_a_call_without_end(det):
    calls = det([10]).withColumn("call_id", F.col("det_id")).withColumn("end_s", F.lit(None).cast("double"))
    rows = {r["station"]: r for r in matching.recall(calls, det([11])).collect()}
    assert rows["ALL"]["detected"] == 1 and rows["s1"]["recall"] == 1.0


def test_settled_reviews_drop_conflicts(spark):
    rows = spark.createDataFrame([("a", "call"), ("a", "false_positive"), ("a", "call"), ("b", "call")], "recording string, verdict string")
    assert {r["recording"]: r["verdict"] for r in matching.settled_reviews(rows, ("recording",)).collect()} == {"a": None, "b": "call"}


def test_array_wide_slots(spark):
    rows = [(i, f"s{i}", "a", "2021-02-24 12:01:00") for i in range(4)] + [(9, "s1", "a", "2021-02-24 15:00:00")]
    df = spark.createDataFrame(rows, "det_id int, station string, species string, t string").withColumn("detected_at", F.col("t").cast("timestamp_ntz"))
    assert column(gates.array_wide(df), "keep") == [False] * 4 + [True]
    assert column(gates.array_wide(df, chorus=((12, 13),)), "keep") == [True] * 5


def test_hot_negatives_spare_human_labels(spark):
    rows = [("p0", "Background", "auto", False), ("p1", "Background", "auto", False), ("p2", "Background", "auto", True), ("p3", "Background", "review", False), ("p4", "Background", "auto", None), ("p5", "call", "auto", False)]
    m = spark.createDataFrame(rows, "path string, label string, source string, verified boolean")
    s = m.select("path", F.lit(0.9).alias("target_score"))
    got = gates.drop_hot_negatives(m, s, 0.5, ["auto"])
    assert column(got, "dropped", "path") == [True, True, False, False, False, False]
    assert column(got, "spared", "path") == [False, False, True, True, True, False]


def test_missing_measurements_pass_gates(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", 0.1), (2, "b", 0.1)], "det_id int, species string, low_freq_ratio double")
    assert column(df.transform(gates.low_frequency_gate("a", 0.5)), "det_id") == [0, 2]


def test_regime_finds_a_planted_cluster(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "bad", 0.1 + 0.01 * float(rng.random()), 90.0) for i in range(20)] + [(20 + i, "bad", 5 + float(rng.random()), 10.0) for i in range(20)]
    rows += [(40 + i, "ok", 1 + 0.02 * i, 20.0) for i in range(30)] + [(80 + i, "few", 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "det_id int, station string, knn_dist double, mahalanobis_d2 double")
    got = {r["station"]: r["verdict"] for r in regime.station_regimes(df).collect()}
    assert got == {"bad": "invaded", "ok": "no gap", "few": "too few detections"}
    assert regime.flag_invading_cluster(df).where("flag_invading_cluster").count() == 20


def _greedy(rows, iou):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[3])):
        if all(max(0, min(r[1], k[1]) - max(r[0], k[0])) / ((r[1] - r[0]) + (k[1] - k[0]) - max(0, min(r[1], k[1]) - max(r[0], k[0]))) < iou for k in kept):
            kept.append(r)
    return sorted(r[3] for r in kept)


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), float(s) + 2, float(rng.random()), i) for i, s in enumerate(rng.integers(0, 400, 200) / 4)]
    df = spark.createDataFrame([("r", "a", *r) for r in rows], "recording string, species string, start_s double, end_s double, confidence double, det_id int")
    assert column(windows.suppress_overlaps(df, 0.5), "det_id") == _greedy(rows, 0.5)


@pytest.mark.parametrize(("iou", "task_rows"), [(0.3, 50_000), (0.5, 40), (1.0, 40)])
def test_suppression_of_the_whole_table_matches_brute_force(spark, monkeypatch, iou, task_rows):
    monkeypatch.setattr(windows, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(2)
    det = view(spark, "/root/testdata/sf0.001", DET).select("det_id", "recording", "species", "start_s", "confidence")
    rows = [(r["recording"], r["species"], r["start_s"] / 8, r["start_s"] / 8 + float(rng.choice([0.0, 1.5, 2.0, 5.0])), r["confidence"] if r["det_id"] % 11 else None, r["det_id"]) for r in det.collect()]
    df = spark.createDataFrame(rows, "recording string, species string, start_s double, end_s double, confidence double, det_id bigint").repartition(5)
    groups = collections.defaultdict(list)
    for rec, species, a, b, c, i in rows:
        groups[rec, species].append((a, b, -1.0 if c is None else c, i))
    want = []
    for g in groups.values():
        want += [r[3] for r in g if r[0] == r[1]] + _greedy([r for r in g if r[0] < r[1]], iou)
    got = windows.suppress_overlaps(df, iou)
    assert got.columns == df.columns and column(got, "det_id") == sorted(want)
    assert iou == 1 or len(want) < len(rows)


def test_running_sums_match_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else f"s{i % 3 * (i % 2)}", float(rng.integers(0, 40)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "station string, v double, det_id bigint").repartition(7)
    got = {r["det_id"]: (r["pos"], r["cum"]) for r in prefix.running(df, ["station"], [F.col("v").desc(), F.col("det_id").asc()], {"pos": F.lit(1), "cum": F.col("v")}).collect()}
    for s in {r[0] for r in rows}:
        cum = 0.0
        for pos, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-r[1], r[2])), 1):
            cum += v
            assert got[i] == (pos, cum)
    assert prefix.running(df.where("det_id < 0"), [], [F.col("v").asc()], {"pos": F.lit(1)}).count() == 0


def test_thresholds_elsewhere_and_baselines(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 4}", "call" if rng.random() < 0.5 else "false_positive", float(rng.integers(0, 30)) / 30, i) for i in range(300)]
    df = spark.createDataFrame(rows, "station string, verdict string, score double, det_id bigint").repartition(6)
    got = {r["station"]: r["loso"] for r in search._threshold_elsewhere(df, 0.9).collect()}
    for s in ("s0", "s1", "s2", "s3"):
        v = sorted(r[2] for r in rows if r[0] != s and r[1] == "call")
        assert got[s] == v[int((1 - 0.9) * len(v))]
    df = df.withColumnRenamed("score", "confidence")
    base = search.confidence_baseline(df, F.col("det_id") % 3 == 0).first()
    left = sorted(rows, key=lambda r: (r[2], r[3]))[100:]
    assert base["removed"] == 100 and base["baseline_precision"] == pytest.approx(sum(r[1] == "call" for r in left) / len(left))
    assert search.suggest_threshold(df, 0.25).first()["threshold"] == sorted((r[2] for r in rows), reverse=True)[74]


def test_rank_operators_gather_no_station(spark, det):
    """No window over a whole station or over all values: every window is within a range partition or over sums of partitions."""
    df = det([(float(i), "call" if i % 3 else "false_positive", f"s{i % 2}", i / 50) for i in range(50)])
    ranked = ranking.percentile_rank(df, "confidence", "p")
    for out in (ranked, metrics.auc(df, "confidence", F.col("verdict") == "call"), search.recall_threshold(df, "confidence", 0.9), search.best_balanced(df, "confidence", F.col("verdict") == "call"), ranking.effort_by_station(df, score="confidence")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_p#" in line.split("windowspecdefinition(")[1], line


def test_windows_are_anchored_at_the_end(spark):
    df = spark.createDataFrame([("a", 4.5), ("b", 2.0), ("c", 0.5)], "recording string, duration_s double")
    got = windows.sliding_windows(df)
    assert column(got.where("recording = 'a'"), "start_s", "win_no") == [0.0, 1.0, 2.0, 2.5]
    assert got.where("recording <> 'a'").count() == 2


def test_augment_reaches_the_target(spark):
    df = spark.createDataFrame([(f"p{i}", "x") for i in range(3)] + [(f"b{i}", "Background") for i in range(5)], "path string, label string")
    n = {r["label"]: r["count"] for r in windows.augment_to(df, 7).groupBy("label").count().collect()}
    assert n == {"x": 7, "Background": 5}


def test_loso_rejects_a_signal_that_only_works_in_sample(spark):
    rows = []
    for s in range(4):
        for i in range(40):
            call = i % 2 == 0
            rows.append((len(rows), f"s{s}", "call" if call else "false_positive", float(s * 10 + (5 if call else 0)), float(i % 2 == 0) + 0.01 * i))
    df = spark.createDataFrame(rows, "det_id int, station string, verdict string, local double, real double")
    pooled = lambda c: search.station_cv(df, c, retention=0.9).where("fold = 'POOLED'").first()["precision"]
    assert pooled("real") > 0.9 and pooled("local") < 0.75


def test_auc_averages_ties(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "v double, y boolean")
    assert metrics.auc(df, "v", F.col("y")).first()["auc"] == pytest.approx(3.5 / 4)


def test_segments_do_not_overlap_and_meet_the_quota(spark):
    recs = spark.createDataFrame([(f"s{i % 3}", f"r{i}", 600.0 + 400 * i) for i in range(9)], "station string, recording string, duration_s double")
    plan = sampling.plan_segments(recs, 10, 300.0, seed=3)
    got = plan.orderBy("recording", "start_s").collect()
    assert {r["station"]: r["count"] for r in plan.groupBy("station").count().collect()} == {"s0": 4, "s1": 3, "s2": 3}
    assert all(a["recording"] != b["recording"] or a["end_s"] <= b["start_s"] for a, b in zip(got, got[1:], strict=False))
    assert got == sampling.plan_segments(recs.repartition(5), 10, 300.0, seed=3).orderBy("recording", "start_s").collect()


def test_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i // 4}", f"c{i % 80 // 40}", i) for i in range(160)], "g string, label string, id int")
    got = sampling.grouped_split(df, "g", "label", 0.25)
    assert got.groupBy("g").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    assert got.where("part = 'validation'").select("label").distinct().count() == 2


def test_random_windows_stay_inside(spark):
    recs = spark.createDataFrame([("s", f"r{i}", 100.0 * (i + 1)) for i in range(4)], "station string, recording string, duration_s double")
    got = sampling.random_windows(recs, 50).join(recs, ["station", "recording"])
    assert got.count() == 50 and got.where("start_s < 0 OR start_s + 2 > duration_s").count() == 0


def test_manifest_violations(spark):
    df = spark.createDataFrame([("a", "x", "s", "yes", "0"), ("", "x", "s", "maybe", "1"), ("c", None, "s", "no", "-1")], "path string, label string, source string, verified string, aug string")
    got = {r["violation"]: r["n"] for r in quality.validate_manifest(df).collect()}
    assert got == {"blank_path": 1, "blank_label": 1, "bad_verified": 1, "bad_aug": 1}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 5)
    one = metrics.table_fingerprint(df).first()
    assert one == metrics.table_fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert one != metrics.table_fingerprint(df.where("id <> 7").union(spark.range(6, 7).withColumn("v", F.col("id") % 5))).first()


def test_knn_in_blocks_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 4))
    df = spark.createDataFrame([(i, "s", "a", x[i].tolist()) for i in range(60)], "det_id bigint, station string, species string, features array<double>")
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 5]
    assert column(neighbours.knn_distance(df, 5, block=16), "knn_dist") == pytest.approx(d.tolist(), abs=1e-6)


def test_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 3))
    c = rng.integers(0, 2, 200)
    df = spark.createDataFrame([(i, str(c[i]), x[i].tolist()) for i in range(200)], "det_id int, c string, v array<double>").repartition(5)
    got = column(vectors.with_distance(df, vectors.class_statistics(df, "c", "v", 1e-3), "v", "c"), "mahalanobis_d2")
    mean = np.stack([x[c == k].mean(0) for k in (0, 1)])
    r = x - mean[c]
    inv = np.linalg.inv(r.T @ r / 199 + 1e-3 * np.eye(3))
    assert got == pytest.approx(np.einsum("ni,ij,nj->n", r, inv, r).tolist())


NAMES = [
    ("Sp__S20210224T175957188+0100_E_+00.5000+012.7522__00042s__conf0.873.wav", "Sp", "S20210224T175957188+0100_E_+00.5000+012.7522", 42, 0.873),
    ("A__b__c__7s__conf1.0.wav", "A", "b__c", 7, 1.0),
    ("other.wav", None, None, -1, None),
]


def test_clip_names(spark):
    df = spark.createDataFrame([(n[0],) for n in NAMES], "n string")
    n = F.col("n")
    got = df.select(parse.clip_species(n), parse.clip_recording(n), parse.clip_start(n), parse.clip_confidence(n)).collect()
    assert [tuple(r) for r in got] == [x[1:] for x in NAMES]


def test_names_keep_coordinates(spark):
    r = "S20210224T175957188+0100_E_+00.5000+012.7522"
    df = spark.createDataFrame([(f"/d/{r}.WAV",)], "p string")
    p = F.col("p")
    row = df.select(parse.recording_stem(p).alias("stem"), parse.latitude(p).alias("lat"), parse.longitude(p).alias("lon"), parse.recording_start(p).alias("t"), parse.period(p).alias("m")).first()
    assert (row["stem"], row["lat"], row["lon"], str(row["t"]), row["m"]) == (r, 0.5, 12.7522, "2021-02-24 17:59:57", "2021-02")
    groups = ["x__pulse07.wav", "x__chunk0126.wav", "x__bout04_3p.wav", "0.554_2_x_807.0s_810.0s.wav", "x__t003.0s.wav", "x__01540s__conf0.980.wav", "x.wav"]
    got = spark.createDataFrame([(g,) for g in groups], "p string").select(parse.source_group(F.col("p")).alias("g")).distinct().collect()
    assert [r["g"] for r in got] == ["x"]


def test_neighbour_cuts_have_no_cap(spark):
    rng = np.random.default_rng(5)
    n = rng.choice([0, 3, 60, 90, 200], 300) + rng.integers(0, 2, 300)
    call = (n >= 90) | (rng.random(300) < 0.1)
    station = [f"s{i % 3}" for i in range(300)]
    rows = [(station[i], int(n[i]), "call" if call[i] else "false_positive") for i in range(300)] + [("s0", None, "call")]
    got = search.neighbour_loso(spark.createDataFrame(rows, "station string, n_neighbours bigint, verdict string"), 0.6).collect()
    for fold in ("s0", "s1", "s2"):
        train = [r for r in rows if r[0] != fold]
        calls = sum(r[2] == "call" for r in train)
        best = (-1.0, 0)
        for cut in range(max(r[1] or 0 for r in train) + 1):
            left = [r[2] == "call" for r in train if r[1] is not None and r[1] >= cut]
            if sum(left) >= 0.6 * calls and sum(left) / len(left) > best[0]:
                best = (sum(left) / len(left), cut)
        own = [r[2] == "call" for r in rows if r[0] == fold and r[1] is not None and r[1] >= best[1]]
        row = next(r for r in got if r["fold"] == fold)
        assert (row["cut"], row["calls_kept"], row["left"]) == (best[1], sum(own), len(own)) and best[1] > 40


def _joined(df):
    """Rows that joins and explosions of the executed plan made, at most in one of them."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            p = p.executedPlan()
        if p.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            p = p.plan()
        if ("Join" in p.nodeName() or p.nodeName() == "Generate") and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_crowded_seconds_meet_once(spark, det):
    crowd = det([(x / 4, "call" if x % 3 else "false_positive") for x in range(40)] * 50)
    assert _joined(matching.match_nearest(crowd, crowd)) <= 2000
    assert _joined(matching.detection_changes(crowd, crowd)) <= 2000
    review = crowd.withColumnRenamed("det_id", "review_id")
    assert _joined(matching.match_review(review, crowd, keep=())) <= 2000


def test_nearest_places_equal_all_pairs(spark, det):
    rng = np.random.default_rng(5)
    where = lambda n: np.concatenate([rng.uniform(-40, 300, n), rng.integers(-40, 300, n), rng.integers(0, 9, n) * 3.0]).tolist()
    said = lambda n: [[None, "call", "false_positive"][i] for i in rng.integers(0, 3, n)]
    a, b = where(60), where(25)
    new, old = det([*a, float("nan")]), det([*zip(b, said(75)), *zip(b[:30], said(30)), (float("nan"), "call")])
    new = new.unionByName(new.where("det_id = 0").withColumns({"det_id": F.lit(999).cast("bigint"), "start_s": F.lit(None).cast("double")}))
    got = matching.match_nearest(new, old).orderBy("det_id").select("gap_s", "near_start_s", "verdict").collect()
    seen = [(r["start_s"], r["verdict"]) for r in old.collect()]
    for x, g in zip([*a, float("nan"), None], got, strict=True):
        near = [(abs(x - s), s, v or "") for s, v in seen if abs(x - s) <= 3] if x is not None else []
        want = min(near, default=(None, None, ""))
        assert tuple(g) == (*want[:2], want[2] or None)
    row = matching.detection_changes(new, old).first()
    assert row["new_ground"] == sum(g["gap_s"] is None for g in got)
    at = {g["near_start_s"] for g in got}
    assert (row["calls_kept"], row["fps_lost"]) == (sum(v == "call" and s in at for s, v in seen), sum(v == "false_positive" and s not in at for s, v in seen))


def test_candidates_are_ordered_by_their_values_in_one_job(spark, monkeypatch):
    rng = np.random.default_rng(12)
    value = lambda x: None if x == 4 else float("nan") if x == 3 else float(x)
    rows = [(f"s{i % 3}", i, ["call", "false_positive", None][i % 7 % 3], value(x), 1.0) for i, x in enumerate(rng.integers(-3, 5, 120))]
    df = spark.createDataFrame(rows, "station string, det_id bigint, verdict string, a double, flat double")
    calls = []
    monkeypatch.setattr(search, "running", lambda *x: calls.append(x) or prefix.running(*x))
    got = {(r["signal"], r["larger_is_genuine"]): r["mean_ap"] for r in search.candidates_alone(df, ("a", "flat", "missing")).collect()}
    assert set(got) == {("a", True), ("a", False)} and len(calls) == 1
    for up in (True, False):
        want = ranking.effort_by_station(df.transform(ranking.rank_score({"a": up}))).agg(F.avg("average_precision")).first()[0]
        assert got["a", up] == pytest.approx(want)


@pytest.mark.parametrize("block", [7, 1024])
def test_nearest_reference_in_blocks_is_exact(spark, block):
    rng = np.random.default_rng(6)
    x, r = rng.standard_normal((20, 4)), rng.standard_normal((50, 4))
    label = ["b" if i < 9 else "c" if i < 10 else "a" for i in range(50)]
    cols = "f0 double, f1 double, f2 double, f3 double"
    targets = spark.createDataFrame([(i, *x[i].tolist()) for i in range(20)], f"id bigint, {cols}")
    reference = spark.createDataFrame([(label[i], i, *r[i].tolist()) for i in range(50)], f"label string, ref bigint, {cols}")
    df = neighbours.nearest_reference(targets, reference, ("f0", "f1", "f2", "f3"), "label", "id", block, block)
    d = np.linalg.norm(((x[:, None] - r[None]) / r.std(0)), axis=2)
    of = {k: [i for i in range(50) if label[i] == k] for k in "abc"}
    want = [(i, k, len(at), d[i, at].min(), np.median(d[i, at])) for i in range(20) for k, at in of.items()]
    got = df.orderBy("id", "label").select("id", "label", "n", "nearest", "median").collect()
    assert [tuple(g[:3]) for g in got] == [w[:3] for w in want]
    assert [g[3:] for g in got] == [pytest.approx(w[3:]) for w in want]


def test_medians_over_several_blocks_come_from_bounds(spark):
    rng = np.random.default_rng(8)
    r = rng.standard_normal((6000, 3))
    r[1000:2500] = r[0]  # copies, and a label of nothing else
    x = np.concatenate([rng.standard_normal((8, 3)), r[:2]])
    label = np.where(np.arange(6000) < 2400, "copies", "a")
    cols = "f0 double, f1 double, f2 double"
    targets = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], f"id bigint, {cols}")
    reference = spark.createDataFrame([(str(label[i]), i, *v) for i, v in enumerate(r.tolist())], f"label string, ref bigint, {cols}")
    got = neighbours.nearest_reference(targets, reference, ("f0", "f1", "f2"), "label", "id", 5, 900).orderBy("id", "label").collect()
    d = np.linalg.norm((x[:, None] - r[None]) / r.std(0), axis=2)
    want = [(i, k, int((label == k).sum()), d[i, label == k].min(), np.median(d[i, label == k])) for i in range(10) for k in ("a", "copies")]
    assert [(g["id"], g["label"], g["n"]) for g in got] == [w[:3] for w in want]
    assert [(g["nearest"], g["median"]) for g in got] == [pytest.approx(w[3:], abs=1e-9) for w in want]


def test_block_pairs_do_not_send_on_all_distances():
    rng = np.random.default_rng(9)
    z = rng.standard_normal((4004, 3)).tolist()
    t = pa.table({"_l": ["a"] * 4004, "_k": [2] * 4004, "_side": [0] * 4 + [1] * 4000, "_id": [*range(4), *[None] * 4000], "_z": z})
    assert max(map(len, neighbours._to_label(t)["_d"].to_pylist())) < 600


def test_every_labelled_vector_is_a_reference(spark):
    rows = queries.queries()["j13_nearest_reference_all"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["n"] for r in rows) == 500 * 500 and any(r["nearest"] != r["median"] for r in rows)


def test_exact_quantiles_of_many_groups_at_once(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 501), (None, 40)) for v in rng.integers(0, 1 + n // 3, n)] + [("c", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    found = prefix.exact_quantiles(df, "v", at, ["g"])
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        v = [x for k, x in rows if k == g and x is not None]
        assert r["n"] == len(v) and r["q"] == pytest.approx(np.quantile(v, at))
    whole = prefix.exact_quantiles(df, "v", at).first()
    assert whole["q"] == pytest.approx(np.quantile([x for _, x in rows if x is not None], at))
    assert prefix.exact_quantiles(df.where("v IS NULL"), "v", at).count() == 0


def test_no_group_is_gathered_for_its_quantiles(spark):
    for name in ("a15_durations", "a19_species_profile", "a29_purity_by_source", "a33_feature_groups", "f9_distance_flag", "l1_signal_sweep", "l4_station_holdout", "w11_station_regimes"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().lower()
        assert "percentile(" not in plan and "median(" not in plan, name
