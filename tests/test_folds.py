"""Left-out stations: forward selection and logistic probes against plain versions."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorusframe import queries
from chorusframe.operators import probe, search, selection
from chorusframe.views import SIG, view

SCHEMA = "det_id bigint, station string, verdict string, base double, a double, b double, c double"


def signals(stations=5, rows=60, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(stations):
        for _ in range(rows):
            call = bool(rng.random() < 0.4)
            v = [float(np.round(rng.normal(w * call), 1)) for w in (0.5, -1.5, 0.8, 0.0)]
            out.append((len(out), f"s{s}", "call" if call else "false_positive", *(None if rng.random() < 0.1 else x for x in v)))
    return [*out, (9000, "quiet", "false_positive", 0.1, 0.2, None, 0.3), (9001, None, "call", 1.0, 1.0, 1.0, 1.0), (9002, "s0", None, 0.5, 3.0, 0.5, 0.5)]


def plain_selection(rows, most):
    stations = sorted({r[1] for r in rows if r[1]})

    def ranks(col, up):
        out = {}
        for s in stations:
            own = [r for r in rows if r[1] == s]
            key = [(r[col] is None, 0 if r[col] is None else r[col] if up else -r[col]) for r in own]
            for r, k in zip(own, key, strict=True):
                out[r[0]] = 2 * sum(x < k for x in key) + key.count(k) + 1
        return out

    matrix = {(n, up): ranks(i, up) for n, i in (("base", 3), ("a", 4), ("b", 5), ("c", 6)) for up in (True, False)}

    def ap(s, used):
        own = sorted((r for r in rows if r[1] == s and r[2]), key=lambda r: (-sum(matrix[u][r[0]] for u in used), r[0]))
        hits = np.cumsum([r[2] == "call" for r in own])
        at = [hits[i] / (i + 1) for i, r in enumerate(own) if r[2] == "call"]
        return float(np.mean(at)) if at else None

    def mean(fold, used):
        known = [x for s in stations if s != fold and (x := ap(s, used)) is not None]
        return round(float(np.mean(known)), 12) if known else None

    found = {}
    for fold in stations:
        used = [("base", True)]
        for _ in range(most):
            best, pick = mean(fold, used), None
            for n in "abc":
                for up in (True, False):
                    if n not in [x for x, _ in used] and (best is None or mean(fold, [*used, (n, up)]) > best):
                        best, pick = mean(fold, [*used, (n, up)]), (n, up)
            if not pick:
                break
            used.append(pick)
        found[fold] = (", ".join(f"{n}({'hi' if up else 'lo'})" for n, up in used[1:]), ap(fold, [("base", True)]), ap(fold, used))
    return found


@pytest.mark.parametrize("most", [0, 1, 2])
def test_selection_equals_a_plain_one(spark, most):
    rows = signals()
    got = selection.holdout_selection(spark.createDataFrame(rows, SCHEMA), {"base": True}, ["a", "b", "c"], most).collect()
    want = plain_selection(rows, most)
    assert {r["station"]: r["added"] for r in got} == {s: w[0] for s, w in want.items()}
    for r in got:
        assert (r["ap_baseline"], r["ap_with_added"]) == (pytest.approx(want[r["station"]][1]), pytest.approx(want[r["station"]][2]))
    if most == 2:
        assert any(", " in w[0] for w in want.values()) and all("a(lo)" in w[0] for w in want.values())


def test_selection_of_equal_signals_takes_the_first_and_empty_tables_give_nothing(spark):
    df = spark.createDataFrame(signals(3, 30), SCHEMA).withColumn("b", F.col("a"))
    assert all(r["added"].startswith("a(lo)") for r in selection.holdout_selection(df, {"base": True}, ["a", "b"], 1).collect())
    assert selection.holdout_selection(df.where("false"), {"base": True}, ["a"]).count() == 0


def jobs(spark, run):
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_probe_steps_do_not_grow_with_folds(spark):
    def rows(stations):
        rng = np.random.default_rng(0)
        return spark.createDataFrame([(f"s{i % stations}", bool(i // stations % 2), float(rng.normal(i // stations % 2))) for i in range(600)], "station string, positive boolean, x double")

    few, many = (jobs(spark, lambda d=rows(n): probe.probe_probabilities(d, ["x"])) for n in (3, 12))
    assert abs(few - many) <= 4  # a step more or less


def plain_probe(x, y, station, fold, l2=10.0):
    """Newton steps on features standardised by the training rows."""
    t = station != fold
    scale = np.where(x[t].std(0) > 0, x[t].std(0), 1)
    z = np.column_stack([np.ones(len(x)), (x - x[t].mean(0)) / scale])
    w, pen = np.zeros(z.shape[1]), np.r_[0, np.full(x.shape[1], l2)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-z[t] @ w))
        w = w - np.linalg.solve(z[t].T @ (z[t] * (p * (1 - p))[:, None]) + np.diag(pen), z[t].T @ (p - y[t]) + pen * w)
    return 1 / (1 + np.exp(-z[~t] @ w))


def test_probe_probabilities_equal_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    station = np.array([f"s{i % 4}" for i in range(400)])
    y = rng.random(400) < 0.4
    x = np.column_stack([rng.normal(1000 + y * 3, 2), rng.normal(-0.01 * y, 0.01), np.where(station == "s1", rng.normal(size=400), 7.0)])  # the last is constant where s1 is left out
    rows = [(str(s), bool(p), *map(float, v)) for s, p, v in zip(station, y, x, strict=True)]
    extra = [("s0", True, None, 1.0, 1.0), ("s0", False, float("nan"), 1.0, 1.0), (None, True, 1.0, 1.0, 1.0), ("s1", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + extra, "station string, positive boolean, u double, v double, w double").repartition(7)
    got = probe.probe_probabilities(df, ["u", "v", "w"]).collect()
    for s in ("s0", "s1", "s2", "s3"):
        mine = sorted(r["probability"] for r in got if r["station"] == s)
        assert mine == pytest.approx(sorted(plain_probe(x, y, station, s)), abs=1e-6)


def test_probe_leaves_out_small_and_uniform_stations(spark):
    rows = [("a", i % 2 == 0, float(i % 5)) for i in range(40)] + [("b", i % 3 == 0, float(i % 7)) for i in range(40)] + [("tiny", True, 1.0), ("one", False, 2.0)] + [("same", True, 1.0)] * 30
    df = spark.createDataFrame(rows, "station string, positive boolean, x double")
    assert {r["station"] for r in probe.probe_loso(df, ["x"]).collect()} == {"a", "b"}
    assert probe.probe_loso(df.where("station = 'a'"), ["x"]).count() == 0 and probe.probe_loso(df.where("false"), ["x"]).count() == 0
    apart = spark.createDataFrame([(f"s{i % 2}", i % 4 < 2, float(i % 4 < 2)) for i in range(80)], "station string, positive boolean, x double")
    with pytest.raises(ValueError, match="settled"):
        probe.probe_loso(apart, ["x"], l2=0.0, steps=8)
    assert {r["auc"] for r in probe.probe_loso(apart, ["x"]).collect()} == {1.0}


def test_registered_probe_equals_a_plain_fit(spark):
    sf = "/root/testdata/sf0.001"
    rows = view(spark, sf, SIG).where("mahalanobis_d2 IS NOT NULL AND confidence IS NOT NULL AND verdict IS NOT NULL").select("station", "verdict", "confidence", "mahalanobis_d2").toPandas()
    station, y, x = rows["station"].to_numpy(), (rows["verdict"] == "call").to_numpy(), rows[["confidence", "mahalanobis_d2"]].to_numpy(float)
    got = {r["station"]: r["auc"] for r in queries.queries()["l23_probe_loso"](spark, sf).collect()}
    assert set(got) == {s for s in set(station) if (station == s).sum() >= 20 and 0 < y[station == s].sum() < (station == s).sum()} and got
    for s in got:
        p, own = plain_probe(x, y, station, s), y[station == s]
        won = np.mean((p[own][:, None] > p[~own][None, :]) + (p[own][:, None] == p[~own][None, :]) / 2)
        assert got[s] == pytest.approx(won * 1e6, abs=2)


@pytest.mark.parametrize("sign", [1, -1])
def test_gate_grid_follows_the_better_criterion_in_its_direction(spark, sign):
    rows = [(i % 10 / 10, sign * float(i), 1.0, i >= 50) for i in range(100)] + [(None, sign * 99.0, None, True), (0.9, None, 1.0, False)]
    df = spark.createDataFrame(rows, "first double, second double, flat double, y boolean")
    got = search.gate_grid(df, "first", ["second"], F.col("y"), (0.5, 0.3), (0.2,)).orderBy("cut").collect()
    ranked = sorted(sign * r[1] for r in rows if r[3])  # the good end last
    limit = float(np.quantile(ranked, 0.2)) * sign
    for r in got:
        keep = [x[0] is not None and x[0] >= r["cut"] and x[1] is not None and sign * x[1] >= sign * limit for x in rows]
        assert r["limit"] == pytest.approx(limit) and r["low"] == (sign < 0)
        assert r["positives_kept"] == pytest.approx(sum(k for k, x in zip(keep, rows, strict=True) if x[3]) / 51)
        assert r["negatives_kept"] == pytest.approx(sum(k for k, x in zip(keep, rows, strict=True) if not x[3]) / 51)
    assert {r["cut"] for r in got} == {0.3, 0.5}
    picked = search.gate_grid(df, "first", ["flat", "second"], F.col("y"), (0.5,), (0.2,)).first()["criterion"]
    assert picked == ("second" if sign > 0 else "flat")
    assert search.gate_grid(df.where("NOT y"), "first", ["second"], F.col("y"), (0.5,), (0.2,)).count() == 0


def test_a_step_of_the_selection_takes_as_many_jobs_for_any_number_of_sets(spark):
    names = ["base", "a", "b", "c"]
    matrix = selection.rank_matrix(spark.createDataFrame(signals(3, 30), SCHEMA), names).cache()
    matrix.count()
    sets = [frozenset({("base", True), (n, up)}) for n in "abc" for up in (True, False)]
    at = {n: k for k, n in enumerate(names)}
    one, six = (jobs(spark, lambda s=s: selection._precisions(matrix, s, at).collect()) for s in (sets[:1], sets))
    matrix.unpersist()
    assert one == six
