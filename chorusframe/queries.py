"""Registered queries of the detection operators, each with SQL that gives the same rows.

Fractions that depend on the order of sums are compared as millionths (``micro``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import intervals, parse, scores
from .operators import gates, matching, metrics, neighbours, probe, quality, ranking, regime, sampling, search, sessions, slots, vectors, windows
from .views import DET, DET2, MAN, PLACES, RECS, SIG, plain, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGS = ("flag_mahal", "flag_tag", "flag_isolated")


def micro(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5).cast("bigint")


def m(x: str, name: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT) AS {name}"


def query(sql: str | None = None, **views: str):
    """Register a function of its views (and, where it has no SQL, without any)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(**{k: view(spark, sf_dir, v) for k, v in views.items()})

        QUERIES[f.__name__] = run
        if sql:
            named = ", ".join(f"{k} AS ({plain(v)})" for k, v in views.items())
            SQL[f.__name__] = (f"WITH {named}, " + sql.removeprefix("WITH ")) if sql.startswith("WITH ") else f"WITH {named} {sql}"
        return f

    return add


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


RUN = """WITH {0} AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {1} THEN 1 ELSE 0 END) OVER (PARTITION BY station, recording, species ORDER BY start_s, det_id) AS {0}_no
FROM (SELECT *, start_s - lag(start_s) OVER (PARTITION BY station, recording, species ORDER BY start_s, det_id) AS gap FROM {2}))"""
EVENT, EPISODE = RUN.format("event", 2, "det"), RUN.format("episode", 300, "det")
EVENTS = EVENT + """, e AS (SELECT station, recording, species, CAST(event_no AS BIGINT) AS event_no, min(start_s) AS start_s, max(start_s) + 2 AS end_s, count(*) AS windows, max(confidence) AS max_confidence,
 count(*) FILTER (verdict = 'call') AS call_windows, count(verdict) AS reviewed FROM event GROUP BY ALL)"""
EPISODES = EPISODE + """, e AS (SELECT station, recording, species, CAST(episode_no AS BIGINT) AS episode_no, count(*) AS detections, count(*) FILTER (verdict = 'call') AS calls, count(*) FILTER (verdict = 'false_positive') AS fps,
 max(start_s) - min(start_s) AS span_s FROM episode GROUP BY ALL), p AS (SELECT *, CASE WHEN fps = 0 THEN 'calls' WHEN calls = 0 THEN 'false_positives' ELSE 'mixed' END AS purity FROM e)"""


# Runs and windows.
@query(EVENT + " SELECT det_id, CAST(event_no AS BIGINT) AS event_no FROM event", det=DET)
def w1_assign_events(det):
    return det.transform(sessions.assign_events()).select("det_id", "event_no")


@query(EPISODE + " SELECT det_id, CAST(episode_no AS BIGINT) AS episode_no FROM episode", det=DET)
def w2_assign_episodes(det):
    return det.transform(sessions.assign_episodes()).select("det_id", "episode_no")


@query(
    EPISODE
    + """, f AS (SELECT *, count(*) OVER w AS k, min(start_s) OVER w AS a, max(start_s) OVER w AS b FROM episode WINDOW w AS (PARTITION BY station, recording, species, episode_no))
SELECT det_id, k AS episode_size, b - a AS episode_span_s, k / (b - a + 1) AS episode_rate, CASE WHEN k > 1 THEN (b - a) / (k - 1) ELSE 300.0 END AS episode_mean_gap_s,
 CASE WHEN b > a THEN (start_s - a) / (b - a) ELSE 0.0 END AS episode_position FROM f""",
    det=DET,
)
def w3_episode_features(det):
    return det.transform(sessions.episode_features()).select("det_id", "episode_size", "episode_span_s", "episode_rate", "episode_mean_gap_s", "episode_position")


@query(
    """WITH g AS (SELECT det_id, start_s - lag(start_s) OVER w AS a, lead(start_s) OVER w - start_s AS b FROM det WINDOW w AS (PARTITION BY station, recording, species ORDER BY start_s, det_id))
SELECT det_id, least(a, b) AS gap_to_nearest_s FROM g""",
    det=DET,
)
def w4_gap_to_nearest(det):
    return sessions.gap_to_nearest(det).select("det_id", "gap_to_nearest_s")


@query(
    EVENT
    + """, f AS (SELECT *, count(*) OVER w AS k, min(start_s) OVER w AS a, max(start_s) OVER w AS b FROM event WINDOW w AS (PARTITION BY station, recording, species, event_no))
SELECT det_id, k AS event_windows, b - a + 2 AS event_duration_s, CASE WHEN b > a THEN (start_s - a) / (b - a) ELSE 0.0 END AS event_position FROM f""",
    det=DET,
)
def w5_event_features(det):
    return det.transform(sessions.event_features()).select("det_id", "event_windows", "event_duration_s", "event_position")


@query(
    "SELECT det_id, count(*) OVER (PARTITION BY station, recording, species ORDER BY start_s RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) - 1 AS n_neighbours FROM det",
    det=DET,
)
def w6_neighbour_counts(det):
    return det.transform(neighbours.count_neighbours()).select("det_id", "n_neighbours")


RANK = "(rank() OVER (PARTITION BY station ORDER BY {0} {1} NULLS LAST) + (count(*) OVER (PARTITION BY station, {0}) - 1) / 2.0) / count(*) OVER (PARTITION BY station)"
SCORE = f"({RANK.format('confidence', 'ASC')} + {RANK.format('n_neighbours', 'ASC')} + {RANK.format('mahalanobis_d2', 'DESC')}) / 3"


@query(f"SELECT det_id, {m(RANK.format('mahalanobis_d2', 'ASC'), 'pct')} FROM sig", sig=SIG)
def w7_percentile_rank(sig):
    return ranking.percentile_rank(sig, "mahalanobis_d2", "pct").select("det_id", micro("pct").alias("pct"))


@query(f"SELECT det_id, {m(SCORE, 'rank_score')} FROM sig", sig=SIG)
def w8_rank_score(sig):
    return sig.transform(ranking.rank_score()).select("det_id", micro("rank_score").alias("rank_score"))


@query(
    """WITH r AS (SELECT det_id, station, CASE WHEN verdict = 'call' THEN 1 ELSE 0 END AS hit, row_number() OVER (ORDER BY confidence DESC, det_id) AS pos FROM sig),
f AS (SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS fraction), t AS (SELECT count(*) AS n, sum(hit) AS calls FROM r),
b AS (SELECT fraction, CAST(round_even(n * fraction, 0) AS BIGINT) AS k, CAST(calls AS BIGINT) AS calls FROM f, t),
s AS (SELECT station, count(*) AS m, sum(hit) AS h FROM r GROUP BY station),
c AS (SELECT fraction, CAST(sum(least(round_even(m * fraction, 0), h)) AS BIGINT) AS ceiling FROM s, f GROUP BY fraction)
SELECT b.fraction, b.k, b.calls, c.ceiling, CAST(sum(hit) FILTER (pos <= b.k) AS BIGINT) AS found, sum(hit) FILTER (pos <= b.k) / b.calls AS recall, sum(hit) FILTER (pos <= b.k) / c.ceiling AS of_ceiling
FROM b JOIN c USING (fraction), r GROUP BY b.fraction, b.k, b.calls, c.ceiling""",
    sig=SIG,
)
def w9_effort_curve(sig):
    return ranking.effort_curve(sig, score="confidence").select("fraction", *long("k", "calls", "ceiling", "found"), "recall", "of_ceiling")


@query(
    f"""WITH r AS (SELECT station, CASE WHEN verdict = 'call' THEN 1 ELSE 0 END AS hit, row_number() OVER w AS pos, sum(CASE WHEN verdict = 'call' THEN 1 ELSE 0 END) OVER w AS cum, count(*) OVER (PARTITION BY station) AS n FROM sig WINDOW w AS (PARTITION BY station ORDER BY confidence DESC, det_id))
SELECT station, count(*) AS n, CAST(sum(hit) AS BIGINT) AS calls, CAST(sum(hit) FILTER (pos <= round_even(n * 0.5, 0)) AS BIGINT) AS found, {m('avg(cum / pos) FILTER (hit = 1)', 'average_precision')}, CAST(least(sum(hit), round_even(count(*) * 0.5, 0)) AS BIGINT) AS ceiling, {m('sum(hit) / count(*)', 'random_precision')} FROM r GROUP BY station""",
    sig=SIG,
)
def w10_effort_by_station(sig):
    e = ranking.effort_by_station(sig, score="confidence")
    return e.select("station", *long("n", "calls", "found", "ceiling"), micro("average_precision").alias("average_precision"), micro("random_precision").alias("random_precision"))


@query(
    f"""WITH k AS (SELECT station, det_id, knn_dist AS t, mahalanobis_d2 AS d, row_number() OVER w AS pos, count(*) OVER (PARTITION BY station) AS m, lead(knn_dist) OVER w / greatest(knn_dist, 1e-9) AS r FROM sig WHERE knn_dist IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY knn_dist, det_id)),
c AS (SELECT station, pos AS cluster, r AS gap_ratio, m FROM k WHERE pos >= greatest(1, floor(m * 0.25)) AND r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station ORDER BY r DESC, pos) = 1),
s AS (SELECT k.station, median(d) FILTER (pos <= cluster) AS cd, median(d) FILTER (pos > cluster) AS rd FROM k JOIN c USING (station) GROUP BY k.station),
n AS (SELECT station, count(*) AS n FROM sig GROUP BY station)
SELECT station, n, cluster, {m('gap_ratio', 'gap_ratio')}, {m('cd', 'cluster_distance')}, {m('rd', 'rest_distance')},
CASE WHEN coalesce(m, 0) < 10 THEN 'too few detections' WHEN gap_ratio IS NULL OR gap_ratio < 2 THEN 'no gap' WHEN cluster < 0.25 * m OR cluster >= m THEN 'cluster too small' WHEN cd IS NULL OR rd IS NULL THEN 'no distance values' WHEN cd <= rd THEN 'cluster is the familiar side' ELSE 'invaded' END AS verdict
FROM n LEFT JOIN c USING (station) LEFT JOIN s USING (station)""",
    sig=SIG,
)
def w11_station_regimes(sig):
    r = regime.station_regimes(sig)
    return r.select("station", *long("n", "cluster"), *(micro(c).alias(c) for c in ("gap_ratio", "cluster_distance", "rest_distance")), "verdict")


@query(sig=SIG)
def w11_flag_invading(sig):
    return regime.flag_invading_cluster(sig.drop("flag_invading_cluster")).groupBy("station", "station_regime").agg(F.count_if("flag_invading_cluster").alias("flagged"))


SQL["w11_flag_invading"] = f"SELECT station, CASE WHEN verdict = 'invaded' THEN 'invaded' ELSE 'normal' END AS station_regime, CASE WHEN verdict = 'invaded' THEN CAST(cluster AS BIGINT) ELSE 0 END AS flagged FROM ({SQL['w11_station_regimes']})"


QUEUE = (
    EPISODE.replace("FROM det)", "FROM sig)")
    + f""", r AS (SELECT *, {SCORE} AS rank_score FROM episode), x AS (SELECT *, max(rank_score) OVER e AS best, count(*) OVER e AS episode_size, row_number() OVER (PARTITION BY station, recording, species, episode_no ORDER BY rank_score DESC NULLS LAST, start_s, det_id) = 1 AS listen_first
 FROM r WINDOW e AS (PARTITION BY station, recording, species, episode_no)), queue AS (SELECT *, row_number() OVER (ORDER BY best DESC NULLS LAST, station, recording, species, episode_no, rank_score DESC NULLS LAST, start_s, det_id) AS queue_no FROM x)"""
)


@query(f"{QUEUE} SELECT queue_no, det_id, CAST(episode_no AS BIGINT) AS episode_no, episode_size, listen_first FROM queue", sig=SIG)
def w13_review_queue(sig):
    return ranking.build_queue(sig).select("queue_no", "det_id", "episode_no", "episode_size", "listen_first")


@query("SELECT content_hash, path FROM man QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY verified DESC NULLS LAST, source, path) = 1", man=MAN)
def w14_priority_dedupe(man):
    return ranking.keep_first(man, ["content_hash"], [F.desc_nulls_last("verified"), F.col("source"), F.col("path")]).select("content_hash", "path")


@query(
    # Windows are two seconds long and begin at whole seconds, so only equal ones overlap by half; tests compare others with brute force.
    "SELECT det_id, recording, species, start_s FROM det QUALIFY row_number() OVER (PARTITION BY recording, species, start_s ORDER BY confidence DESC, det_id) = 1",
    det=DET,
)
def w15_suppress_overlaps(det):
    return windows.suppress_overlaps(det).select("det_id", "recording", "species", "start_s")


@query(
    """WITH g AS (SELECT recording, duration_s AS d, CAST(greatest(0, floor((duration_s - 2) / 1)) AS BIGINT) AS steps FROM recs),
s AS (SELECT recording, unnest(range(0, steps + 1)) AS win_no, CAST(unnest(range(0, steps + 1)) AS DOUBLE) AS start_s FROM g UNION ALL SELECT recording, steps + 1, d - 2 FROM g WHERE d > 2 AND steps + 2 < d)
SELECT recording, CAST(win_no AS INT) AS win_no, start_s, start_s + 2 AS end_s FROM s""",
    recs=RECS,
)
def w16_sliding_windows(recs):
    return windows.sliding_windows(recs)


FRAMES = "SELECT recording, CAST(start_s AS BIGINT) AS frame, CAST(count(*) * 100 + sum(det_id % 10) AS DOUBLE) AS energy FROM ({0}) x GROUP BY recording, CAST(start_s AS BIGINT)"


@query(
    """WITH e AS (SELECT recording, frame, sum(energy) OVER w AS e, count(*) OVER w AS n FROM frames WINDOW w AS (PARTITION BY recording ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT recording, 'loudest' AS kind, frame, e AS energy FROM e WHERE n = 5 QUALIFY row_number() OVER (PARTITION BY recording ORDER BY e DESC, frame) = 1
UNION ALL SELECT recording, 'quietest', frame, e FROM e WHERE n = 5 QUALIFY row_number() OVER (PARTITION BY recording ORDER BY e, frame) = 1""",
    frames=FRAMES.format(DET),
)
def w17_loudest_window(frames):
    both = [windows.loudest(frames, 5, q).withColumn("kind", F.lit(k)) for k, q in (("loudest", False), ("quietest", True))]
    return both[0].unionByName(both[1])


PULSE = """WITH o AS (SELECT recording, frame, frame - lag(frame) OVER (PARTITION BY recording ORDER BY frame) AS gap FROM (SELECT *, max(energy) OVER (PARTITION BY recording) AS peak FROM frames) WHERE energy > 0.3 * peak),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap - 1 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY frame) AS run FROM o),
pulses AS (SELECT recording, CAST(min(frame) AS DOUBLE) AS start_s, least(CAST(max(frame) + 1 AS DOUBLE), CAST(min(frame) AS DOUBLE) + 20) AS end_s FROM r GROUP BY recording, run)"""


def _pulses(frames):
    return windows.pulse_segments(frames, 1.0, share=0.3, min_s=1.0, merge_s=3.0, max_s=20.0)


@query(PULSE + " SELECT * FROM pulses", frames=FRAMES.format(DET))
def w18_pulse_segments(frames):
    return _pulses(frames)


@query(
    PULSE + ", n AS (SELECT recording, start_s, count(*) OVER (PARTITION BY recording ORDER BY start_s RANGE BETWEEN CURRENT ROW AND 25 FOLLOWING) AS pulses FROM pulses) SELECT recording, greatest(0.0, start_s - 5) AS start_s, greatest(0.0, start_s - 5) + 30 AS end_s, pulses FROM n WHERE pulses >= 2",
    frames=FRAMES.format(DET),
)
def w19_bout_windows(frames):
    return windows.bout_windows(_pulses(frames), 30.0, 5.0, 2)


@query(
    f"{PULSE}, g AS (SELECT *, end_s - start_s AS width, lead(start_s) OVER (PARTITION BY recording ORDER BY start_s) - end_s AS gap FROM pulses) SELECT recording, count(*) AS pulses, quantile_cont(width, 0.5) AS width_median, quantile_cont(width, 0.75) - quantile_cont(width, 0.25) AS width_iqr, quantile_cont(gap, 0.5) AS gap_median, {m('count(*) / (max(end_s) - min(start_s))', 'rate')} FROM g GROUP BY recording",
    frames=FRAMES.format(DET),
)
def a32_pulse_stats(frames):
    return metrics.pulse_stats(_pulses(frames)).select("recording", "pulses", "width_median", "width_iqr", "gap_median", micro("rate").alias("rate"))


@query(
    """WITH n AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY path) AS i FROM man),
x AS (SELECT *, unnest(range(0, CASE WHEN label = 'en' THEN 1 ELSE CAST(greatest(1, ceil(700.0 / n)) AS INT) END)) AS aug FROM n)
SELECT path, label, CAST(aug AS INT) AS aug FROM x WHERE label = 'en' OR aug = 0 OR aug * n + i <= 700""",
    man=MAN,
)
def w20_augment(man):
    return windows.augment_to(man, 700, background="en").select("path", "label", "aug")


@query("SELECT count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, count(DISTINCT doc_id) AS \"distinct\", min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AND count(DISTINCT doc_id) = count(*) AS contiguous FROM man", man=MAN)
def w21_contiguous(man):
    return quality.contiguous_rows(man, "doc_id")


# Aggregates.
@query(EVENTS + " SELECT station, recording, species, event_no, start_s, end_s, windows, max_confidence, call_windows, end_s - start_s AS duration_s, CASE WHEN call_windows > 0 THEN 'call' WHEN reviewed > 0 THEN 'false_positive' END AS verdict, call_windows > 0 AND call_windows < reviewed AS mixed FROM e", det=DET)
def a13_events(det):
    return sessions.events(det).drop("reviewed_windows")


@query(EVENTS + " SELECT coalesce(station, 'ALL') AS station, CAST(sum(windows) AS BIGINT) AS windows, count(*) AS events, max(windows) AS longest_windows, sum(windows) / count(*) AS windows_per_event FROM e GROUP BY ROLLUP (station)", det=DET)
def a14_event_effort(det):
    return sessions.event_effort(det)


@query(
    EVENTS + f", v AS (SELECT *, end_s - start_s AS d, CASE WHEN call_windows > 0 THEN 'call' ELSE 'false_positive' END AS verdict FROM e) SELECT coalesce(verdict, 'ALL') AS verdict, count(*) AS events, median(d) AS median_s, quantile_cont(d, 0.9) AS p90_s, max(d) AS max_s, {m('avg(d)', 'mean_s')}, {m('count(*) FILTER (windows = 1) / count(*)', 'single_share')} FROM v GROUP BY ROLLUP (verdict)",
    det=DET,
)
def a15_durations(det):
    return sessions.duration_summary(det).withColumns({c: micro(c) for c in ("mean_s", "single_share")})


@query(EPISODES + " SELECT * FROM p", det=DET)
def a16_episodes(det):
    return sessions.episodes(det)


@query(EPISODES + " SELECT coalesce(station, 'ALL') AS station, CAST(sum(detections) AS BIGINT) AS detections, count(*) AS episodes, CAST(sum(CASE WHEN purity = 'mixed' THEN detections ELSE 1 END) AS BIGINT) AS listens, 1 - sum(CASE WHEN purity = 'mixed' THEN detections ELSE 1 END) / sum(detections) AS saved_share FROM p GROUP BY ROLLUP (station)", det=DET)
def a17_episode_effort(det):
    return sessions.episode_effort(det)


@query(
    "SELECT count(*) FILTER (verdict = 'call' AND NOT flag_tag) AS calls_kept, count(*) FILTER (verdict = 'call' AND flag_tag) AS calls_lost, count(*) FILTER (verdict <> 'call' AND flag_tag) AS fps_removed, count(*) FILTER (NOT flag_tag) AS \"left\", count(*) FILTER (flag_tag) / count(*) AS removed_share, count(*) FILTER (verdict = 'call' AND NOT flag_tag) / count(*) FILTER (NOT flag_tag) AS precision FROM sig",
    sig=SIG,
)
def a1_outcome(sig):
    return sig.agg(*metrics.outcome(F.col("flag_tag")))


@query(
    "SELECT coalesce(species, 'ALL') AS species, count(*) AS detections, count(*) FILTER (verdict = 'call') AS confirmed, count(*) FILTER (verdict = 'false_positive') AS false_positives, count(*) FILTER (verdict IS NULL) AS unreviewed, count(DISTINCT station) AS stations, count(DISTINCT recording) AS recordings, count(*) FILTER (verdict = 'call') / count(verdict) AS precision FROM det GROUP BY ROLLUP (species)",
    det=DET,
)
def a2_review_summary(det):
    return metrics.summarize_review(det)


LABELLED = f"SELECT *, CASE WHEN det_id % 4 = 0 THEN NULL WHEN det_id % 9 = 0 THEN 'unsure' ELSE verdict END AS label FROM ({DET}) d"


@query("SELECT coalesce(species, 'ALL') AS species, count(*) AS clips, count(*) FILTER (label = 'call') AS call, count(*) FILTER (label = 'false_positive') AS false_positive, count(*) FILTER (label = 'unsure') AS unsure, count(*) FILTER (label IS NULL) AS unlabelled, count(label) / count(*) AS progress FROM lab GROUP BY ROLLUP (species)", lab=LABELLED)
def a3_label_summary(lab):
    return metrics.summarize_labels(lab)


@query("SELECT station, " + ", ".join(f"count(*) FILTER (species = '{s}') AS \"{s}\"" for s in ("click", "view")) + " FROM det GROUP BY station", det=DET)
def a4_station_species(det):
    return metrics.station_species(det, ("click", "view"))


@query("SELECT verdict, count(*) FILTER (cleanup = 'clean') AS clean, count(*) FILTER (cleanup = 'suspicious') AS suspicious FROM sig WHERE cleanup IS NOT NULL GROUP BY verdict", sig=SIG)
def a5_confusion(sig):
    return metrics.confusion(sig)


@query(
    """WITH x AS (SELECT species, verdict = 'call' AS c, cleanup IS NOT NULL AS ok, coalesce(cleanup = 'suspicious', false) AS s FROM sig)
SELECT coalesce(species, 'ALL') AS species, count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS unmatched, count(*) FILTER (c AND ok) AS calls, count(*) FILTER (NOT c AND ok) AS fps, count(*) FILTER (NOT c AND s) / count(*) FILTER (NOT c AND ok) AS fp_removed_share,
count(*) FILTER (c AND ok AND NOT s) / count(*) FILTER (c AND ok) AS calls_kept_share, count(*) FILTER (c AND ok) / count(*) FILTER (ok) AS precision_before, count(*) FILTER (c AND ok AND NOT s) / count(*) FILTER (ok AND NOT s) AS precision_after, count(*) FILTER (s) / count(*) FILTER (ok) AS listening_saved FROM x GROUP BY ROLLUP (species)""",
    sig=SIG,
)
def a6_evaluation(sig):
    return metrics.evaluate(sig)


REASON = f"SELECT *, concat_ws('|', CASE WHEN flag_mahal THEN 'mahal' END, CASE WHEN flag_tag THEN concat('tag:', tag_top) END, CASE WHEN flag_isolated THEN 'isolated' END, CASE WHEN flag_invading_cluster THEN 'invading_cluster' END) AS flag_reason, CAST(flag_mahal AS INT) + CAST(flag_tag AS INT) + CAST(flag_isolated AS INT) + CAST(flag_invading_cluster AS INT) AS n_flags FROM ({SIG}) s"


@query("SELECT count(*) FILTER (verdict <> 'call' AND cleanup = 'suspicious' AND flag_reason LIKE '%mahal%') AS mahal, count(*) FILTER (verdict <> 'call' AND cleanup = 'suspicious' AND flag_reason LIKE '%tag%') AS tag FROM res", res=REASON)
def a7_removed_by_filter(res):
    return metrics.removed_by_filter(res, ["mahal", "tag"])


PER_FLAG = " UNION ALL ".join(f"SELECT '{f}' AS filter, verdict, {f} AS o FROM sig" for f in FLAGS)


@query(
    f"""WITH x AS ({PER_FLAG}), y AS (SELECT filter, count(*) FILTER (verdict = 'call') AS calls, count(*) FILTER (verdict <> 'call') AS fps, count(*) FILTER (verdict = 'call' AND o) AS calls_flagged, count(*) FILTER (verdict <> 'call' AND o) AS fps_flagged FROM x GROUP BY filter)
SELECT *, fps_flagged / fps AS p_flag_fp, calls_flagged / calls AS p_flag_call, (fps_flagged / fps) / (calls_flagged / calls) AS lift, (calls - calls_flagged) / (calls - calls_flagged + fps - fps_flagged) AS precision_if_only FROM y""",
    sig=SIG,
)
def a8_per_filter(sig):
    return metrics.per_filter(sig, FLAGS)


_SETS = [(c, "+".join(FLAGS[i] for i in range(3) if c >> i & 1) or "none", " OR ".join(FLAGS[i] for i in range(3) if c >> i & 1) or "false") for c in range(8)]


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS filters, count(*) FILTER (verdict = 'call' AND NOT ({g})) AS calls_kept, count(*) FILTER (verdict = 'call' AND ({g})) AS calls_lost, count(*) FILTER (verdict <> 'call' AND ({g})) AS fps_removed, count(*) FILTER (NOT ({g})) AS \"left\", count(*) FILTER (verdict = 'call' AND NOT ({g})) / count(*) FILTER (NOT ({g})) AS precision FROM sig" for _, n, g in _SETS),
    sig=SIG,
)
def a9_filter_combinations(sig):
    return metrics.filter_combinations(sig, FLAGS)


@query(
    "WITH k AS (SELECT unnest(range(0, 5)) AS k) SELECT CAST(k AS INT) AS at_least, count(*) FILTER (verdict = 'call' AND NOT (k > 0 AND n_flags >= k)) AS calls_kept, count(*) FILTER (verdict <> 'call' AND k > 0 AND n_flags >= k) AS fps_removed, count(*) FILTER (NOT (k > 0 AND n_flags >= k)) AS \"left\", count(*) FILTER (verdict = 'call' AND NOT (k > 0 AND n_flags >= k)) / count(*) FILTER (NOT (k > 0 AND n_flags >= k)) AS precision FROM res, k GROUP BY k",
    res=REASON,
)
def a10_votes(res):
    return metrics.vote_analysis(res)


@query("SELECT tag_top, count(*) AS n, count(*) FILTER (verdict = 'call') AS calls, count(*) FILTER (verdict <> 'call') AS fps, count(*) FILTER (verdict <> 'call') / count(*) AS fp_share FROM sig GROUP BY tag_top HAVING count(*) >= 5", sig=SIG)
def a11_tag_classes(sig):
    return metrics.tag_classes(sig)


@query("SELECT species, count(*) AS total, count(*) FILTER (n_flags = 0) AS clean, count(*) FILTER (n_flags > 0) AS suspicious, count(*) FILTER (n_flags >= 2) AS strong, count(*) FILTER (flag_invading_cluster) AS invaded FROM res GROUP BY species", res=REASON)
def a12_cleanup_summary(res):
    return metrics.summarize_cleanup(res)


@query(f"SELECT r.recording, d.species, count(d.det_id) AS detections, {m('avg(confidence)', 'mean_confidence')}, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM (SELECT DISTINCT recording FROM recs) r LEFT JOIN (SELECT * FROM det WHERE verdict = 'call') d USING (recording) GROUP BY 1, 2", det=DET, recs=RECS)
def a18_detection_summary(det, recs):
    return metrics.detection_summary(recs, det.where("verdict = 'call'")).withColumn("mean_confidence", micro("mean_confidence"))


@query(f"SELECT species, count(*) AS n, {m('avg(confidence)', 'mean')}, {m('median(confidence)', 'median')}, {m('stddev_samp(confidence)', 'std')}, max(confidence) - min(confidence) AS range FROM det GROUP BY species", det=DET)
def a19_species_profile(det):
    return metrics.species_profile(det).withColumns({c: micro(c) for c in ("mean", "median", "std")})


@query("SELECT species, CAST(least(9, greatest(0, floor(confidence * 10))) AS INT) AS bin, count(*) AS n FROM det GROUP BY 1, 2", det=DET)
def a19_histogram(det):
    return metrics.confidence_histogram(det)


@query("WITH h AS (SELECT DISTINCT species, unnest(range(0, 24)) AS hour FROM det) SELECT h.species, CAST(h.hour AS INT) AS hour, count(det_id) AS n, count(*) FILTER (verdict = 'call') AS calls, count(*) FILTER (verdict = 'false_positive') AS fps, CASE WHEN count(det_id) > 0 THEN count(*) FILTER (verdict = 'call') / count(det_id) END AS precision FROM h LEFT JOIN det d ON d.species = h.species AND extract(hour FROM detected_at) = h.hour GROUP BY 1, 2", det=DET)
def a20_hourly_profile(det):
    return metrics.hourly_profile(det)


SLOT = "time_bucket(INTERVAL 30 MINUTES, detected_at, TIMESTAMP '1970-01-01')"
KM = "sqrt(((a.lat - b.lat) * 110.574) * ((a.lat - b.lat) * 110.574) + ((a.lon - b.lon) * 111.320 * cos(radians((a.lat + b.lat) / 2))) * ((a.lon - b.lon) * 111.320 * cos(radians((a.lat + b.lat) / 2))))"
EXTENTS = f"""WITH s AS (SELECT *, {SLOT} AS slot FROM det), u AS (SELECT DISTINCT species, slot, station, lat, lon FROM s JOIN places USING (station)),
p AS (SELECT a.species, a.slot, max({KM}) AS km FROM u a JOIN u b ON a.species = b.species AND a.slot = b.slot AND a.station < b.station GROUP BY 1, 2),
x AS (SELECT s.species, s.slot, count(*) AS detections, count(DISTINCT station) AS stations FROM s GROUP BY 1, 2)"""


@query(f"{EXTENTS} SELECT x.species, x.slot, detections, stations, {m('coalesce(km, 0)', 'span_km')} FROM x LEFT JOIN p USING (species, slot)", det=DET, places=PLACES)
def a21_slot_extents(det, places):
    return slots.slot_extents(det, places).withColumn("span_km", micro("span_km")).withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query(f"SELECT species, {SLOT} AS slot, count(*) AS detections, count(DISTINCT station) AS stations FROM det GROUP BY 1, 2 ORDER BY detections DESC, species, slot LIMIT 10", det=DET)
def a22_worst_slots(det):
    return slots.worst_slots(det).withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query(f"SELECT recording, count(*) AS windows, max(confidence) AS max, {m('quantile_cont(confidence, 0.99)', 'p99')}, {m('avg(confidence)', 'mean')}, count(*) FILTER (confidence > 0.3) AS above FROM det GROUP BY recording", det=DET)
def a25_probe_summary(det):
    return metrics.probe_summary(det, "confidence").withColumns({c: micro(c) for c in ("p99", "mean")})


@query("SELECT recording, count(*) AS windows, max(confidence) AS best, arg_max(-start_s, (confidence, -start_s)) * -1 AS best_start_s, max(confidence) FILTER (tag_score >= 0.5) AS best_low, arg_max(-start_s, (confidence, -start_s)) FILTER (tag_score >= 0.5) * -1 AS best_low_start_s FROM sig GROUP BY recording", sig=SIG)
def a26_scan_summary(sig):
    return metrics.scan_summary(sig, "confidence", "tag_score", 0.5)


ALL_FOLDS = [f"ST{i:02d}" for i in range(16)] + ["ST99"]
_FOLDS = ", ".join(f"'{f}'" for f in ALL_FOLDS)
STATIONS = "CASE WHEN doc_id % 5 = 0 THEN array[station, 'ST99'] WHEN doc_id % 7 = 0 THEN CAST(array[] AS VARCHAR[]) ELSE array[station] END"


def _may(man: DataFrame) -> DataFrame:
    some = F.when(F.col("doc_id") % 5 == 0, F.array("station", F.lit("ST99"))).when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("station"))
    return man.withColumn("possible_stations", some)


@query(
    f"""WITH x AS (SELECT *, {STATIONS} AS ps FROM man), s AS (SELECT verified, coalesce(u, 'none') AS u FROM (SELECT verified, unnest(CASE WHEN len(ps) = 0 THEN [NULL] ELSE ps END) AS u FROM x))
SELECT 'label' AS kind, label AS value, count(*) AS n, count(*) FILTER (verified) AS verified FROM x GROUP BY 2 UNION ALL SELECT 'source', source, count(*), count(*) FILTER (verified) FROM x GROUP BY 2
UNION ALL SELECT 'station', u, count(*), count(*) FILTER (verified) FROM s GROUP BY 2 UNION ALL SELECT 'ambiguous', array_to_string(ps, ';'), count(*), count(*) FILTER (verified) FROM x WHERE len(ps) > 1 GROUP BY 2""",
    man=MAN,
)
def a27_manifest_report(man):
    return metrics.manifest_report(_may(man))


@query(f"WITH x AS (SELECT *, {STATIONS} AS ps FROM man), f AS (SELECT unnest([{_FOLDS}]) AS fold) SELECT fold, label, count(*) AS n FROM x, f WHERE NOT list_contains(ps, fold) GROUP BY 1, 2", man=MAN)
def a27_fold_pools(man):
    return metrics.fold_pools(_may(man), ALL_FOLDS)


@query("SELECT sum(end_s - start_s) AS seconds FROM (SELECT DISTINCT recording, start_s, end_s FROM det)", det=DET)
def a28_audio_seconds(det):
    return metrics.audio_seconds(det)


@query(f"SELECT regexp_replace(source, '\\d+', '#', 'g') AS source, count(*) AS n, count(*) FILTER (target_score >= 0.8) AS flagged, count(*) FILTER (target_score >= 0.8) / count(*) AS rate, {m('quantile_cont(target_score, 0.5)', 'median')}, {m('quantile_cont(target_score, 0.95)', 'p95')} FROM man GROUP BY 1", man=MAN)
def a29_purity_by_source(man):
    return metrics.purity_by_source(man, 0.8).withColumns({c: micro(c) for c in ("median", "p95")})


PRED = f"SELECT species AS truth, CASE WHEN det_id % 6 = 0 THEN 'other' ELSE species END AS guess, confidence FROM ({DET}) d"


@query(
    f"""WITH c AS (SELECT truth AS class FROM pred UNION SELECT guess FROM pred) SELECT class, count(*) FILTER (truth = class) AS support, count(*) FILTER (guess = class) AS guessed, count(*) FILTER (truth = class AND guess = class) AS hit,
CASE WHEN count(*) FILTER (guess = class) > 0 THEN count(*) FILTER (truth = class AND guess = class) / count(*) FILTER (guess = class) END AS precision, CASE WHEN count(*) FILTER (truth = class) > 0 THEN count(*) FILTER (truth = class AND guess = class) / count(*) FILTER (truth = class) END AS recall,
2 * count(*) FILTER (truth = class AND guess = class) / (count(*) FILTER (truth = class) + count(*) FILTER (guess = class)) AS f1, {m('avg(confidence) FILTER (guess = class)', 'mean_confidence')} FROM pred, c GROUP BY class""",
    pred=PRED,
)
def a30_classification_report(pred):
    return metrics.classification_report(pred).withColumn("mean_confidence", micro("mean_confidence"))


@query("SELECT truth, guess, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY truth) AS share FROM pred GROUP BY 1, 2", pred=PRED)
def a30_confusion_matrix(pred):
    return metrics.confusion_matrix(pred)


@query(
    "WITH k AS (SELECT species, confidence FROM det QUALIFY row_number() OVER (PARTITION BY recording, species, start_s ORDER BY confidence DESC, det_id) = 1), t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold) SELECT threshold, species, count(*) AS n FROM k JOIN t ON confidence >= threshold GROUP BY ALL",
    det=DET,
)
def a31_threshold_counts(det):
    return windows.threshold_counts(det, (0.3, 0.5, 0.7))


@query(
    "WITH l AS (SELECT verdict, 'confidence' AS feature, confidence AS v FROM sig UNION ALL SELECT verdict, 'mahalanobis_d2', mahalanobis_d2 FROM sig) SELECT verdict, feature, count(v) AS n, "
    + ", ".join(m(f"quantile_cont(v, {q})", n) for q, n in ((0.5, "median"), (0.25, "q25"), (0.75, "q75"))) + " FROM l GROUP BY 1, 2",
    sig=SIG,
)
def a33_feature_groups(sig):
    return metrics.feature_groups(sig, ["confidence", "mahalanobis_d2"], "verdict").withColumns({c: micro(c) for c in ("median", "q25", "q75")})


@query("WITH c AS (SELECT label, count(*) AS n FROM man GROUP BY label) SELECT label, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c", man=MAN)
def a34_class_weights(man):
    return metrics.class_weights(man)


_CELLS = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat('=', CAST({c} AS VARCHAR)) END" for c in ("content_hash", "doc_id", "label", "path", "source", "station", "verified"))


@query(
    f"WITH h AS (SELECT CAST('0x' || substr(md5(concat_ws(chr(31), {_CELLS})), 1, 15) AS BIGINT) AS h FROM man) SELECT count(*) AS rows, bit_xor(h) AS xor, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total FROM h",
    man=MAN,
)
def a35_fingerprint(man):
    return metrics.table_fingerprint(man.drop("target_score"))


@query(f"WITH f AS (SELECT station, count(*) AS n, count(*) FILTER (verdict = 'call') / count(*) AS p FROM det GROUP BY station) SELECT 'precision' AS metric, {m('sum(p * n) / sum(n)', 'pooled')}, {m('avg(p)', 'macro')}, count(*) AS folds FROM f", det=DET)
def a36_fold_summary(det):
    f = det.groupBy("station").agg(F.count("*").alias("n"), (F.count_if(F.col("verdict") == "call") / F.count("*")).alias("precision"))
    return metrics.fold_summary(f, ["precision"], "n").withColumns({c: micro(c) for c in ("pooled", "macro")})


# Joins.
@query(
    """WITH o AS (SELECT * FROM (VALUES (0, 0), (1, -1), (2, 1)) t(p, o)), c AS (SELECT r.det_id AS review_id, f.det_id AS found_id, p FROM det r JOIN det2 f ON r.species = f.species AND r.recording = f.recording JOIN o ON CAST(round_even(f.start_s, 0) AS BIGINT) = CAST(round_even(r.start_s, 0) AS BIGINT) + o)
, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY p, found_id) = 1) SELECT r.det_id AS review_id, b.found_id AS det_id FROM det r LEFT JOIN b ON b.review_id = r.det_id""",
    det=DET, det2=DET2,
)
def j1_match_review(det, det2):
    return matching.match_review(det.withColumnRenamed("det_id", "review_id"), det2, keep=()).select("review_id", "det_id")


@query(
    "WITH b AS (SELECT d.det_id, abs(d.start_s - r.start_s) AS gap_s, r.start_s AS near_start_s, r.verdict FROM det2 d JOIN det r ON r.recording = d.recording AND abs(d.start_s - r.start_s) <= 3 QUALIFY row_number() OVER (PARTITION BY d.det_id ORDER BY gap_s, near_start_s, r.verdict) = 1) SELECT d.det_id, b.gap_s, b.near_start_s, b.verdict FROM det2 d LEFT JOIN b USING (det_id)",
    det=DET, det2=DET2,
)
def j3_match_nearest(det, det2):
    return matching.match_nearest(det2, det).select("det_id", "gap_s", "near_start_s", "verdict")


@query(
    """WITH r AS (SELECT * FROM det), b AS (SELECT d.det_id, r.recording, r.start_s FROM det2 d LEFT JOIN r ON r.recording = d.recording AND abs(d.start_s - r.start_s) <= 3 QUALIFY row_number() OVER (PARTITION BY d.det_id ORDER BY abs(d.start_s - r.start_s), r.start_s) = 1), k AS (SELECT DISTINCT recording, start_s FROM b WHERE start_s IS NOT NULL), x AS (SELECT r.verdict, k.start_s IS NOT NULL AS hit FROM r LEFT JOIN k USING (recording, start_s))
SELECT count(*) FILTER (hit AND verdict = 'call') AS calls_kept, count(*) FILTER (hit AND verdict <> 'call') AS fps_kept, count(*) FILTER (NOT hit AND verdict = 'call') AS calls_lost, count(*) FILTER (NOT hit AND verdict <> 'call') AS fps_lost, (SELECT count(*) FROM b WHERE start_s IS NULL) AS new_ground FROM x""",
    det=DET, det2=DET2,
)
def j3_detection_changes(det, det2):
    return matching.detection_changes(det2, det)


def _calls(det: DataFrame) -> DataFrame:
    return det.where("verdict = 'call'").withColumn("call_id", F.col("det_id")).withColumn("end_s", F.when(F.col("det_id") % 2 == 0, F.col("end_s")))


WILSON = "(({k} / {n} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}))", "(1.96 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 3.8416 / (4 * {n} * {n})) / (1 + 3.8416 / {n}))"
_K, _N = "count(*) FILTER (hit)", "count(*)"
_C, _H = (w.format(k=_K, n=_N) for w in WILSON)


@query(
    f"""WITH c AS (SELECT det_id, station, recording, species, start_s, start_s + 2 AS end_s FROM det WHERE verdict = 'call'), h AS (SELECT DISTINCT c.det_id FROM c JOIN det2 w ON w.recording = c.recording AND w.species = c.species AND least(c.end_s, w.end_s) - greatest(c.start_s, w.start_s) >= 0.5), x AS (SELECT c.station, h.det_id IS NOT NULL AS hit FROM c LEFT JOIN h USING (det_id))
SELECT coalesce(station, 'ALL') AS station, {_N} AS calls, {_K} AS detected, {_K} / {_N} AS recall, {m(f'greatest(0, {_C} - {_H})', 'low')}, {m(f'least(1, {_C} + {_H})', 'high')} FROM x GROUP BY ROLLUP (station)""",
    det=DET, det2=DET2,
)
def j4_m3_recall(det, det2):
    return matching.recall(_calls(det), det2).withColumns({c: micro(c) for c in ("low", "high")})


@query("SELECT det_id FROM det c WHERE verdict <> 'call' AND NOT EXISTS (SELECT 1 FROM det2 w WHERE w.verdict = 'call' AND w.recording = c.recording AND least(c.end_s, w.end_s) - greatest(c.start_s, w.start_s) > 0)", det=DET, det2=DET2)
def j5_no_overlap(det, det2):
    return matching.overlapping(det.where("verdict <> 'call'").withColumn("call_id", F.col("det_id")), det2.where("verdict = 'call'"), 0.0, ("recording",), strict=True, anti=True).select("det_id")


@query("SELECT det_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM det2 j WHERE j.verdict = 'call' AND j.recording = d.recording AND abs(j.start_s - d.start_s) < 4)", det=DET, det2=DET2)
def j6_guard_distance(det, det2):
    return matching.away_from(det.withColumn("draw_id", F.col("det_id")), det2.where("verdict = 'call'")).select("det_id")


@query(
    """WITH r AS (SELECT recording, CAST(round_even(start_s, 0) AS BIGINT) AS sec, CASE WHEN count(DISTINCT verdict) = 1 THEN min(verdict) END AS v FROM det2 GROUP BY 1, 2)
SELECT det_id, CASE WHEN r.v = 'call' THEN species WHEN r.v = 'false_positive' THEN 'Background' ELSE 'auto' END AS label, r.v IS NOT NULL AS verified FROM det d LEFT JOIN r ON r.recording = d.recording AND r.sec = CAST(round_even(d.start_s, 0) AS BIGINT)""",
    det=DET, det2=DET2,
)
def j7_apply_review(det, det2):
    return matching.apply_review(det.drop("verdict").withColumn("label", F.lit("auto")), det2).select("det_id", "label", "verified")


@query("SELECT det_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM det2 r WHERE r.recording = d.recording AND round_even(r.start_s, 0) = round_even(d.start_s, 0))", det=DET, det2=DET2)
def j8_unreviewed(det, det2):
    return matching.unreviewed(det, det2).select("det_id")


@query(det=DET)
def j2_s9_latest_labels(det):
    log = det.select(F.concat_ws(":", "recording", "species").alias("clip_id"), F.col("verdict").alias("label"), F.col("det_id").alias("seq"))
    clips = det.select(F.concat_ws(":", "recording", "species").alias("clip_id")).distinct()
    return matching.join_labels(clips, matching.latest_labels(log))


SQL["j2_s9_latest_labels"] = f"WITH det AS ({plain(DET)}) SELECT concat(recording, ':', species) AS clip_id, verdict AS label, det_id AS seq FROM det QUALIFY row_number() OVER (PARTITION BY recording, species ORDER BY det_id DESC) = 1"


@query("SELECT count(*) AS n, count(*) FILTER (p IS NULL) AS missing, min(CASE WHEN p IS NULL THEN det_id END) AS example FROM (SELECT d.det_id, r.path AS p FROM det d LEFT JOIN (SELECT * FROM recs WHERE station <> 'ST03') r USING (recording))", det=DET, recs=RECS)
def j17_attach_audio(det, recs):
    return quality.missing_report(matching.attach_audio(det, recs.where("station <> 'ST03'")), "path", "det_id")


@query(
    """WITH a AS (SELECT path, label, station, source FROM man WHERE doc_id % 10 <> 3), b AS (SELECT path, CASE WHEN doc_id % 8 = 0 THEN 'xx' ELSE label END AS label, station, source FROM man WHERE doc_id % 10 <> 4), j AS (SELECT coalesce(a.path, b.path) AS path, a.path AS ap, b.path AS bp, a.label AS al, b.label AS bl FROM a FULL JOIN b ON a.path = b.path)
SELECT kind, count(*) AS n, min(path) AS example FROM (SELECT path, CASE WHEN bp IS NULL THEN 'only_in_manifest' WHEN ap IS NULL THEN 'only_in_index' WHEN al IS DISTINCT FROM bl THEN 'differs_in_label' END AS kind FROM j) WHERE kind IS NOT NULL GROUP BY kind""",
    man=MAN,
)
def j15_reconcile(man):
    other = man.where("doc_id % 10 <> 4").withColumn("label", F.when(F.col("doc_id") % 8 == 0, "xx").otherwise(F.col("label")))
    return matching.reconcile(man.where("doc_id % 10 <> 3"), other, keys=("path",))


@query("SELECT CAST(round(lat * 10) AS BIGINT) AS coords, list_sort(list(DISTINCT station)) AS stations FROM places GROUP BY 1", places=PLACES)
def j16_coordinate_stations(places):
    return matching.coordinate_stations(places.withColumn("coords", F.round(F.col("lat") * 10).cast("bigint")))


@query(f"WITH a AS (SELECT station, count(*) FILTER (verdict = 'call') / count(*) AS p FROM det GROUP BY 1), b AS (SELECT station, count(*) FILTER (verdict = 'call') / count(*) AS p FROM det2 GROUP BY 1) SELECT count(*) AS n, {m('avg(a.p)', 'p_a')}, {m('avg(b.p)', 'p_b')}, {m('avg(b.p - a.p)', 'p_delta')} FROM a JOIN b USING (station)", det=DET, det2=DET2)
def j18_compare_arms(det, det2):
    p = lambda d: d.groupBy("station").agg((F.count_if(F.col("verdict") == "call") / F.count("*")).alias("p"))
    return matching.compare_arms(p(det), p(det2), "station", ("p",)).withColumns({c: micro(c) for c in ("p_a", "p_b", "p_delta")})


@query("SELECT recording FROM det WHERE verdict = 'call' INTERSECT SELECT recording FROM det WHERE verdict <> 'call'", det=DET)
def j19_u6_shared_groups(det):
    return matching.shared_groups(det.where("verdict = 'call'"), det.where("verdict <> 'call'"), "recording")


@query("SELECT *, 'left' AS side FROM (SELECT recording, species FROM det EXCEPT ALL SELECT recording, species FROM det2) UNION ALL SELECT *, 'right' FROM (SELECT recording, species FROM det2 EXCEPT ALL SELECT recording, species FROM det)", det=DET, det2=DET2)
def u3_multiset_difference(det, det2):
    return matching.multiset_difference(det.select("recording", "species"), det2.select("recording", "species"))


# Gates.
@query("SELECT det_id FROM det WHERE species <> 'click' AND confidence >= 0.5", det=DET)
def f1_confident(det):
    return det.transform(gates.confident(0.5, "click")).select("det_id")


@query("SELECT recording FROM recs WHERE extract(hour FROM started_at) * 60 + extract(minute FROM started_at) BETWEEN 0 AND 360", recs=RECS)
def f2_recordings_between(recs):
    return recs.transform(gates.recordings_between("00:00", "06:00")).select("recording")


@query("SELECT det_id FROM det WHERE extract(hour FROM detected_at) * 60 + extract(minute FROM detected_at) >= 1140 OR extract(hour FROM detected_at) * 60 + extract(minute FROM detected_at) <= 300", det=DET)
def f3_wrap_midnight(det):
    return det.transform(gates.recordings_between("19:00", "05:00", "detected_at")).select("det_id")


@query("SELECT det_id FROM det WHERE extract(hour FROM detected_at) + extract(minute FROM detected_at) / 60 >= 5 AND extract(hour FROM detected_at) + extract(minute FROM detected_at) / 60 < 19", det=DET)
def f4_time_gate(det):
    return det.transform(gates.time_gate(5, 19)).select("det_id")


@query("SELECT det_id FROM sig WHERE species <> 'click' OR mahalanobis_d2 IS NULL OR mahalanobis_d2 >= 40", sig=SIG)
def f5_low_frequency_gate(sig):
    return sig.transform(gates.low_frequency_gate("click", 40.0, "mahalanobis_d2")).select("det_id")


@query("WITH c AS (SELECT species, quantile_cont(mahalanobis_d2, 0.9) AS q FROM sig GROUP BY species) SELECT det_id FROM sig JOIN c USING (species) WHERE mahalanobis_d2 IS NULL OR mahalanobis_d2 <= q", sig=SIG)
def f6_a24_distance_gate(sig):
    cut = vectors.class_cutoffs(sig, "species", "mahalanobis_d2")
    return sig.transform(gates.distance_gate(cut, 90, distance="mahalanobis_d2")).select("det_id")


@query(f"WITH s AS (SELECT *, {SLOT} AS slot FROM det), n AS (SELECT species, slot, count(DISTINCT station) AS slot_stations FROM s GROUP BY 1, 2) SELECT det_id, slot_stations, slot_stations < 4 OR extract(hour FROM detected_at) IN (5, 6) AS keep FROM s JOIN n USING (species, slot)", det=DET)
def f7_w12_array_wide(det):
    return gates.array_wide(det, chorus=((5, 7),)).select("det_id", "slot_stations", "keep")


@query("SELECT det_id, n_neighbours < 2 AS flag_isolated FROM sig", sig=SIG)
def f8_isolated(sig):
    return sig.drop("n_neighbours", "flag_isolated").transform(neighbours.flag_isolated()).select("det_id", "flag_isolated")


@query("WITH c AS (SELECT species, quantile_cont(mahalanobis_d2, 0.95) AS q FROM sig GROUP BY species) SELECT det_id, coalesce(mahalanobis_d2 > q, false) AS flag_mahal FROM sig JOIN c USING (species)", sig=SIG)
def f9_distance_flag(sig):
    return sig.drop("flag_mahal").transform(gates.distance_flag(0.95)).select("det_id", "flag_mahal")


@query("SELECT det_id, tag_top IN ('tag1', 'tag4') AS flag_tag FROM sig", sig=SIG)
def f10_tag_flag(sig):
    return sig.drop("flag_tag").transform(gates.tag_flag(["tag1", "tag4"])).select("det_id", "flag_tag")


@query("SELECT path, label = 'en' AND target_score >= 0.9 AND source IN ('src1', 'src2', 'src3') AND verified IS NOT NULL AND NOT verified AS dropped, label = 'en' AND target_score >= 0.9 AND NOT (source IN ('src1', 'src2', 'src3') AND verified IS NOT NULL AND NOT verified) AS spared FROM man", man=MAN)
def f12_hot_negatives(man):
    return gates.drop_hot_negatives(man.drop("target_score"), man.select("path", "target_score"), 0.9, ["src1", "src2", "src3"], "en").select("path", "dropped", "spared")


@query("SELECT path FROM man WHERE NOT (label IN ('de') AND source LIKE 'src1%' AND NOT coalesce(verified, false))", man=MAN)
def f13_drop_dumps(man):
    return man.withColumn("folder", F.col("label")).transform(gates.drop_dumps(["de"], "src1")).select("path")


@query("SELECT det_id FROM det WHERE species <> 'click' AND confidence BETWEEN 0.3 AND 0.6 ORDER BY recording, start_s, det_id LIMIT 50", det=DET)
def f14_mine_medium(det):
    return gates.mine_medium(det, 0.3, 0.6, 50, "click").select("det_id")


@query("SELECT det_id, CASE WHEN r.recording IS NULL THEN 'source_missing' WHEN confidence >= 0.5 AND (mahalanobis_d2 IS NULL OR mahalanobis_d2 >= 40) THEN 'listen' ELSE 'rejected' END AS screen FROM sig s LEFT JOIN (SELECT DISTINCT recording FROM recs WHERE station <> 'ST03') r USING (recording)", sig=SIG, recs=RECS)
def f15_screen(sig, recs):
    rows = sig.withColumn("score", F.col("confidence")).withColumn("low_freq_ratio", F.col("mahalanobis_d2"))
    return gates.screen_candidates(rows, recs.where("station <> 'ST03'"), 0.5, 40.0).select("det_id", "screen")


@query("SELECT station, count(*) AS n FROM det WHERE station NOT IN ('ST01', 'ST02') GROUP BY station", det=DET)
def f16_exclude_stations(det):
    return det.transform(gates.exclude_stations(["ST01", "ST02"])).groupBy("station").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT det_id, coalesce(knn_dist <= 3 AND mahalanobis_d2 >= 40, false) AS h, station FROM sig) SELECT det_id, h AND avg(CAST(h AS INT)) OVER (PARTITION BY station) >= 0.1 AS flag_recurrent FROM h", sig=SIG)
def f17_gated_recurrence(sig):
    return sig.transform(gates.gated_recurrence(3.0, 40.0, 0.1)).select("det_id", "flag_recurrent")


@query("SELECT det_id, CASE WHEN flag_mahal THEN 'mahal' WHEN flag_tag THEN 'tag' WHEN flag_isolated THEN 'isolated' ELSE 'invading_cluster' END AS primary_reason FROM res WHERE n_flags >= 2 OR flag_invading_cluster", res=REASON)
def f18_hard_negatives(res):
    return gates.hard_negatives(res).select("det_id", "primary_reason")


@query("SELECT d.det_id FROM det d JOIN (SELECT recording, max(confidence) AS t FROM det GROUP BY 1) m USING (recording) WHERE confidence >= t * 0.5 AND confidence >= 0.0001", det=DET)
def f20_loud_windows(det):
    rows = det.withColumn("rms", F.col("confidence")).withColumn("peak", F.col("confidence"))
    return rows.transform(gates.loud_windows(6.020599913279624)).select("det_id")


@query("SELECT det_id, n_flags, flag_reason FROM res", res=REASON)
def p15_merge_flags(res):
    return res.drop("n_flags", "flag_reason").transform(gates.merge_flags()).select("det_id", "n_flags", "flag_reason")


# Parsing and scores.
CLIPS = f"SELECT det_id, concat(species, '__', recording, '__', lpad(CAST(CAST(start_s AS INT) AS STRING), 5, '0'), 's__conf0.', CAST(det_id % 10 AS STRING), '.wav') AS name, concat('/data/SITE', CAST(det_id % 20 AS STRING), 'ST/x/', species, '/', station) AS dir, station, recording, species, start_s FROM ({DET}) d"


@query("SELECT det_id, species, recording, CAST(start_s AS INT) AS start, CAST(det_id % 10 AS DOUBLE) / 10 AS conf FROM clips", clips=CLIPS)
def p1_clip_names(clips):
    n = F.col("name")
    return clips.select("det_id", parse.clip_species(n).alias("species"), parse.clip_recording(n).alias("recording"), parse.clip_start(n).alias("start"), parse.clip_confidence(n).alias("conf"))


@query("SELECT det_id, concat('SITE', CAST(det_id % 20 AS VARCHAR), 'ST') AS station, station AS site, species FROM clips", clips=CLIPS)
def p5_p8_paths(clips):
    return clips.select("det_id", parse.station_from_path(F.col("dir"), "SITE").alias("station"), parse.site_from_indir(F.col("dir")).alias("site"), parse.species_from_indir(F.col("dir"), F.col("name")).alias("species"))


@query("SELECT det_id, concat(species, '__', recording) AS grp, regexp_replace(name, '\\.wav$', '') AS stem FROM clips", clips=CLIPS)
def p6_p7_groups(clips):
    return clips.select("det_id", parse.source_group(F.col("name")).alias("grp"), parse.recording_stem(F.col("name")).alias("stem"))


@query("SELECT det_id, CASE WHEN det_id % 4 = 0 THEN 'unreviewed' WHEN det_id % 4 IN (1, 2) THEN 'false_positive' ELSE 'call' END AS verdict FROM det", det=DET)
def p9_verdicts(det):
    tag = F.when(F.col("det_id") % 4 == 0, " ").when(F.col("det_id") % 4 == 1, "Noise ").when(F.col("det_id") % 4 == 2, "BIRD").otherwise("pyow")
    return det.select("det_id", parse.verdict(tag, False).alias("verdict"))


@query("SELECT det_id, strftime(detected_at, '%Y%m%dT%H%M%S') AS stamp, date_trunc('second', detected_at) + to_seconds(CAST(start_s AS BIGINT)) AS detected_at, strftime(detected_at, '%Y-%m') AS period FROM det", det=DET)
def p2_p3_p17_times(det):
    stamp = F.date_format("detected_at", "yyyyMMdd'T'HHmmss")
    name = F.concat(F.lit("S"), stamp, F.lit("123+0100_x.wav"))
    return det.select("det_id", stamp.alias("stamp"), parse.detected_at(parse.recording_start(name), F.col("start_s")).alias("detected_at"), parse.period(name).alias("period"))


VEC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings}"
VEC_SPARK = "SELECT vec_id, label, CAST(embedding AS array<double>) AS v FROM {embeddings}"


@query(vec=VEC_SPARK)
def p11_p12_scores(vec):
    p = scores.softmax(F.slice("v", 1, 5))
    g = scores.group_scores(F.col("p"), ((0, 1), (2,), (3, 4)))
    rows = vec.select("vec_id", p.alias("p")).withColumn("g", g)
    return rows.select("vec_id", scores.top_group(F.col("g"), ("a", "b", "Background")).alias("species"), micro(F.array_max("g")).alias("confidence"), micro(scores.margin(F.col("p"))).alias("margin"), micro(scores.entropy(F.col("p"))).alias("entropy"))


SQL["p11_p12_scores"] = f"""WITH vec AS ({plain(VEC)}), e AS (SELECT vec_id, [exp(x - list_max(v[1:5])) for x in v[1:5]] AS e FROM vec), p AS (SELECT vec_id, [x / list_sum(e) for x in e] AS p FROM e), g AS (SELECT vec_id, p, [p[1] + p[2], p[3], p[4] + p[5]] AS g, list_sort(p, 'DESC') AS s FROM p)
SELECT vec_id, ['a', 'b', 'Background'][list_position(g, list_max(g))] AS species, {m('list_max(g)', 'confidence')}, {m('s[1] - s[2]', 'margin')}, {m('-list_sum([x * ln(greatest(x, 1e-12)) for x in p])', 'entropy')} FROM g"""


@query(vec=VEC_SPARK)
def p13_a23_mahalanobis(vec):
    stats = vectors.class_statistics(vec, "label", "v")
    return vectors.with_distance(vec, stats, "v", "label").select("vec_id", micro("mahalanobis_d2").alias("d2"))


@query(vec=VEC_SPARK)
def j12_knn_distance(vec):
    return neighbours.knn_distance(vec.withColumnRenamed("vec_id", "det_id"), 5, ("label",), "v").select("det_id", F.floor(F.col("knn_dist") * 1e4 + 0.5).cast("bigint").alias("d"))


SQL["j12_knn_distance"] = f"""WITH vec AS ({plain(VEC)}), d AS (SELECT a.vec_id AS det_id, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id), k AS (SELECT det_id, d FROM d QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY d) = 5)
SELECT vec.vec_id AS det_id, CAST(floor(k.d * 1e4 + 0.5) AS BIGINT) AS d FROM vec LEFT JOIN k ON k.det_id = vec.vec_id"""


# Search.
CUTS = "SELECT DISTINCT unnest(quantile_cont(CAST({0} AS DOUBLE), [{1}])) AS cut FROM {2}"


def cuts_sql(col: str, n: int, table: str) -> str:
    return CUTS.format(col, ", ".join(repr(q) for q in search.quantiles(n)), table)


def tally_sql(gone: str, table: str, by: str) -> str:
    return f"SELECT {by}, count(*) FILTER (verdict = 'call' AND NOT ({gone})) AS calls_kept, count(*) FILTER (verdict = 'call' AND ({gone})) AS calls_lost, count(*) FILTER (verdict <> 'call' AND ({gone})) AS fps_removed, count(*) FILTER (NOT ({gone})) AS \"left\", CASE WHEN count(*) FILTER (NOT ({gone})) > 0 THEN count(*) FILTER (verdict = 'call' AND NOT ({gone})) / count(*) FILTER (NOT ({gone})) END AS precision FROM {table} GROUP BY ALL"


OUT = ("calls_kept", "calls_lost", "fps_removed", "left")


@query(f"WITH c AS ({cuts_sql('mahalanobis_d2', 15, 'sig')}), t AS ({tally_sql('coalesce(mahalanobis_d2 >= cut, false)', 'sig, c', 'cut')}) SELECT * REPLACE ({m('cut', 'cut')}) FROM t", sig=SIG)
def l1_signal_sweep(sig):
    return search.sweep(sig, "mahalanobis_d2").select(micro("cut").alias("cut"), *long(*OUT), "precision")


@query(f"WITH c AS (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS cut) {tally_sql('flag_mahal OR (flag_tag AND tag_score >= cut)', 'sig, c', 'cut')}", sig=SIG)
def l3_tag_sweep(sig):
    return search.tag_score_sweep(sig, F.col("flag_mahal"), "flag_tag", "tag_score", (0.2, 0.5, 0.8)).select("cut", *long(*OUT), "precision")


@query(
    f"""WITH dc AS ({cuts_sql('mahalanobis_d2', 12, 'sig')} UNION ALL SELECT NULL), nc AS (SELECT DISTINCT floor(cut) AS cut FROM ({cuts_sql('n_neighbours', 12, 'sig')}) UNION ALL SELECT NULL), g AS (SELECT dc.cut AS distance_cut, nc.cut AS neighbour_cut FROM dc, nc),
t AS ({tally_sql('coalesce(mahalanobis_d2 >= distance_cut, false) OR coalesce(n_neighbours <= neighbour_cut, false)', 'sig, g', 'distance_cut, neighbour_cut')})
SELECT * REPLACE ({m('distance_cut', 'distance_cut')}) FROM t WHERE calls_kept >= 0.95 * (calls_kept + calls_lost) ORDER BY precision DESC, calls_kept DESC, distance_cut DESC NULLS FIRST, neighbour_cut DESC NULLS FIRST LIMIT 12""",
    sig=SIG,
)
def l2_optimize(sig):
    return search.optimize_thresholds(sig).select(micro("distance_cut").alias("distance_cut"), "neighbour_cut", *long(*OUT), "precision")


@query(
    f"""WITH h AS (SELECT station, CASE WHEN dense_rank() OVER (ORDER BY station) % 2 = 1 THEN 'tuned' ELSE 'held_out' END AS part FROM (SELECT DISTINCT station FROM sig)), c AS ({cuts_sql('confidence', 25, 'sig')}), x AS (SELECT * FROM sig JOIN h USING (station)), t AS ({tally_sql('confidence <= cut', 'x, c', 'part, cut')}),
b AS (SELECT cut FROM t WHERE part = 'tuned' AND calls_kept >= 0.6 * (calls_kept + calls_lost) ORDER BY coalesce(precision, 0) DESC, cut LIMIT 1) SELECT * REPLACE ({m('cut', 'cut')}) FROM t WHERE cut = (SELECT cut FROM b)""",
    sig=SIG,
)
def l4_station_holdout(sig):
    return search.station_holdout(sig, "confidence").select("part", micro("cut").alias("cut"), *long(*OUT), "precision")


LOSO = """, ok AS (SELECT * FROM t WHERE NOT own AND calls_kept >= {0} * (calls_kept + calls_lost)), pick AS (SELECT fold, cut FROM ok QUALIFY row_number() OVER (PARTITION BY fold ORDER BY coalesce(precision, 0) DESC, cut) = 1), o AS (SELECT t.fold, t.calls_kept, t.calls_lost, t.fps_removed, t."left", t.cut FROM t JOIN pick USING (fold, cut) WHERE own),
u AS (SELECT * FROM o UNION ALL SELECT 'POOLED', sum(calls_kept), sum(calls_lost), sum(fps_removed), sum("left"), NULL FROM o) SELECT fold, CAST(calls_kept AS BIGINT) AS calls_kept, CAST(calls_lost AS BIGINT) AS calls_lost, CAST(fps_removed AS BIGINT) AS fps_removed, CAST("left" AS BIGINT) AS "left", {1}, calls_kept / "left" AS precision FROM u"""


@query(
    f"""WITH f AS (SELECT DISTINCT station AS fold FROM sig), c AS (SELECT DISTINCT fold, unnest(list_concat([min(confidence) - 1], quantile_cont(confidence, [{', '.join(repr(q) for q in search.quantiles(25))}]))) AS cut FROM sig, f WHERE station <> fold GROUP BY fold),
x AS (SELECT sig.*, c.fold, c.cut, station = fold AS own FROM sig, c), t AS ({tally_sql('confidence <= cut', 'x', 'fold, own, cut')})""" + LOSO.format(0.9, m("cut", "cut")),
    sig=SIG,
)
def l5_station_cv(sig):
    return search.station_cv(sig, "confidence").select("fold", *long(*OUT), micro("cut").alias("cut"), "precision")


_L6 = (
    f"WITH f AS (SELECT DISTINCT station AS fold FROM sig), c AS (SELECT CAST(unnest(range(-1, 10)) AS DOUBLE) AS cut), x AS (SELECT sig.*, fold, cut, station = fold AS own FROM sig, f, c), t AS ({tally_sql('flag_invading_cluster OR n_neighbours <= cut', 'x', 'fold, own, cut')})"
    + LOSO.format(0.9, "cut, (SELECT bool_or(flag_invading_cluster) FROM sig WHERE station = fold) AS invaded")
    + """ UNION ALL SELECT 'UNCLEANED', count(*) FILTER (verdict = 'call'), 0, 0, count(*) FILTER (verdict IN ('call', 'false_positive')), NULL, NULL, count(*) FILTER (verdict = 'call') / count(*) FILTER (verdict IN ('call', 'false_positive')) FROM sig"""
)


@query(_L6, sig=SIG)
def l6_two_protocol_cv(sig):
    return search.two_protocol_cv(sig).select("fold", *long(*OUT), "cut", "invaded", "precision")


def ap_sql(order: str, name: str, share: float = 0.5) -> str:
    """``station, name, ap, of_ceiling`` of reviewing each station in an order."""
    return f"""SELECT station, '{name}' AS name, avg(cum / pos) FILTER (hit = 1) AS ap, CASE WHEN least(sum(hit), round_even(count(*) * {share}, 0)) > 0 THEN coalesce(sum(hit) FILTER (pos <= round_even(n * {share}, 0)), 0) / least(sum(hit), round_even(count(*) * {share}, 0)) END AS of_ceiling
 FROM (SELECT station, CASE WHEN verdict = 'call' THEN 1 ELSE 0 END AS hit, row_number() OVER w AS pos, sum(CASE WHEN verdict = 'call' THEN 1 ELSE 0 END) OVER w AS cum, count(*) OVER (PARTITION BY station) AS n FROM scored WINDOW w AS (PARTITION BY station ORDER BY {order})) GROUP BY station"""


#: Orders in which a missing signal ties at the top, as in the rank score.
_ORDERS = {"confidence": "confidence DESC NULLS FIRST, det_id", "n_neighbours": "n_neighbours DESC NULLS FIRST, det_id", "mahalanobis_d2": "mahalanobis_d2 ASC NULLS FIRST, det_id"}
_BOTH = f"({RANK.format('confidence', 'ASC')} + {RANK.format('n_neighbours', 'ASC')}) / 2"
_CM = f"({RANK.format('confidence', 'ASC')} + {RANK.format('mahalanobis_d2', 'DESC')}) / 2"
SCORED = f"WITH scored AS (SELECT *, {SCORE} AS score, {_BOTH} AS both, {_CM} AS far FROM sig)"

_FOLD_Q = ", ".join(repr(q) for q in search.quantiles(25))


@query(
    f"""WITH f AS (SELECT DISTINCT station AS fold FROM sig), q AS (SELECT fold, list_concat([min(knn_dist) - 1], quantile_cont(knn_dist, [{_FOLD_Q}])) AS c, list_concat([NULL], quantile_cont(mahalanobis_d2, [0.5, 0.7, 0.8, 0.9])) AS l FROM sig, f WHERE station <> fold GROUP BY fold),
g AS (SELECT DISTINCT fold, cut, least FROM (SELECT fold, unnest(c) AS cut, l FROM q) t, unnest(t.l) AS u(least)),
p AS (SELECT fold, station, cut, least, station = fold AS own, count(*) AS n, count(*) FILTER (h) AS hits, count(*) FILTER (verdict = 'call') AS calls, count(*) FILTER (verdict <> 'call') AS fps, count(*) FILTER (h AND verdict = 'call') AS hc, count(*) FILTER (h AND verdict <> 'call') AS hf
 FROM (SELECT sig.*, g.*, coalesce(knn_dist <= cut AND (least IS NULL OR mahalanobis_d2 >= least), false) AS h FROM sig, g) GROUP BY ALL),
a AS (SELECT *, CASE WHEN hits >= 0.25 * n THEN hc ELSE 0 END AS calls_lost, CASE WHEN hits >= 0.25 * n THEN hf ELSE 0 END AS fps_removed FROM p), b AS (SELECT *, calls - calls_lost AS calls_kept, calls - calls_lost + fps - fps_removed AS "left" FROM a),
t AS (SELECT fold, cut, least, sum(calls_kept) AS k, sum(calls_lost) AS x, sum("left") AS z FROM b WHERE NOT own GROUP BY ALL HAVING min(CASE WHEN calls_kept >= 0.9 * calls THEN 1 ELSE 0 END) = 1 AND sum(calls_kept) >= 0.9 * (sum(calls_kept) + sum(calls_lost))),
pick AS (SELECT fold, cut, least FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN z > 0 THEN k / z ELSE 0 END DESC, cut, least NULLS FIRST) = 1),
o AS (SELECT b.fold, calls_kept, calls_lost, fps_removed, "left" FROM b JOIN pick ON b.fold = pick.fold AND b.cut = pick.cut AND b.least IS NOT DISTINCT FROM pick.least WHERE own),
u AS (SELECT * FROM o UNION ALL SELECT 'POOLED', sum(calls_kept), sum(calls_lost), sum(fps_removed), sum("left") FROM o) SELECT fold, CAST(calls_kept AS BIGINT) AS calls_kept, CAST(calls_lost AS BIGINT) AS calls_lost, CAST(fps_removed AS BIGINT) AS fps_removed, CAST("left" AS BIGINT) AS "left", calls_kept / "left" AS precision FROM u""",
    sig=SIG,
)
def l7_gated_recurrence_cv(sig):
    return search.gated_recurrence_cv(sig).select("fold", *long(*OUT), "precision")


_L8 = ", ".join(repr(q) for q in search.quantiles(12))
_I8 = ", ".join(str(i) for i in range(1, 13))


@query(
    f"""WITH s AS (SELECT signal, up, row_number() OVER (PARTITION BY signal ORDER BY i) AS i, cut FROM (SELECT 'confidence' AS signal, 1 AS up, unnest(quantile_cont(CAST(confidence AS DOUBLE), [{_L8}])) AS cut, unnest([{_I8}]) AS i FROM sig
 UNION ALL SELECT 'n_neighbours', 1, unnest(quantile_cont(CAST(n_neighbours AS DOUBLE), [{_L8}])), unnest([{_I8}]) FROM sig UNION ALL SELECT 'mahalanobis_d2', 0, unnest(quantile_cont(CAST(mahalanobis_d2 AS DOUBLE), [{_L8}])), unnest([{_I8}]) FROM sig)),
n AS (SELECT *, concat(signal, CASE WHEN up = 1 THEN ' low ' ELSE ' high ' END, format('{{:.4g}}', cut)) AS name, CASE signal WHEN 'confidence' THEN 1 WHEN 'n_neighbours' THEN 2 ELSE 3 END AS o FROM s),
v AS (SELECT n.*, sig.det_id, sig.verdict, coalesce(CASE signal WHEN 'confidence' THEN confidence <= cut WHEN 'n_neighbours' THEN n_neighbours <= cut ELSE mahalanobis_d2 >= cut END, false) AS gone FROM sig, n),
k AS (SELECT name AS configuration, count(*) FILTER (NOT gone AND verdict = 'call') AS calls_kept, count(*) FILTER (NOT gone) AS "left" FROM v GROUP BY o, i, name
 UNION ALL SELECT concat(a.name, ' OR ', b.name), count(*) FILTER (NOT (a.gone OR b.gone) AND a.verdict = 'call'), count(*) FILTER (NOT (a.gone OR b.gone)) FROM v a JOIN v b ON a.det_id = b.det_id AND a.o < b.o GROUP BY a.o, a.i, a.name, b.o, b.i, b.name),
f AS (SELECT unnest([0.99, 0.97, 0.95, 0.9, 0.85])::DOUBLE AS keep)
SELECT keep, configuration, calls_kept, "left", calls_kept / "left" AS precision FROM k, f WHERE "left" > 0 AND calls_kept >= keep * (SELECT count(*) FROM sig WHERE verdict = 'call') QUALIFY row_number() OVER (PARTITION BY keep ORDER BY calls_kept / "left" DESC, configuration) = 1""",
    sig=SIG,
)
def l8_operating_points(sig):
    return search.operating_points(sig, {"confidence": True, "n_neighbours": True, "mahalanobis_d2": False}).select("keep", "configuration", *long("calls_kept", "left"), "precision")


@query(
    f"{SCORED}, a AS ({ap_sql('score DESC, det_id', 'combined')} UNION ALL {' UNION ALL '.join(ap_sql(o, n) for n, o in _ORDERS.items())}) SELECT name AS signals, {m('avg(ap)', 'mean_ap')}, {m('avg(of_ceiling)', 'mean_of_ceiling')} FROM a GROUP BY name",
    sig=SIG,
)
def l9_ranking_comparison(sig):
    return ranking.ranking_comparison(sig).withColumns({c: micro(c) for c in ("mean_ap", "mean_of_ceiling")})


@query(
    f"WITH g AS (SELECT CAST(a AS INT) AS lo, CAST(b AS INT) AS hi FROM range(0, 13) t(a), range(13, 25) u(b)), x AS (SELECT *, extract(hour FROM detected_at) AS h FROM det), t AS ({tally_sql('NOT (h >= lo AND h < hi)', 'x, g', 'lo, hi')}) SELECT lo, hi, calls_kept, \"left\", calls_kept / (calls_kept + calls_lost) AS recall, precision FROM t WHERE calls_kept / (calls_kept + calls_lost) >= 0.7",
    det=DET,
)
def l10_time_gate_grid(det):
    return search.time_gate_grid(det, 0.7).select("lo", "hi", *long("calls_kept", "left"), "recall", "precision")


@query(sig=SIG)
def l11_neighbour_loso(sig):
    return search.neighbour_loso(sig).withColumn("precision", micro("precision"))


SQL["l11_neighbour_loso"] = (
    f"WITH sig AS ({plain(SIG)}), f AS (SELECT DISTINCT station AS fold FROM sig), c AS (SELECT CAST(unnest(range(0, CAST((SELECT max(n_neighbours) + 2 FROM sig) AS BIGINT))) AS DOUBLE) AS cut), x AS (SELECT sig.*, fold, cut, station = fold AS own FROM sig, f, c), t AS ({tally_sql('n_neighbours < cut', 'x', 'fold, own, cut')})"
    + LOSO.format(0.9, "cut").replace('calls_kept / "left" AS precision', m('calls_kept / "left"', "precision")) + f" UNION ALL SELECT 'MACRO', NULL, NULL, NULL, NULL, NULL, {m('avg(calls_kept / "left")', 'p')} FROM o"
)


@query(
    f"WITH c AS (SELECT unnest([{', '.join(repr(x / 20) for x in range(8, 21))}])::DOUBLE AS cut), t AS ({tally_sql('confidence < cut', 'det, c', 'cut')}), r AS (SELECT *, calls_kept / (calls_kept + calls_lost) AS recall, \"left\" - calls_kept AS fps_kept, fps_removed / (fps_removed + \"left\" - calls_kept) AS fps_cut FROM t) SELECT *, coalesce(cut = max(cut) FILTER (recall >= 0.9) OVER (), false) AS suggested FROM r",
    det=DET,
)
def l12_confidence_sweep(det):
    return search.confidence_sweep(det).select("cut", *long(*OUT, "fps_kept"), "precision", "recall", "fps_cut", "suggested")


@query(
    f"SELECT species, verdict, n, CAST(unnest([0, 10, 25, 50, 75, 90, 100]) AS INT) AS percentile, {m('unnest(q)', 'confidence')} FROM (SELECT species, verdict, count(*) AS n, quantile_cont(confidence, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]) AS q FROM det GROUP BY species, verdict)",
    det=DET,
)
def l12_confidence_spread(det):
    return search.confidence_spread(det).select("species", "verdict", "n", "percentile", micro("confidence").alias("confidence"))


@query(
    "WITH v AS (SELECT mahalanobis_d2 AS cut, count(*) FILTER (verdict = 'call') AS p, count(*) FILTER (verdict <> 'call') AS q FROM sig WHERE mahalanobis_d2 IS NOT NULL GROUP BY 1), c AS (SELECT cut, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pp, sum(q) OVER () AS qq FROM v WINDOW w AS (ORDER BY cut DESC)) SELECT cut, (tp / pp + 1 - fp / qq) / 2 AS balanced_accuracy FROM c ORDER BY 2 DESC, cut LIMIT 1",
    sig=SIG,
)
def l13_best_balanced(sig):
    return search.best_balanced(sig, "mahalanobis_d2", F.col("verdict") == "call")


@query("WITH r AS (SELECT station, confidence, row_number() OVER (PARTITION BY station ORDER BY confidence) AS i, count(*) OVER (PARTITION BY station) AS n FROM det WHERE verdict = 'call') SELECT station, confidence AS threshold FROM r WHERE i = floor((1 - 0.95) * n) + 1", det=DET)
def l14_recall_threshold(det):
    return search.recall_threshold(det, "confidence", 0.95, ("station",))


@query(f"WITH x AS (SELECT *, {STATIONS} AS ps FROM man), f AS (SELECT unnest([{_FOLDS}]) AS fold) SELECT fold, CASE WHEN NOT list_contains(ps, fold) THEN 'train' WHEN len(ps) = 1 THEN 'evaluate' ELSE 'left_out' END AS role, count(*) AS n FROM x, f GROUP BY 1, 2", man=MAN)
def l15_fold_masks(man):
    return search.fold_masks(_may(man), ALL_FOLDS).groupBy("fold", "role").agg(F.count("*").alias("n"))


_REST = repr(1 - 0.95)


@query(
    f"""WITH s AS (SELECT DISTINCT station FROM det), o AS (SELECT station, list(confidence ORDER BY confidence) AS v FROM det WHERE verdict = 'call' GROUP BY station), e AS (SELECT s.station, list(confidence ORDER BY confidence) AS v FROM s JOIN det d ON d.station <> s.station WHERE verdict = 'call' GROUP BY s.station),
t AS (SELECT s.station, o.v[CAST(floor({_REST} * len(o.v)) AS BIGINT) + 1] AS matched, e.v[CAST(floor({_REST} * len(e.v)) AS BIGINT) + 1] AS loso FROM s LEFT JOIN o USING (station) LEFT JOIN e USING (station))
SELECT station, count(*) AS detections, count(*) FILTER (verdict = 'call') AS calls, {", ".join(f"count(*) FILTER (verdict = 'call' AND confidence >= {c}) AS {n}_calls, CASE WHEN count(*) FILTER (confidence >= {c}) > 0 THEN count(*) FILTER (verdict = 'call' AND confidence >= {c}) / count(*) FILTER (confidence >= {c}) END AS {n}_precision" for n, c in (("deployed", "0.5"), ("matched", "matched"), ("loso", "loso")))}
FROM det JOIN t USING (station) GROUP BY station""",
    det=DET,
)
def l16_score_folds(det):
    return search.score_folds(det.withColumn("score", F.col("confidence")))


_GATED = ", ".join(
    f"any_value({n}) AS {n}_threshold, CASE WHEN any_value({n}) IS NOT NULL AND count(*) FILTER (verdict = 'call') > 0 THEN count(*) FILTER (verdict = 'call' AND score >= {n}) / count(*) FILTER (verdict = 'call') END AS {n}_calls_retained, "
    f"CASE WHEN any_value({n}) IS NOT NULL AND count(*) FILTER (verdict <> 'call') > 0 THEN 1 - count(*) FILTER (verdict <> 'call' AND score >= {n}) / count(*) FILTER (verdict <> 'call') END AS {n}_fps_removed, "
    f"CASE WHEN count(*) FILTER (score >= {n}) > 0 THEN count(*) FILTER (verdict = 'call' AND score >= {n}) / count(*) FILTER (score >= {n}) END AS {n}_precision"
    for n in ("matched", "loso")
)


@query(
    f"""WITH x AS (SELECT *, confidence AS score FROM det WHERE extract(hour FROM detected_at) >= 5 AND extract(hour FROM detected_at) < 19), s AS (SELECT DISTINCT station FROM x),
o AS (SELECT station, list(score ORDER BY score) AS v FROM x WHERE verdict = 'call' GROUP BY station), e AS (SELECT s.station, list(score ORDER BY score) AS v FROM s JOIN x ON x.station <> s.station WHERE verdict = 'call' GROUP BY s.station),
t AS (SELECT s.station, o.v[CAST(floor({_REST} * len(o.v)) AS BIGINT) + 1] AS matched, e.v[CAST(floor({_REST} * len(e.v)) AS BIGINT) + 1] AS loso FROM s LEFT JOIN o USING (station) LEFT JOIN e USING (station)),
g AS (SELECT station, count(*) AS k, count(*) FILTER (verdict = 'call') / count(*) AS gated_precision, {_GATED} FROM x JOIN t USING (station) GROUP BY station)
SELECT station, coalesce(k, 0) AS gated_detections, g.* EXCLUDE (station, k) FROM (SELECT DISTINCT station FROM det) LEFT JOIN g USING (station)""",
    det=DET,
)
def l16_gated_folds(det):
    return search.gated_folds(det.withColumn("score", F.col("confidence")), parse.hour_fraction(F.col("detected_at")), (5, 19))


_TURNED = {n: o.replace("DESC", "X").replace("ASC", "DESC").replace("X", "ASC") for n, o in _ORDERS.items()}
_TRIES = [(n, up, (_ORDERS if up == (n != "mahalanobis_d2") else _TURNED)[n]) for n in _ORDERS for up in (True, False)]


@query(
    f"WITH scored AS (SELECT * FROM sig), a AS ({' UNION ALL '.join(ap_sql(o, f'{n}:{up}'.lower()) for n, up, o in _TRIES)}) SELECT split_part(name, ':', 1) AS signal, split_part(name, ':', 2) = 'true' AS larger_is_genuine, {m('avg(ap)', 'mean_ap')} FROM a GROUP BY name",
    sig=SIG,
)
def l17_candidates(sig):
    return search.candidates_alone(sig, ("confidence", "n_neighbours", "mahalanobis_d2")).withColumn("mean_ap", micro("mean_ap"))


def draw_sql(seed: int, *keys: str) -> str:
    """sampling.draw()."""
    return f"((CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query(
    f"""{SCORED}, a AS ({ap_sql(_ORDERS['confidence'], 'a')}), b AS ({ap_sql('"both" DESC, det_id', 'b')}), d AS (SELECT a.station, b.ap - a.ap AS delta, row_number() OVER (ORDER BY a.station) - 1 AS i, count(*) OVER () AS m, row_number() OVER (ORDER BY b.ap - a.ap DESC, a.station) AS top FROM a JOIN b USING (station) WHERE b.ap - a.ap IS NOT NULL),
r AS (SELECT round, k, CAST(floor({draw_sql(0, 'round', 'k')} * m) AS BIGINT) AS i FROM (SELECT DISTINCT m FROM d), range(0, 1000) t(round), LATERAL (SELECT unnest(range(1, m + 1)) AS k)), x AS (SELECT round, avg(delta) AS mean FROM r JOIN d USING (i) GROUP BY round), q AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM x)
SELECT count(*) AS stations, {m('avg(delta)', 'mean')}, {m('any_value(low)', 'low')}, {m('any_value(high)', 'high')}, {m('avg(delta) FILTER (top > 2)', 'mean_without_top2')} FROM d, q""",
    sig=SIG,
)
def l19_delta_interval(sig):
    d = search.added_to_baseline(sig, {"confidence": True}, {"n_neighbours": True})
    return search.delta_interval(d).select("stations", *(micro(c).alias(c) for c in ("mean", "low", "high", "mean_without_top2")))


@query(f"WITH c AS (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS cut) SELECT cut, count(*) FILTER (verdict = 'call' AND confidence >= cut) / count(*) FILTER (verdict = 'call') AS positives_kept, count(*) FILTER (verdict <> 'call' AND confidence >= cut) / count(*) FILTER (verdict <> 'call') AS negatives_kept FROM det, c GROUP BY cut", det=DET)
def l21_gate_table(det):
    return search.gate_table(det, "confidence", F.col("verdict") == "call", (0.2, 0.4, 0.6))


@query(
    f"""WITH c AS (SELECT 'mahalanobis_d2' AS criterion, 0 AS place, mahalanobis_d2 AS x, confidence, verdict = 'call' AS y FROM sig UNION ALL SELECT 'knn_dist', 1, knn_dist, confidence, verdict = 'call' FROM sig),
v AS (SELECT criterion, place, x, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM c WHERE x IS NOT NULL GROUP BY ALL), w AS (SELECT *, sum(q) OVER (PARTITION BY criterion ORDER BY x) - q AS below FROM v),
u AS (SELECT criterion, sum(p * (below + q / 2)) / (sum(p) * sum(q)) < 0.5 AS low FROM w GROUP BY criterion, place ORDER BY sum(p * (below + q / 2)) / (sum(p) * sum(q)) DESC, place LIMIT 1),
l AS (SELECT criterion, low, quantile_cont(x, [0.1, 0.2, 0.3]) AS up, quantile_cont(x, [0.9, 0.8, 0.7]) AS down FROM c JOIN u USING (criterion) WHERE y GROUP BY criterion, low),
g AS (SELECT criterion, low, cut, k / 10 AS share, CASE WHEN low THEN down[k] ELSE up[k] END AS lim FROM l, (SELECT unnest([0.3, 0.4, 0.5, 0.6])::DOUBLE AS cut), (SELECT unnest([1, 2, 3]) AS k)),
r AS (SELECT g.*, y, coalesce(confidence >= cut AND CASE WHEN low THEN x <= lim ELSE x >= lim END, false) AS pass FROM c JOIN g USING (criterion))
SELECT cut, share, criterion, low, {m('lim', '"limit"')}, count(*) FILTER (y AND pass) / count(*) FILTER (y) AS positives_kept, count(*) FILTER (NOT y AND pass) / count(*) FILTER (NOT y) AS negatives_kept FROM r GROUP BY cut, share, criterion, low, lim""",
    sig=SIG,
)
def l21_gate_grid(sig):
    out = search.gate_grid(sig, "confidence", ["mahalanobis_d2", "knn_dist"], F.col("verdict") == "call", (0.3, 0.4, 0.5, 0.6), (0.1, 0.2, 0.3))
    return out.withColumn("limit", micro("limit"))


_WIDTHS = (5, 10, 15, 30, 60, 120)


@query(
    " UNION ALL ".join(f"SELECT species, slots, too_wide, {w} AS minutes, too_wide / slots AS share FROM ({EXTENTS.replace(SLOT, SLOT.replace('30 MINUTES', f'{w} MINUTES'))} SELECT species, count(*) AS slots, count(*) FILTER (km > 20) AS too_wide FROM x JOIN p USING (species, slot) WHERE stations > 1 GROUP BY species)" for w in _WIDTHS),
    det=DET, places=PLACES,
)
def l22_slot_width_sweep(det, places):
    return slots.slot_width_sweep(det, places, 10.0).select("species", *long("slots", "too_wide"), "minutes", "share")


@query(sig=SIG)
def l23_probe_loso(sig):
    rows = sig.where("mahalanobis_d2 IS NOT NULL").withColumn("positive", F.col("verdict") == "call")
    return probe.probe_loso(rows, ["confidence", "mahalanobis_d2"]).withColumn("auc", micro("auc"))


@query(
    "WITH v AS (SELECT species, confidence, count(*) FILTER (verdict = 'call') AS p, count(*) FILTER (verdict <> 'call') AS q FROM det GROUP BY 1, 2), w AS (SELECT *, sum(q) OVER (PARTITION BY species ORDER BY confidence) - q AS b FROM v) SELECT species, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, sum(p * (b + q / 2)) / (sum(p) * sum(q)) AS auc FROM w GROUP BY species",
    det=DET,
)
def m4_auc(det):
    return metrics.auc(det, "confidence", F.col("verdict") == "call", ("species",)).select("species", *long("positives", "negatives"), "auc")


_WK, _WN = "count(*) FILTER (verdict = 'call')", "count(*)"


@query(f"SELECT station, count(*) AS n, {m(f'greatest(0, {WILSON[0].format(k=_WK, n=_WN)} - {WILSON[1].format(k=_WK, n=_WN)})', 'low')}, {m(f'least(1, {WILSON[0].format(k=_WK, n=_WN)} + {WILSON[1].format(k=_WK, n=_WN)})', 'high')} FROM det GROUP BY station", det=DET)
def m1_wilson(det):
    out = det.groupBy("station").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "call").alias("k"))
    return out.select("station", "n", micro(intervals.wilson_low(F.col("k"), F.col("n"))).alias("low"), micro(intervals.wilson_high(F.col("k"), F.col("n"))).alias("high"))


@query("WITH d AS (SELECT station, count(*) FILTER (verdict = 'call') / 50 AS per_hour FROM det GROUP BY station) SELECT station, CAST(ceil(3.8416 * 0.9 * (1 - 0.9) / (0.05 * 0.05)) AS BIGINT) AS calls, CAST(ceil(ceil(3.8416 * 0.9 * (1 - 0.9) / (0.05 * 0.05)) / (per_hour * 300.0 / 3600)) AS BIGINT) AS segments FROM d", det=DET)
def m2_budget(det):
    d = det.groupBy("station").agg((F.count_if(F.col("verdict") == "call") / 50).alias("per_hour"))
    calls = intervals.calls_needed(F.lit(0.9), F.lit(0.05))
    return d.select("station", calls.cast("bigint").alias("calls"), intervals.segments_needed(calls, F.col("per_hour"), F.lit(300.0)).cast("bigint").alias("segments"))


@query(
    "WITH k AS (SELECT CAST(count(*) FILTER (flag_tag) AS INT) AS k FROM sig), l AS (SELECT *, row_number() OVER (ORDER BY confidence NULLS FIRST, det_id) AS i FROM sig), a AS (SELECT k.k AS removed, count(*) FILTER (verdict = 'call' AND NOT flag_tag) / count(*) FILTER (NOT flag_tag) AS rule_precision, count(*) FILTER (verdict = 'call' AND i > k.k) / count(*) FILTER (i > k.k) AS baseline_precision FROM l, k GROUP BY k.k) SELECT *, rule_precision - baseline_precision AS advantage FROM a",
    sig=SIG,
)
def t1_confidence_baseline(sig):
    return search.confidence_baseline(sig, F.col("flag_tag"))


@query("WITH n AS (SELECT CAST(floor(count(*) * 0.25) AS INT) AS k FROM det) SELECT k AS kept, (SELECT confidence FROM det ORDER BY confidence DESC, det_id LIMIT 1 OFFSET (SELECT k - 1 FROM n)) AS threshold FROM n", det=DET)
def t2_suggest_threshold(det):
    return search.suggest_threshold(det, 0.25)


@query("SELECT recording, count(*) AS n FROM det GROUP BY 1 ORDER BY n DESC, recording LIMIT 10", det=DET)
def t3_top_recordings(det):
    return det.groupBy("recording").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "recording").limit(10)


# Sampling.
@query(
    f"""WITH l AS (SELECT * FROM recs WHERE duration_s >= 300), q AS (SELECT station, floor(40 / count(*) OVER ()) + CASE WHEN row_number() OVER (ORDER BY station) <= 40 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT station FROM l)),
g AS (SELECT station, recording, (duration_s - floor(duration_s / 300) * 300) * {draw_sql(0, 'recording')} AS off, unnest(range(0, CAST(floor(duration_s / 300) AS BIGINT))) AS n FROM l), u AS (SELECT *, {draw_sql(1, 'recording', 'n')} AS u FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY u, recording, n) AS r FROM u)
SELECT r.station, recording, off + n * 300 AS start_s, off + n * 300 + 300 AS end_s, 0 AS seed FROM r JOIN q USING (station) WHERE r <= quota""",
    recs=RECS,
)
def r1_plan_segments(recs):
    return sampling.plan_segments(recs, 40, 300.0)


@query(
    f"WITH b AS (SELECT det_id, species, CASE WHEN confidence >= 0.6 THEN 2 WHEN confidence >= 0.3 THEN 1 ELSE 0 END AS band, count(*) OVER (PARTITION BY species) AS n FROM det) SELECT det_id, species, band FROM b QUALIFY row_number() OVER (PARTITION BY species, band ORDER BY {draw_sql(0, 'det_id')}, det_id) <= 5 OR n <= 3",
    det=DET,
)
def r3_confidence_bands(det):
    return sampling.by_confidence_band(det, (0.3, 0.6), 5, 3).select("det_id", "species", "band")


@query(
    f"""WITH s AS (SELECT det_id, confidence, least(99, floor(confidence * 100)) AS slice, {draw_sql(0, 'det_id')} AS u, {draw_sql(1, 'det_id')} AS w FROM det WHERE confidence IS NOT NULL), a AS (SELECT det_id FROM s QUALIFY row_number() OVER (PARTITION BY slice ORDER BY u, det_id) = 1),
b AS (SELECT det_id FROM s WHERE confidence >= (SELECT quantile_cont(confidence, 0.95) FROM s) ORDER BY w, det_id LIMIT 20) SELECT det_id FROM a UNION SELECT det_id FROM b""",
    det=DET,
)
def r4_reliability(det):
    return sampling.reliability_sample(det).select("det_id")


@query(f"SELECT det_id, species FROM det QUALIFY row_number() OVER (PARTITION BY species ORDER BY {draw_sql(0, 'det_id')}, det_id) <= 20", det=DET)
def r5_per_group(det):
    return sampling.per_group(det, ["species"], 20, "det_id").select("det_id", "species")


@query(
    f"""WITH s AS (SELECT station, recording, duration_s - 2 AS d, sum(duration_s - 2) OVER (PARTITION BY station ORDER BY recording) AS hi, sum(duration_s - 2) OVER (PARTITION BY station) AS whole FROM recs WHERE duration_s > 2), k AS (SELECT DISTINCT station, whole, unnest(range(1, 11)) AS k FROM s), t AS (SELECT station, k, {draw_sql(0, 'station', 'k')} * whole AS t FROM k)
SELECT t.station, s.recording, {m('t - (hi - d)', 'start_s')}, concat(t.station, ':', CAST(k AS VARCHAR)) AS draw_id FROM t JOIN s ON t.station = s.station AND t >= hi - d AND t < hi""",
    recs=RECS,
)
def r6_random_windows(recs):
    return sampling.random_windows(recs, 10).withColumn("start_s", micro("start_s"))


@query(
    f"""WITH g AS (SELECT station, recording, count(*) AS n, {draw_sql(0, 'recording')} AS u FROM det GROUP BY station, recording), w AS (SELECT *, sum(n) OVER (PARTITION BY station ORDER BY u, recording) - n AS before, sum(n) OVER (PARTITION BY station) AS whole, count(*) OVER (PARTITION BY station) AS k FROM g),
p AS (SELECT station, recording, n, CASE WHEN before < 0.2 * whole AND k > 1 AND (before + n < whole OR before = 0) THEN 'validation' ELSE 'train' END AS part FROM w) SELECT station, part, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""",
    det=DET,
)
def r7_grouped_split(det):
    return sampling.grouped_split(det, "recording", "station").groupBy("station", "part").agg(F.count("*").alias("n"))


@query(f"WITH g AS (SELECT recording FROM (SELECT DISTINCT recording FROM det) ORDER BY {draw_sql(0, 'recording')}, recording LIMIT 10) SELECT det_id, recording FROM det JOIN g USING (recording)", det=DET)
def r8_group_sample(det):
    return sampling.group_sample(det, "recording", 10).select("det_id", "recording")


# Checks.
@query("SELECT content_hash, count(DISTINCT source) AS labels, count(*) AS n FROM man GROUP BY 1 HAVING count(DISTINCT source) > 1", man=MAN)
def q5_cross_label(man):
    return quality.cross_label_duplicates(man, "content_hash", "source")


@query("SELECT recording, start_s, count(DISTINCT verdict) AS verdicts, count(*) AS n FROM det GROUP BY 1, 2 HAVING count(DISTINCT verdict) > 1", det=DET)
def q6_verdict_conflicts(det):
    return quality.verdict_conflicts(det, ["recording", "start_s"])


@query("SELECT content_hash, count(*) AS n FROM man GROUP BY 1 HAVING count(*) > 1", man=MAN)
def q2_duplicates(man):
    return quality.duplicate_keys(man, ["content_hash"])


@query(
    "WITH b AS (SELECT path, CASE WHEN doc_id % 50 = 0 THEN 'blank_label' END AS a, CASE WHEN doc_id % 40 = 0 THEN 'bad_aug' END AS c FROM man), v AS (SELECT path, a AS violation FROM b WHERE a IS NOT NULL UNION ALL SELECT path, c FROM b WHERE c IS NOT NULL) SELECT violation, count(*) AS n FROM v GROUP BY 1",
    man=MAN,
)
def q1_validate_manifest(man):
    bad = man.select("path", "source", F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("label")).alias("label"), F.when(F.col("doc_id") % 40 == 0, "-1").otherwise("3").alias("aug"))
    return quality.validate_manifest(bad).select("violation", "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
