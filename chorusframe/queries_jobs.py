"""Registered queries of parsing, sources, manifests and whole jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import parse
from .operators import matching, neighbours, quality, ranking, sampling, selection, slots, windows
from .plans import jobs, manifest
from .queries import _pulses as pulses_of
from .queries import DET, FLAGS, FRAMES, PULSE, DET2, MAN, PLACES, QUEUE, RECS, SIG, SQL, VEC_SPARK, ap_sql, draw_sql, long, m, micro, plain, query
from .sources import readers, sinks

COORD = f"SELECT station, lat, lon, concat('S20210224T0', CAST(floor(lat * 10) AS STRING), '0000_+', CAST(CAST(lat AS DECIMAL(6, 2)) AS STRING), '+', CAST(CAST(lon AS DECIMAL(6, 2)) AS STRING), '.wav') AS name FROM ({PLACES}) p"


@query("SELECT station, CASE WHEN lat > 0 OR lon > 0 THEN lat END AS lat, lon FROM places", places=COORD)
def p4_coordinates(places):
    n = F.col("name")
    return places.select("station", parse.latitude(n).alias("lat"), parse.longitude(n).alias("lon"))


KM = "sqrt(((a.lat - b.lat) * 110.574) * ((a.lat - b.lat) * 110.574) + ((a.lon - b.lon) * 111.320 * cos(radians((a.lat + b.lat) / 2))) * ((a.lon - b.lon) * 111.320 * cos(radians((a.lat + b.lat) / 2))))"


@query(f"SELECT a.station AS one, b.station AS two, {m(KM, 'km')} FROM places a JOIN places b ON a.station < b.station", places=PLACES)
def p14_kilometres(places):
    b = places.select(F.col("station").alias("two"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    far = parse.kilometres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return places.join(b, F.col("station") < F.col("two")).select(F.col("station").alias("one"), "two", micro(far).alias("km"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['SITE7'] WHEN doc_id % 3 = 1 THEN ['s1', 's2'] ELSE CAST([] AS VARCHAR[]) END AS stations, CASE WHEN doc_id % 3 = 0 THEN 'SITE7' ELSE '' END AS station FROM man",
    man=MAN,
)
def p16_possible_stations(man):
    folder = F.when(F.col("doc_id") % 3 == 0, "site7_out").otherwise("other")
    name = F.when(F.col("doc_id") % 3 == 1, "20210224T101010_Marker.wav").otherwise("20220101T101010_Marker.wav")
    s = parse.possible_stations(folder, name, F.array(F.lit("x")), ("s1", "s2"), "Marker", "2021-02", r"(?i)^(site\d+)_")
    return man.select("doc_id", s.alias("stations"), parse.only_station(s).alias("station"))


@query(
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS n, lower(path) AS path FROM man",
    man=MAN,
)
def p18_canonical(man):
    text = F.when(F.col("doc_id") % 3 == 0, " Yes").when(F.col("doc_id") % 3 == 1, "0").otherwise("perhaps")
    number = F.when(F.col("doc_id") % 4 == 0, "-3").otherwise(F.col("doc_id").cast("string"))
    return man.select("doc_id", parse.to_flag(text).alias("flag"), parse.to_count(number).alias("n"), parse.canonical_path(F.upper("path")).alias("path"))


@query("SELECT det_id, format('{}__t{:05d}s__conf0.50.wav', recording, CAST(start_s AS INT)) AS name, greatest(0.0, start_s - 0.5) AS lo, least(1000.0, end_s + 0.5) AS hi, least(start_s, 0.5) AS at FROM det", det=DET)
def p19_p21_clip_bounds(det):
    return det.select(
        "det_id", parse.clip_name(F.col("recording"), F.col("start_s"), F.lit(0.5)).alias("name"), parse.clip_lower(F.col("start_s"), 0.5).alias("lo"),
        parse.clip_upper(F.col("end_s"), F.lit(1000.0), 0.5).alias("hi"), parse.analysis_offset(F.col("start_s"), 0.5).alias("at"),
    )


@query("SELECT det_id, CASE WHEN verdict = 'call' AND cleanup = 'suspicious' THEN 'wrongly_flagged' WHEN verdict <> 'call' AND cleanup = 'clean' THEN 'missed' ELSE 'none' END AS kind FROM sig", sig=SIG)
def p20_disagreement(sig):
    return sig.select("det_id", parse.disagreement(F.col("verdict"), F.col("cleanup")).alias("kind"))


@query("SELECT path, CASE WHEN label = 'es' THEN 'Background' ELSE label END AS label FROM man WHERE label <> 'fr'", man=MAN)
def p22_fold_labels(man):
    return man.select("path", parse.fold_label(F.col("label"), ("fr",), ("es",)).alias("label")).where("label IS NOT NULL")


RAW = f"SELECT concat('/r/', species, '/', station) AS indir, concat(species, '__', recording, '__', lpad(CAST(CAST(start_s AS INT) AS STRING), 5, '0'), 's__conf0.', CAST(det_id % 10 AS STRING), '.wav') AS file, CASE WHEN det_id % 3 = 0 THEN 'Noise' WHEN det_id % 3 = 1 THEN '' ELSE 'pyow' END AS manual_id, det_id, station, recording, species, start_s FROM ({DET}) d"


@query("SELECT file, station, species, recording, CAST(start_s AS INT) AS start_s, manual_id, CASE WHEN det_id % 3 = 0 THEN 'false_positive' ELSE 'call' END AS verdict FROM r", r=RAW)
def s3_review_rows(r):
    return readers.review_rows(r.select("indir", "file", "manual_id")).drop("confidence", "review_id")


@query(
    "WITH a AS (SELECT *, CASE WHEN station IN ('ST00', 'ST01') AND species = 'click' AND cleanup = 'clean' THEN 0 WHEN station IN ('ST02') AND species = 'click' THEN 1 WHEN species = 'view' THEN 2 END AS rule FROM sig) SELECT station, recording, species, start_s, CASE WHEN rule = 0 THEN 1 ELSE 0 END AS label FROM a WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station, recording, species, start_s ORDER BY rule, det_id) = 1",
    sig=SIG,
)
def s5_build_labelled(sig):
    return readers.build_labelled(sig, ["ST00", "ST01"], ["ST02"], "click", ["view"]).select("station", "recording", "species", "start_s", "label")


@query("SELECT concat('/r/', species, '/', station, '/', file) AS path, species, recording, CAST(start_s AS INT) AS start_s, station FROM r", r=RAW)
def s6_clip_catalog(r):
    return readers.catalog_clips(r.select(F.concat_ws("/", "indir", "file").alias("path"))).select("path", "species", "recording", "start_s", "station")


@query(
    f"""{QUEUE} SELECT concat(species, '/', station) AS "INDIR", concat(recording, '__t', lpad(CAST(CAST(start_s AS INT) AS VARCHAR), 5, '0'), 's__conf', printf('%.2f', confidence), '.wav') AS "IN FILE", '' AS "MANUAL ID", queue_no, CAST(episode_no AS BIGINT) AS episode_no, episode_size, listen_first, {m('rank_score', 'rank_score')} FROM queue""",
    sig=SIG,
)
def s12_review_sheet(sig):
    return sinks.review_sheet(ranking.build_queue(sig)).withColumn("rank_score", micro("rank_score"))


@query(
    f"WITH p AS (SELECT concat(indir, '/', file) AS path, species, station, CAST(concat('0.', CAST(det_id % 10 AS VARCHAR)) AS DOUBLE) AS confidence FROM r) SELECT path, species, station, confidence, '' AS verdict, row_number() OVER (ORDER BY {draw_sql(0, 'path')}, path) AS number FROM p",
    r=RAW,
)
def s13_listening_sheet(r):
    return sampling.listening_sheet(r.select(F.concat_ws("/", "indir", "file").alias("path")))


@query("SELECT path, extract(hour FROM h) AS hour FROM man LEFT JOIN (SELECT CAST(det_id AS VARCHAR) AS id, detected_at AS h FROM det) d ON concat(d.id, '.wav') = regexp_extract(path, '([^/]*)$', 1)", man=MAN, det=DET)
def j9_detection_hours(man, det):
    return matching.detection_hours(man, det.withColumn("file", F.concat(F.col("det_id").cast("string"), F.lit(".wav")))).select("path", F.col("hour").cast("bigint").alias("hour"))


def _clips(man: DataFrame) -> DataFrame:
    return man.select("path", "station")


@query("SELECT path, man.station AS station, CASE WHEN verdict = 'call' THEN 'target' ELSE 'Background' END AS label FROM man JOIN det ON det_id = doc_id ", man=MAN, det=DET)
def j10_reviewed_clips(man, det):
    review = det.withColumn("file", F.concat(F.col("det_id").cast("string"), F.lit(".wav")))
    return manifest.reviewed_clips(review, _clips(man), "target").select("path", "station", "label")


@query("SELECT path FROM man WHERE NOT coalesce(verified, false)", man=MAN)
def j11_s15_resume(man):
    return sinks.resume(_clips(man), man.where("verified"), ["path"]).select("path")


@query("SELECT path FROM man WHERE verified AND doc_id % 4 <> 0", man=MAN)
def f19_verified_rows(man):
    index = man.withColumn("ok", F.col("doc_id") % 4 != 0)
    return matching.verified_rows(man, index, ("path",)).select("path")


@query(vec=VEC_SPARK)
def j13_nearest_reference(vec):
    rows = vec.select("vec_id", "label", *(F.get("v", F.lit(i)).alias(f"f{i}") for i in range(3)))
    curated = ranking.keep_first(rows, ["label"], [F.col("vec_id")])  # one example of each label
    near = neighbours.nearest_reference(rows.drop("label"), curated.select("label", "f0", "f1", "f2"), ("f0", "f1", "f2"), "label", "vec_id")
    return near.select("vec_id", "label", "n", micro("nearest").alias("nearest"), micro("median").alias("median"))


_Z = "sqrt(" + " + ".join(f"pow((a.v[{i}] - avg{i}) / sd{i} - (b.v[{i}] - avg{i}) / sd{i}, 2)" for i in (1, 2, 3)) + ")"
SQL["j13_nearest_reference"] = (
    f"WITH vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ref AS (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), s AS (SELECT {', '.join(f'avg(v[{i}]) AS avg{i}, stddev_pop(v[{i}]) AS sd{i}' for i in (1, 2, 3))} FROM ref), d AS (SELECT a.vec_id, b.label, {_Z} AS d FROM vec a, ref b, s) SELECT vec_id, label, count(*) AS n, {m('min(d)', 'nearest')}, {m('median(d)', 'median')} FROM d GROUP BY 1, 2"
)


@query(vec=VEC_SPARK)
def j13_nearest_reference_all(vec):
    """Every component, and every labelled vector as reference."""
    names = tuple(f"f{i}" for i in range(64))
    rows = vec.select("vec_id", "label", *(F.get("v", F.lit(i)).alias(c) for i, c in enumerate(names)))
    near = neighbours.nearest_reference(rows.drop("label"), rows.where("label IS NOT NULL"), names, "label", "vec_id")
    return near.select("vec_id", "label", "n", micro("nearest").alias("nearest"), micro("median").alias("median"))


_ALL = range(1, 65)
SQL["j13_nearest_reference_all"] = (
    f"WITH vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT {', '.join(f'avg(v[{i}]) AS avg{i}, stddev_pop(v[{i}]) AS sd{i}' for i in _ALL)} FROM vec WHERE label IS NOT NULL), z AS (SELECT vec_id, label, [{', '.join(f'(v[{i}] - avg{i}) / CASE WHEN sd{i} > 0 THEN sd{i} ELSE 1 END' for i in _ALL)}] AS z FROM vec, s), d AS (SELECT a.vec_id, b.label, list_distance(a.z, b.z) AS d FROM z a, z b WHERE b.label IS NOT NULL) SELECT vec_id, label, count(*) AS n, {m('min(d)', 'nearest')}, {m('median(d)', 'median')} FROM d GROUP BY 1, 2"
)


@query(f"WITH t AS (SELECT *, time_bucket(INTERVAL 15 MINUTES, detected_at, TIMESTAMP '1970-01-01') AS slot FROM det), u AS (SELECT DISTINCT slot, species, station, lat, lon FROM t JOIN places USING (station)), p AS (SELECT a.slot, a.species, max({KM}) AS km FROM u a JOIN u b ON a.slot = b.slot AND a.species = b.species AND a.station < b.station GROUP BY 1, 2) SELECT species, count(*) AS slots, {m('max(km)', 'widest')} FROM p GROUP BY species", det=DET, places=PLACES)
def j14_station_pairs(det, places):
    e = slots.slot_extents(det, places, 15).where("stations > 1")
    return e.groupBy("species").agg(F.count("*").alias("slots"), micro(F.max("span_km")).alias("widest"))


@query("WITH f AS (SELECT count(*) AS n FROM man) SELECT 'man' AS name, true AS ok FROM f", man=MAN)
def q4_check_lock(man):
    locks = quality.check_lock(man, man.sparkSession.createDataFrame([], "name string, fingerprint string"), "man").select("name", F.col("current").alias("fingerprint"))
    return quality.check_lock(man.repartition(3), locks, "man").select("name", "ok")


@query(
    "WITH l AS (SELECT station, CAST(sum(floor(duration_s / 60)) AS BIGINT) AS n FROM recs WHERE duration_s >= 60 GROUP BY station), q AS (SELECT *, row_number() OVER (ORDER BY station) AS i, count(*) OVER () AS k FROM l) SELECT station, least(n, CAST(floor(80 / k) AS BIGINT) + CASE WHEN i <= 80 % k THEN 1 ELSE 0 END) AS windows FROM q",
    recs=RECS,
)
def r2_annotation_template(recs):
    plan = sampling.plan_segments(recs, 80, 60.0)
    return sampling.annotation_template(plan).groupBy("station").agg(F.count("*").alias("windows"))


@query(man=MAN, det=DET2)
def x7_build_manifest(man, det):
    parts = man.select("path", "label", "station", "source", F.coalesce("verified", F.lit(False)).alias("verified"), F.col("label").alias("species"), F.lit("r").alias("recording"), F.col("doc_id").cast("double").alias("start_s"), "content_hash")
    more = man.select("path", "label", "station", F.lit("dump").alias("source"), F.lit(False).alias("verified"), F.col("label").alias("species"), F.lit("r").alias("recording"), F.col("doc_id").cast("double").alias("start_s"), "content_hash")
    review = det.select(F.lit("r").alias("recording"), F.col("det_id").cast("double").alias("start_s"), "verdict")
    return manifest.build_manifest([parts, more], review, man.select("path", "target_score"), 300, machine=["dump"]).groupBy("label").agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"))


@query(sig=SIG)
def x8_run_cleanup(sig):
    out = jobs.run_cleanup(sig.drop("n_neighbours", "flag_mahal", "flag_tag", "flag_isolated", "flag_invading_cluster"), ["tag1", "tag4"])
    return out.groupBy("station", "n_flags").agg(F.count("*").alias("n"))


SQL["x8_run_cleanup"] = f"""WITH sig AS ({plain(SIG)}), q AS (SELECT species, quantile_cont(mahalanobis_d2, 0.95) AS q FROM sig GROUP BY species),
k AS (SELECT station, det_id, knn_dist AS t, mahalanobis_d2 AS d, row_number() OVER w AS pos, count(*) OVER (PARTITION BY station) AS m, lead(knn_dist) OVER w / greatest(knn_dist, 1e-9) AS r FROM sig WHERE knn_dist IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY knn_dist, det_id)),
c AS (SELECT station, pos AS cluster, r, m FROM k WHERE pos >= greatest(1, floor(m * 0.25)) AND r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station ORDER BY r DESC, pos) = 1),
s AS (SELECT k.station, median(d) FILTER (pos <= cluster) AS cd, median(d) FILTER (pos > cluster) AS rd FROM k JOIN c USING (station) GROUP BY k.station),
inv AS (SELECT c.station, cluster FROM c JOIN s USING (station) WHERE m >= 10 AND r >= 2 AND cluster >= 0.25 * m AND cluster < m AND cd > rd),
x AS (SELECT sig.station, CAST(coalesce(mahalanobis_d2 > q.q, false) AS INT) + CAST(tag_top IN ('tag1', 'tag4') AS INT) + CAST(n_neighbours < 2 AS INT) + CAST(coalesce(k.pos <= inv.cluster, false) AS INT) AS n_flags FROM sig JOIN q USING (species) LEFT JOIN k ON k.det_id = sig.det_id LEFT JOIN inv ON inv.station = sig.station)
SELECT station, n_flags, count(*) AS n FROM x GROUP BY 1, 2"""


_X9 = {
    "evaluation": "SELECT coalesce(species, 'ALL') AS key, count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS unmatched, count(*) FILTER (ok AND c) AS calls, count(*) FILTER (ok AND f) AS fps, count(*) FILTER (f AND s) / count(*) FILTER (ok AND f) AS fp_removed_share, count(*) FILTER (ok AND c AND NOT s) / count(*) FILTER (ok AND c) AS calls_kept_share FROM x GROUP BY ROLLUP (species)",
    "confusion": "SELECT verdict AS key, count(*) FILTER (cleanup = 'clean') AS clean, count(*) FILTER (cleanup = 'suspicious') AS suspicious FROM x WHERE ok GROUP BY verdict",
    "votes": "SELECT CAST(k AS VARCHAR) AS key, count(*) FILTER (c AND NOT (k > 0 AND n >= k)) AS calls_kept, count(*) FILTER (f AND k > 0 AND n >= k) AS fps_removed, count(*) FILTER ((c OR f) AND NOT (k > 0 AND n >= k)) AS \"left\" FROM x, (SELECT unnest(range(0, 4)) AS k) WHERE ok GROUP BY k",
    "tag_classes": "SELECT tag_top AS key, count(*) AS n, count(*) FILTER (c) AS calls, count(*) FILTER (f) AS fps FROM x WHERE ok AND (c OR f) GROUP BY tag_top HAVING count(*) >= 5",
    "sweep_n_neighbours": "SELECT CAST(round(q, 6) AS VARCHAR) AS key, count(*) FILTER (c AND NOT coalesce(n_neighbours <= q, false)) AS calls_kept, count(*) FILTER (f AND coalesce(n_neighbours <= q, false)) AS fps_removed FROM x, (SELECT DISTINCT unnest(quantile_cont(CAST(n_neighbours AS DOUBLE), [" + ", ".join(f"{i}.0 / 16" for i in range(1, 16)) + "])) AS q FROM x WHERE ok) WHERE ok GROUP BY q",
}
_X9_KEYS = {"evaluation": "species", "confusion": "verdict", "votes": "at_least", "tag_classes": "tag_top", "sweep_n_neighbours": "cut"}
_X9_VALUES = {"evaluation": "matched unmatched calls fps fp_removed_share calls_kept_share", "confusion": "clean suspicious", "votes": "calls_kept fps_removed left", "tag_classes": "n calls fps", "sweep_n_neighbours": "calls_kept fps_removed"}


@query(
    f"""WITH o AS (SELECT * FROM (VALUES (0, 0), (1, -1), (2, 1)) t(p, o)), r AS (SELECT * FROM sig WHERE station IS DISTINCT FROM 'ST03'),
m AS (SELECT r.det_id AS review_id, f.det_id, f.cleanup, f.tag_top, f.n_neighbours, {" + ".join(f"CAST(coalesce(f.{x}, false) AS INT)" for x in FLAGS)} AS n FROM r JOIN sig f ON r.species = f.species AND r.recording = f.recording JOIN o ON CAST(round_even(f.start_s, 0) AS BIGINT) = CAST(round_even(r.start_s, 0) AS BIGINT) + o
 QUALIFY row_number() OVER (PARTITION BY r.det_id ORDER BY p, f.det_id) = 1),
x AS (SELECT r.species, r.verdict, m.* EXCLUDE (review_id), m.cleanup IS NOT NULL AS ok, coalesce(r.verdict = 'call', false) AS c, coalesce(r.verdict = 'false_positive', false) AS f, coalesce(m.cleanup = 'suspicious', false) AS s FROM r LEFT JOIN m ON m.review_id = r.det_id)
"""
    + " UNION ALL ".join(f"SELECT '{n}' AS report, key, unnest([{', '.join(repr(v) for v in _X9_VALUES[n].split())}]) AS name, unnest([{', '.join(f'CAST({chr(34)}{v}{chr(34)} AS DOUBLE)' for v in _X9_VALUES[n].split())}]) AS value FROM ({q})" for n, q in _X9.items()),
    sig=SIG,
)
def x9_evaluate_cleanup(sig):
    review = sig.select(F.col("det_id").alias("review_id"), "station", "recording", "species", "start_s", "confidence", "verdict")
    reports = jobs.evaluate_cleanup(review, sig.drop("verdict", "confidence", "station"), FLAGS, exclude=["ST03"], only=list(_X9))
    reports["sweep_n_neighbours"] = reports["sweep_n_neighbours"].withColumn("cut", F.round("cut", 6))
    long_form = [reports[n].select(F.lit(n).alias("report"), F.col(k).cast("string").alias("key"), *(F.col(c).cast("double").alias(c) for c in _X9_VALUES[n].split())).unpivot(["report", "key"], _X9_VALUES[n].split(), "name", "value") for n, k in _X9_KEYS.items()]
    return reduce(DataFrame.unionAll, long_form)


#: The candidates in the order of trial; capitals are the smaller values.
_TRIED = {"n": ("n_neighbours", True), "N": ("n_neighbours", False), "d": ("mahalanobis_d2", True), "D": ("mahalanobis_d2", False), "k": ("knn_dist", True), "K": ("knn_dist", False)}


def _twice_rank(column: str, up: bool) -> str:
    return f"2 * rank() OVER (PARTITION BY station ORDER BY {column} {'ASC' if up else 'DESC'} NULLS LAST) + count(*) OVER (PARTITION BY station, {column}) - 1"


_RANKED = ", ".join(f"{_twice_rank(*of)} AS r{i}" for i, of in enumerate([("confidence", True), *_TRIED.values()]))
_SETS = ["", *_TRIED, *(a + b for a in _TRIED for b in _TRIED if a.lower() < b.lower())]
_SET_AP = " UNION ALL ".join(ap_sql(" + ".join(["r0", *(f"r{[*_TRIED].index(x) + 1}" for x in s)]) + " DESC, det_id", s) for s in _SETS)
_WAYS = [(c, o, c + t, "".join(sorted(c + t, key=str.lower))) for c in ("", *_TRIED) for o, t in enumerate(["", *(t for t in _TRIED if t.lower() != c.lower())])]
_SPELT = {k: f"{n}({'hi' if up else 'lo'})" for k, (n, up) in _TRIED.items()}
_WAY_ROWS = ", ".join(f"('{c}', {o}, '{n}', '{s}', '{', '.join(_SPELT[x] for x in n)}')" for c, o, n, s in _WAYS)


@query(
    f"""WITH scored AS (SELECT *, {_RANKED} FROM sig), a AS ({_SET_AP}), f AS (SELECT DISTINCT station AS fold FROM sig), w(base, place, next, name, label) AS (VALUES {_WAY_ROWS}),
means AS (SELECT fold, name, round(avg(ap), 12) AS mean FROM f JOIN a ON station <> fold GROUP BY ALL),
one AS (SELECT fold, next FROM means JOIN w USING (name) WHERE base = '' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mean DESC NULLS LAST, place) = 1),
two AS (SELECT fold, name, label FROM one JOIN w ON base = one.next JOIN means USING (fold, name) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mean DESC NULLS LAST, place) = 1)
SELECT fold AS station, label AS added, {m('b.ap', 'ap_baseline')}, {m('c.ap', 'ap_with_added')} FROM two JOIN a b ON b.station = fold AND b.name = '' JOIN a c ON c.station = fold AND c.name = two.name""",
    sig=SIG,
)
def l18_holdout_selection(sig):
    chosen = selection.holdout_selection(sig, {"confidence": True}, ["n_neighbours", "mahalanobis_d2", "knn_dist"])
    return chosen.select("station", "added", micro("ap_baseline").alias("ap_baseline"), micro("ap_with_added").alias("ap_with_added"))


@query(
    PULSE
    + f""", g AS (SELECT recording, CAST(unnest(range(0, CAST(greatest(0, floor((duration_s - 30) / 15)) AS BIGINT) + 1)) AS DOUBLE) * 15 AS start_s FROM recs UNION ALL SELECT recording, duration_s - 30 FROM recs WHERE duration_s > 30 AND greatest(0, floor((duration_s - 30) / 15)) * 15 + 30 < duration_s),
v AS (SELECT g.recording, g.start_s, sum(least(g.start_s + 30, p.end_s) - greatest(g.start_s, p.start_s)) / 30 AS share FROM g JOIN pulses p ON g.recording = p.recording AND p.start_s < g.start_s + 30 AND p.end_s > g.start_s GROUP BY ALL)
SELECT g.recording, g.start_s, g.start_s + 30 AS end_s, {m('coalesce(share, 0)', 'voiced_share')} FROM g LEFT JOIN v USING (recording, start_s)""",
    recs=RECS, frames=FRAMES.format(DET),
)
def w19_chunk_windows(recs, frames):
    return windows.chunk_windows(recs, pulses_of(frames), 30.0, 15.0).withColumn("voiced_share", micro("voiced_share"))
