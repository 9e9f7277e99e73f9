"""Detection-like views of the given tables, in SQL that Spark and DuckDB both read.

``det`` maps events to detections; ``sig`` adds signals and flags by arithmetic on the id; ``det2`` is a second run with
some detections gone and the rest moved by up to a second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DET = """
SELECT event_id AS det_id,
       concat('ST', lpad(CAST(user_id % 16 AS STRING), 2, '0')) AS station,
       concat('ST', lpad(CAST(user_id % 16 AS STRING), 2, '0'), '_R', CAST(extract(day FROM ts) % 5 AS STRING)) AS recording,
       event_type AS species,
       CAST((extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + CAST(floor(extract(second FROM ts)) AS INT)) % 1800 AS DOUBLE) AS start_s,
       CAST((extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + CAST(floor(extract(second FROM ts)) AS INT)) % 1800 AS DOUBLE) + 2 AS end_s,
       value / (value + 50.0) AS confidence,
       CASE WHEN value + (event_id * 7919) % 61 > 75 THEN 'call' ELSE 'false_positive' END AS verdict,
       ts AS detected_at
FROM {events}
"""
SIG = f"""
SELECT d.*,
       CAST(count(*) OVER (PARTITION BY station, recording, species ORDER BY start_s RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) - 1 AS BIGINT) AS n_neighbours,
       CASE WHEN det_id % 13 = 0 THEN NULL ELSE CAST((det_id * 7919) % 1000 AS DOUBLE) / 10 END AS mahalanobis_d2,
       CASE WHEN det_id % 17 = 0 THEN NULL ELSE CAST((det_id * 3571) % 500 AS DOUBLE) / 50 + CAST(det_id % 2 AS DOUBLE) * 30 END AS knn_dist,
       CASE WHEN det_id % 11 = 0 THEN NULL WHEN det_id % 7 < 2 THEN 'suspicious' ELSE 'clean' END AS cleanup,
       concat('tag', CAST(det_id % 7 AS STRING)) AS tag_top,
       CAST((det_id * 104729) % 100 AS DOUBLE) / 100 AS tag_score,
       (det_id * 7919) % 1000 > 900 AS flag_mahal, det_id % 7 < 2 AS flag_tag, det_id % 5 = 0 AS flag_isolated, det_id % 19 = 0 AS flag_invading_cluster
FROM ({DET}) d
"""
DET2 = f"SELECT det_id, station, recording, species, start_s + (det_id % 3) - 1 AS start_s, end_s + (det_id % 3) - 1 AS end_s, confidence, verdict, detected_at FROM ({DET}) d WHERE det_id % 3 <> 0"
#: Clips of a manifest from documents and their labels.
MAN = """
SELECT concat(d.source, '/', CAST(d.doc_id AS STRING), '.wav') AS path, d.lang AS label, d.source AS source, l.quality = 1 AS verified,
       concat('ST', lpad(CAST(d.doc_id % 16 AS STRING), 2, '0')) AS station, d.doc_id AS doc_id, md5(d.text) AS content_hash,
       CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS target_score
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
#: A row a station with a position, and recordings with a length.
PLACES = f"SELECT DISTINCT station, CAST(substr(station, 3, 2) AS DOUBLE) / 100 AS lat, 12 + CAST(substr(station, 3, 2) AS DOUBLE) / 50 AS lon FROM ({DET}) d"
RECS = f"SELECT station, recording, CAST(max(start_s) AS DOUBLE) + 2 AS duration_s, concat('/audio/', station, '/', recording, '.wav') AS path, min(detected_at) AS started_at FROM ({DET}) d GROUP BY station, recording"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the Parquet tables that it names in braces."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same text with table names in place of the braces."""
    return sql.format(**{t: t for t in TABLES})
