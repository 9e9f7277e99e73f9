"""Quality rules by document and by host: rates of failure, shrunk by an empirical beta prior, decide on whole hosts.

Each rule's failures are counted by host.  Rates of small hosts say little, so a host's rate is the mean of its
posterior under a beta prior whose mean and spread come from all hosts (moments of the beta-binomial, with hosts
weighed by their documents).  A host is rejected where the shrunk rate of some rule exceeds ``limit`` and
``times`` the rate of all documents; the verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, in_slices

SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules over the counts, as SQL that is true where a document fails.  The first two make up ``base_failed``.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
    "lines": "2 * n_dup_lines > n_lines",
}
BASE = ("few_words", "repeats")
LIMIT, TIMES = 0.5, 2.0


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, SPACE).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    repeat = 0
    if len(ids) >= 3:
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        _, place, n = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        again, covered = n[place] > 1, np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeat = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, len(lines)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host`` and COUNTS of each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(it):
            found = np.array([counts(t) for t in byte_column(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *map(pa.array, found.T)], names=["doc_id", "host", *COUNTS])

    return rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def prior(n: float, k: float, hosts: float, squares: float, scatter: float) -> tuple[float, float]:
    """Both parameters of the beta prior of a rule, from sums over hosts of documents n, failures k, n * n and k * k / n."""
    mean = k / n if n else 0.0
    spread = mean * (1 - mean)
    whole = n - squares / n - (hosts - 1) if n else 0.0
    rho = ((scatter - n * mean * mean) / spread - (hosts - 1)) / whole if spread > 0 and whole > 0 else 0.0
    strength = 1 / min(max(rho, 1e-6), 0.999) - 1
    return mean * strength, (1 - mean) * strength


def host_rates(rows: DataFrame, tmp: Scratch, rules: dict[str, str] = RULES, limit: float = LIMIT, times: float = TIMES) -> DataFrame:
    """One row per host: ``host, n_docs``, failures and shrunk rate ``<rule>_rate`` of each rule, ``rejected``."""
    by_host = rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()))
    by_host = tmp.write(by_host)
    sums = [F.sum("n_docs").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("squares")]
    for r in rules:
        sums += [F.sum(r).alias(f"k_{r}"), F.sum(F.col(r).cast("double") * F.col(r) / F.col("n_docs")).alias(f"s_{r}")]
    whole = by_host.agg(*sums).first()  # one row of sums
    rates, bad = [], F.lit(False)
    for r in rules:
        n, k = float(whole["n"] or 0), float(whole[f"k_{r}"] or 0)
        a, b = prior(n, k, whole["hosts"], whole["squares"] or 0.0, whole[f"s_{r}"] or 0.0)
        rate = (F.col(r) + a) / (F.col("n_docs") + a + b)
        rates.append(rate.alias(f"{r}_rate"))
        bad = bad | ((rate > limit) & (rate > times * (k / n if n else 0.0)))
    return by_host.select("*", *rates, bad.alias("rejected"))


def host_rules(docs: DataFrame, rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE, limit: float = LIMIT, times: float = TIMES, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, host``, COUNTS, ``base_failed``, ``host_rejected``, ``kept``.

    A document is kept unless it fails a ``base`` rule or its host is rejected.  Null texts and those without
    words have counts of zero; a null host has no verdict, so its documents pass or fail by themselves; rows that repeat
    a doc_id count each; a single host, or hosts of equal rates, are never rejected; an empty table gives no rows; further
    columns are ignored, whatever their names.  Counts of documents are made once and written; hosts' sums are combined before
    they are shuffled, and only rejected hosts are joined back, by broadcast only below Spark's limit for it.
    """
    tmp = Scratch(docs.sparkSession)
    rows = tmp.write(measured(docs, id_col, text_col, host_col), keep=True)
    rejected = tmp.write(host_rates(rows, tmp, rules, limit, times).where("rejected").select("host", F.lit(True).alias("host_rejected")), keep=True)
    tmp.drop()
    failed = F.lit(False)
    for r in base:
        failed = failed | F.expr(rules[r])
    out = rows.join(rejected, "host", "left").withColumn("base_failed", failed).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select("doc_id", "host", *COUNTS, "base_failed", "host_rejected", (~(F.col("base_failed") | F.col("host_rejected"))).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with their columns, that host_rules keeps; ids must name rows."""
    kept = host_rules(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "host_rejected", "kept")


def _posterior(r: str) -> str:
    return f"({r} + a_{r}) / (n_docs + a_{r} + b_{r})"


def _sql() -> str:
    rules = RULES.items()
    sums = ", ".join(f"sum({r}) AS k_{r}, sum(CAST({r} AS DOUBLE) * {r} / n_docs) AS s_{r}" for r in RULES)
    mean = ", ".join(f"k_{r} / CAST(n AS DOUBLE) AS m_{r}" for r in RULES)
    rho = ", ".join(f"CASE WHEN m_{r} * (1 - m_{r}) > 0 AND n - squares / n - (hosts - 1) > 0 THEN ((s_{r} - n * m_{r} * m_{r}) / (m_{r} * (1 - m_{r})) - (hosts - 1)) / (n - squares / n - (hosts - 1)) ELSE 0.0 END AS r_{r}" for r in RULES)
    beta = ", ".join(f"m_{r} * (1 / least(greatest(r_{r}, 1e-6), 0.999) - 1) AS a_{r}, (1 - m_{r}) * (1 / least(greatest(r_{r}, 1e-6), 0.999) - 1) AS b_{r}" for r in RULES)
    bad = " OR ".join(f"({_posterior(r)} > {LIMIT} AND {_posterior(r)} > {TIMES} * m_{r})" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT id, i, CASE WHEN i + 2 <= len(ws) THEN count(*) OVER (PARTITION BY id, i + 2 <= len(ws), ws[i], ws[i + 1], ws[i + 2]) ELSE 1 END AS c FROM i),
v AS (SELECT id, max(c) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 1 AS covered FROM g),
n AS (SELECT id, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY id),
s AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN n USING (id)),
h AS (SELECT host, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({rule}) AS {name}" for name, rule in rules)} FROM s WHERE host IS NOT NULL GROUP BY host),
q AS (SELECT sum(n_docs) AS n, count(*) AS hosts, sum(CAST(n_docs AS DOUBLE) * n_docs) AS squares, {sums} FROM h),
m AS (SELECT *, {mean} FROM q), r AS (SELECT *, {rho} FROM m), b AS (SELECT *, {beta} FROM r),
x AS (SELECT host FROM h CROSS JOIN b WHERE {bad}),
f AS (SELECT *, {" OR ".join(f"({RULES[r]})" for r in BASE)} AS base_failed, host IS NOT NULL AND host IN (SELECT host FROM x) AS host_rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT (base_failed OR host_rejected) AS kept FROM f
"""


OP13_SQL = _sql()
