"""URL rules and link-graph propagation of trust and distrust over hosts, in DataFrame operations only.

Trust is personalised PageRank from trusted seed hosts along host edges; distrust is the same from blocked seed
hosts against the edges (who links to bad hosts is bad).  A host is blocked where its distrust is at least
EVIDENCE times an even share of all distrust and exceeds ``threshold`` times its trust.

Host edges are links (href, src, action, srcset, data, cite; absolute or starting with ``//``, or relative under
a <base> of another host) and mail addresses (an edge to the host that takes the mail).  Names alone make no edge: hosts
below one domain may belong to different owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, ROUNDS, CUT_AFTER, THRESHOLD, EVIDENCE = 0.85, 200, 8, 1.0, 0.75
#: Rounds end when the scores of a kind move by less than this from one written table to the next (after 1, 2, 4, then every CUT_AFTER rounds); edges of a host that share a salt.
TOLERANCE, SALT_EDGES = 1e-3, 100_000
# Possessive runs and segments that end at the next "<" keep every pattern linear in the page.
_LINK = r"""(?i)(?:href|src|action|data|cite|srcset)\s*+=\s*+["']?\s*+((?:[a-z][a-z0-9+.-]*+:)?//[^/?#"'\s>\\]++)"""
_RELATIVE = r"""(?i)(?:href|src|action)\s*+=\s*+["']?\s*+(?![a-z][a-z0-9+.-]*+:|//|#)[^"'\s>]"""
_BASE = r"""(?i)<base\s[^<>]*?href\s*+=\s*+["']?\s*+(?:https?:)?//([^/?#"'\s>]++)"""
_MAIL = r"(?<=[A-Za-z0-9._%+-])@([A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host, path, rule, _verdict``; the longest rule that fits wins."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("_verdict", verdict)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _named(link: Column) -> Column:
    """The host of an absolute link, without user and port."""
    return _lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(link, r"^[^/]*//", ""), r"^.*@", ""), r":[0-9]*$", ""))


def host_edges(pages: DataFrame, tmp: Scratch) -> DataFrame:
    """``src, dst, share``: edges between different hosts, each source's shares adding up to one."""
    html, none = F.col("html"), F.array().cast("array<string>")
    # The patterns run only on pages that hold what they begin with.
    base = _named(F.concat(F.lit("//"), F.regexp_extract("html", _BASE, 1)))
    based = F.when(F.regexp_extract("html", _BASE, 1) != "", F.array_repeat(base, F.regexp_count("html", F.lit(_RELATIVE))))
    absolute = F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), _named)
    mail = F.transform(F.regexp_extract_all("html", F.lit(_MAIL), F.lit(1)), _lower)
    found = pages.where("host <> ''").select(
        F.col("host").alias("src"),
        F.concat(
            F.coalesce(F.when(F.contains(html, F.lit("//")), absolute), none),
            F.coalesce(F.when(html.rlike(r"(?i)<base\s"), based), none),
            F.coalesce(F.when(F.contains(html, F.lit("@")), mail), none),
        ).alias("dst"),
    )
    links = found.select("src", F.explode("dst").alias("dst")).where("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = tmp.write(links)
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagate(edges: DataFrame, seeds: DataFrame, tmp: Scratch, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, kind, score`` from ``seeds(host, kind, seed)``: kind 'trust' follows edges, 'distrust' goes against them.

    The scores of a kind add up to one.  The mass of hosts without edges goes back to the seeds, which only scales the
    scores of a kind, so they are scaled once at the end.  A host's edges are split over salts of SALT_EDGES
    edges each, and its score is sent to each salt.
    """
    into = edges.groupBy("dst").agg(F.sum("share").alias("all"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("share") / F.col("all")).alias("w"))
    moves = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), F.col("share").alias("w")).union(back)
    moves = tmp.write(moves)
    salts = tmp.write(moves.groupBy("kind", "at").agg(F.ceil(F.count("*") / SALT_EDGES).alias("salts")))
    ahead = salts.select("kind", F.col("at").alias("to"), F.col("salts").alias("to_salts"))
    moves = moves.join(salts, ["kind", "at"]).join(ahead, ["kind", "to"], "left").na.fill(1, ["to_salts"])
    moves = tmp.write(moves.select("kind", "at", F.pmod(F.xxhash64("to"), "salts").alias("salt"), "to", "to_salts", "w"))
    start = seeds.select("kind", F.col("host").alias("at"), (F.col("seed") * (1 - damping)).alias("new")).join(salts, ["kind", "at"], "left").na.fill(1, ["salts"])
    score = was = start = tmp.write(start.select("kind", "at", "salts", "new"))
    cut, step = 0, 1
    for k in range(rounds):
        now = score.select("kind", "at", F.col("new").alias("score"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        sent = moves.join(now, ["kind", "at", "salt"]).select("kind", F.col("to").alias("at"), F.col("to_salts").alias("salts"), (F.col("w") * F.col("score") * damping).alias("new"))
        score = sent.union(start).groupBy("kind", "at").agg(F.max("salts").alias("salts"), F.sum("new").alias("new"))
        if k == cut:
            step = min(2 * step, CUT_AFTER)
            cut += step
            score = tmp.write(score)
            both = score.select("kind", "at", "new", F.lit(0.0).alias("old")).union(was.select("kind", "at", F.lit(0.0), "new")).groupBy("kind", "at").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
            moved = both.groupBy("kind").agg(F.sum(F.abs(F.col("new") - F.col("old"))).alias("d"), F.sum("new").alias("n")).collect()
            if all(r["d"] <= tolerance * r["n"] for r in moved):
                break
            was = score
    else:
        raise RuntimeError(f"scores still move by more than {tolerance} after {rounds} rounds")
    whole = score.groupBy("kind").agg(F.sum("new").alias("whole"))
    return score.join(F.broadcast(whole), "kind").select(F.col("at").alias("host"), "kind", (F.col("new") / F.col("whole")).alias("score"))  # two rows


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, evidence: float = EVIDENCE, tolerance: float = TOLERANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` and the host's ``trust`` and ``distrust``.

    A host is a blocked seed if rules block more of its pages than they allow, a trusted one if they allow more; the
    seeds of a kind share one unit of score by that surplus among all their pages.  A rule decides a page that it fits; else the page is
    blocked where its host's distrust is at least ``evidence`` times an even share among the hosts of the pages, and
    exceeds ``threshold`` times its trust.  Null urls and those without
    ``://`` have an empty host, which has no score and is allowed; null html has no links; repeated rows count
    each; an empty table gives no rows; further columns are ignored.
    """
    tmp = Scratch(pages.sparkSession)
    ruled = with_rules(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules)
    hosts = ruled.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", -1).otherwise(0)).alias("bad"))
    hosts = tmp.write(hosts.select("host", F.when(F.col("bad") > 0, "distrust").when(F.col("bad") < 0, "trust").alias("kind"), F.abs("bad").alias("n")))
    named = hosts.where("kind IS NOT NULL")
    seeds = named.join(F.broadcast(named.groupBy("kind").agg(F.sum("n").alias("all"))), "kind").select("host", "kind", (F.col("n") / F.col("all")).alias("seed"))  # two rows
    scores = propagate(tmp.write(host_edges(ruled, tmp)), seeds, tmp, tolerance=tolerance)
    scores = scores.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    least = evidence / max(hosts.count(), 1)
    scores = tmp.write(scores.join(hosts.select("host"), "host", "left_semi"), keep=True)
    tmp.drop()
    out = ruled.drop("html", "url").join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    own = F.when((F.col("distrust") >= least) & (F.col("distrust") > threshold * F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), "trust", "distrust")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
