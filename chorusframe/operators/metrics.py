"""Reports on detections, reviews, flags and manifests.  Every table is tidy: one row a group, one column a metric."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import exact_quantiles, running
from .sessions import rolled_up


def is_call() -> Column:
    return F.col("verdict") == "call"


def is_false() -> Column:
    return F.col("verdict") == "false_positive"


def outcome(removed: Column) -> list[Column]:
    """What a rule that removes those rows does: calls kept and lost, false positives removed, what is left and its precision."""
    gone = F.coalesce(removed, F.lit(False))
    kept, left = F.count_if(is_call() & ~gone), F.count_if((is_call() | is_false()) & ~gone)
    n = F.count_if(is_call() | is_false())
    return [
        kept.alias("calls_kept"), F.count_if(is_call() & gone).alias("calls_lost"), F.count_if(is_false() & gone).alias("fps_removed"),
        left.alias("left"), F.try_divide(n - left, n).alias("removed_share"), F.try_divide(kept, left).alias("precision"),
    ]


def summarize_review(review: DataFrame) -> DataFrame:
    """Counts by species and overall (ALL), with precision over what was judged."""
    judged = F.count_if(is_call() | is_false())
    return rolled_up(
        review, "species", F.count("*").alias("detections"), F.count_if(is_call()).alias("confirmed"), F.count_if(is_false()).alias("false_positives"),
        (F.count("*") - judged).alias("unreviewed"), F.count_distinct("station").alias("stations"), F.count_distinct(F.when(F.col("recording") != "", F.col("recording"))).alias("recordings"),
        F.try_divide(F.count_if(is_call()), judged).alias("precision"),
    )


def summarize_labels(labelled: DataFrame) -> DataFrame:
    """Label counts by species and overall, and the share that has one."""
    k = lambda x: F.count_if(F.col("label") == x).alias(x)
    return rolled_up(labelled, "species", F.count("*").alias("clips"), k("call"), k("false_positive"), k("unsure"), F.count_if(F.col("label").isNull()).alias("unlabelled"), (F.count("label") / F.count("*")).alias("progress"))


def station_species(det: DataFrame, species: Sequence[str] | None = None) -> DataFrame:
    """A column of counts for each species, a row for each station."""
    return det.groupBy("station").pivot("species", list(species) if species else None).count().na.fill(0)


def confusion(matched: DataFrame) -> DataFrame:
    return matched.where("cleanup IS NOT NULL").groupBy("verdict").agg(*(F.count_if(F.col("cleanup") == c).alias(c) for c in ("clean", "suspicious")))


def evaluate(matched: DataFrame) -> DataFrame:
    """Cleanup against review, by species and overall; rows without a match count as unmatched only."""
    sus, ok = F.col("cleanup") == "suspicious", F.col("cleanup").isNotNull()
    fp, call = F.count_if(is_false() & ok), F.count_if(is_call() & ok)
    return rolled_up(
        matched, "species", F.count_if(ok).alias("matched"), F.count_if(~ok).alias("unmatched"), call.alias("calls"), fp.alias("fps"),
        F.try_divide(F.count_if(is_false() & sus), fp).alias("fp_removed_share"), F.try_divide(F.count_if(is_call() & ~sus), call).alias("calls_kept_share"),
        F.try_divide(call, call + fp).alias("precision_before"), F.try_divide(F.count_if(is_call() & ~sus), F.count_if((is_call() | is_false()) & ~sus)).alias("precision_after"),
        F.try_divide(F.count_if(sus), F.count_if(ok)).alias("listening_saved"),
    )


def removed_by_filter(matched: DataFrame, names: Sequence[str]) -> DataFrame:
    """False positives removed whose reason names each filter."""
    gone = is_false() & (F.col("cleanup") == "suspicious")
    return matched.agg(*(F.count_if(gone & F.contains(F.lower("flag_reason"), F.lit(n))).alias(n) for n in names))


def per_filter(det: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How much likelier each flag is on a false positive than on a call."""
    long = det.unpivot(["verdict"], list(flags), "filter", "on").withColumn("on", F.coalesce("on", F.lit(False)))
    out = long.groupBy("filter").agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"), F.count_if(is_call() & F.col("on")).alias("calls_flagged"), F.count_if(is_false() & F.col("on")).alias("fps_flagged"))
    out = out.withColumn("p_flag_fp", F.try_divide("fps_flagged", "fps")).withColumn("p_flag_call", F.try_divide("calls_flagged", "calls"))
    left = F.col("calls") - F.col("calls_flagged") + F.col("fps") - F.col("fps_flagged")
    return out.withColumn("lift", F.try_divide("p_flag_fp", "p_flag_call")).withColumn("precision_if_only", F.try_divide(F.col("calls") - F.col("calls_flagged"), left))


def by_flag_mask(det: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Calls and false positives for each combination of flags, as a bit mask: at most 2**len(flags) rows."""
    mask = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    return det.groupBy(mask.alias("mask")).agg(F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))


def filter_combinations(det: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Every subset of the flags, OR-ed: what it removes and the precision left.  The table is read once."""
    sets = [(sum(1 << i for i in c), "+".join(flags[i] for i in c) or "none") for k in range(len(flags) + 1) for c in combinations(range(len(flags)), k)]
    subsets = det.sparkSession.createDataFrame(sets, "subset int, filters string")
    both = F.broadcast(by_flag_mask(det, flags)).crossJoin(subsets)  # 2**flags rows on either side
    hit = F.col("mask").bitwiseAND(F.col("subset")) != 0
    out = both.groupBy("filters").agg(
        F.sum(F.when(hit, 0).otherwise(F.col("calls"))).alias("calls_kept"), F.sum(F.when(hit, F.col("calls")).otherwise(0)).alias("calls_lost"), F.sum(F.when(hit, F.col("fps")).otherwise(0)).alias("fps_removed"),
        F.sum(F.when(hit, 0).otherwise(F.col("calls") + F.col("fps"))).alias("left"),
    )
    return out.withColumn("precision", F.try_divide("calls_kept", "left"))


def vote_analysis(det: DataFrame, n_flags: str = "n_flags", most: int = 4) -> DataFrame:
    """Removing rows that at least k filters flag, for k from 1; k = 0 stands for removing none."""
    per = det.groupBy(F.col(n_flags).alias("_n")).agg(F.count_if(is_call()).alias("c"), F.count_if(is_false()).alias("f"))
    ks = det.sparkSession.createDataFrame([(k,) for k in range(most + 1)], "at_least int")
    gone = (F.col("at_least") > 0) & (F.coalesce("_n", F.lit(0)) >= F.col("at_least"))
    out = F.broadcast(ks).crossJoin(per).groupBy("at_least")  # a row for each number of flags
    out = out.agg(F.sum(F.when(gone, 0).otherwise(F.col("c"))).alias("calls_kept"), F.sum(F.when(gone, F.col("f")).otherwise(0)).alias("fps_removed"), F.sum(F.when(gone, 0).otherwise(F.col("c") + F.col("f"))).alias("left"))
    return out.withColumn("precision", F.try_divide("calls_kept", "left"))


def tag_classes(det: DataFrame, tag: str = "tag_top", min_count: int = 5) -> DataFrame:
    out = det.where(is_call() | is_false()).groupBy(tag).agg(F.count("*").alias("n"), F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))
    return out.where(F.col("n") >= min_count).withColumn("fp_share", F.col("fps") / F.col("n"))


def summarize_cleanup(det: DataFrame) -> DataFrame:
    return det.groupBy("species").agg(
        F.count("*").alias("total"), F.count_if(F.col("n_flags") == 0).alias("clean"), F.count_if(F.col("n_flags") > 0).alias("suspicious"),
        F.count_if(F.col("n_flags") >= 2).alias("strong"), F.count_if(F.coalesce(F.col("flag_invading_cluster"), F.lit(False))).alias("invaded"),
    )


def detection_summary(recordings: DataFrame, det: DataFrame) -> DataFrame:
    """Counts and confidences by recording and species; a recording without detections has one row of zero."""
    per = det.groupBy("recording", "species").agg(F.count("*").alias("detections"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))
    return recordings.select("recording").distinct().join(per, "recording", "left").withColumn("detections", F.coalesce("detections", F.lit(0)))


def species_profile(det: DataFrame) -> DataFrame:
    v = F.col("confidence")
    out = det.groupBy("species").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (F.max(v) - F.min(v)).alias("range"))
    return _with_quantiles(out, exact_quantiles(det, v, [0.5], ["species"]), ["species"]).select("species", "n", "mean", F.col("q")[0].alias("median"), "std", "range")


def _with_quantiles(out: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``q`` by group, null where a group has no value."""
    on = F.lit(True)
    for c in by:
        on = on & out[c].eqNullSafe(F.col(f"_of_{c}"))
    return out.join(found.select("q", *(F.col(c).alias(f"_of_{c}") for c in by)), on, "left")


def confidence_histogram(det: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins over 0..1, the last one closed."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("confidence") * bins))).cast("int")
    return det.where("confidence IS NOT NULL").groupBy("species", b.alias("bin")).agg(F.count("*").alias("n"))


def hourly_profile(det: DataFrame) -> DataFrame:
    """Detections and precision for each species and hour, hours without any included."""
    spine = det.select("species").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    per = det.groupBy("species", F.hour("detected_at").alias("hour")).agg(F.count("*").alias("n"), F.count_if(is_call()).alias("calls"), F.count_if(is_false()).alias("fps"))
    out = spine.join(per, ["species", "hour"], "left").na.fill(0, ["n", "calls", "fps"])
    return out.withColumn("precision", F.try_divide(F.col("calls"), F.col("calls") + F.col("fps")))


def probe_summary(windows: DataFrame, score: str = "score", floor: float = 0.3) -> DataFrame:
    v = F.col(score)
    return windows.groupBy("recording").agg(F.count("*").alias("windows"), F.max(v).alias("max"), F.percentile(v, F.lit(0.99)).alias("p99"), F.avg(v).alias("mean"), F.count_if(v > floor).alias("above"))


def scan_summary(windows: DataFrame, score: str, ratio: str, floor: float) -> DataFrame:
    """Each recording's best window, and its best among those with enough low-frequency energy."""
    best = lambda keep: F.max(F.when(keep, F.struct(F.col(score).alias("score"), (-F.col("start_s")).alias("at"))))
    out = windows.groupBy("recording").agg(F.count("*").alias("windows"), best(F.lit(True)).alias("a"), best(F.col(ratio) >= floor).alias("b"))
    return out.select("recording", "windows", F.col("a.score").alias("best"), (-F.col("a.at")).alias("best_start_s"), F.col("b.score").alias("best_low"), (-F.col("b.at")).alias("best_low_start_s"))


def manifest_report(manifest: DataFrame) -> DataFrame:
    """Counts by label, source and station, as ``kind, value, n, verified``; a clip counts for each station it may be from."""
    def by(kind: str, rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.count_if("verified").alias("verified")).select(F.lit(kind).alias("kind"), "*")

    stations = manifest.withColumn("_s", F.explode_outer("possible_stations"))
    ambiguous = manifest.where(F.size("possible_stations") > 1)
    return (
        by("label", manifest, F.col("label")).unionByName(by("source", manifest, F.element_at(F.split("source", "/"), 1)))
        .unionByName(by("station", stations, F.coalesce("_s", F.lit("none")))).unionByName(by("ambiguous", ambiguous, F.concat_ws(";", "possible_stations")))
    )


def fold_pools(manifest: DataFrame, stations: Sequence[str]) -> DataFrame:
    """Clips of each label that a fold may train on: those that cannot be from its station."""
    folds = manifest.sparkSession.createDataFrame([(s,) for s in stations], "fold string")
    free = ~F.array_contains("possible_stations", F.col("fold"))
    return manifest.join(F.broadcast(folds), free).groupBy("fold", "label").agg(F.count("*").alias("n"))  # a row a station


def audio_seconds(segments: DataFrame) -> DataFrame:
    one = segments.select("recording", "start_s", "end_s").dropDuplicates()
    return one.agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))


def purity_by_source(scores: DataFrame, threshold: float) -> DataFrame:
    """Share of each source (numbers folded) that scores as a call."""
    rows = scores.withColumn("source", F.regexp_replace("source", r"\d+", "#"))
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("target_score") >= threshold).alias("flagged"))
    out = _with_quantiles(out, exact_quantiles(rows, "target_score", [0.5, 0.95], ["source"]), ["source"])
    return out.select("source", "n", "flagged", (F.col("flagged") / F.col("n")).alias("rate"), F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def classification_report(pred: DataFrame, truth: str = "truth", guess: str = "guess", score: str = "confidence") -> DataFrame:
    """Precision, recall, F1 and support for each class from predictions."""
    cells = pred.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"), F.sum(score).alias("s"))
    long = cells.select(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.lit(0.0).alias("s"))
    long = long.unionAll(cells.select("g", F.lit(0).cast("bigint"), "n", F.lit(0).cast("bigint"), "s"))
    out = long.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "guessed", "hit", "s")))
    p, r = F.try_divide("hit", "guessed"), F.try_divide("hit", "support")
    return out.select("class", "support", "guessed", "hit", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("hit"), F.col("support") + F.col("guessed")).alias("f1"), F.try_divide("s", "guessed").alias("mean_confidence"))


def confusion_matrix(pred: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Counts of each pair of classes and their share of the true class's rows."""
    cells = pred.groupBy(truth, guess).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def pulse_stats(pulses: DataFrame) -> DataFrame:
    """Width and gap of the pulses of each recording: median and quartile distance, and pulses a second."""
    w = Window.partitionBy("recording").orderBy("start_s")
    p = pulses.withColumn("width", F.col("end_s") - F.col("start_s")).withColumn("gap", F.lead("start_s").over(w) - F.col("end_s"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = p.groupBy("recording").agg(F.count("*").alias("pulses"), q("width").alias("w"), q("gap").alias("g"), (F.max("end_s") - F.min("start_s")).alias("span"))
    return out.select("recording", "pulses", F.col("w")[1].alias("width_median"), (F.col("w")[2] - F.col("w")[0]).alias("width_iqr"), F.col("g")[1].alias("gap_median"), (F.col("g")[2] - F.col("g")[0]).alias("gap_iqr"), F.try_divide("pulses", "span").alias("rate"))


def feature_groups(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Median and quartiles of each feature in each group."""
    long = df.unpivot([group], list(features), "feature", "value")
    out = _with_quantiles(long.groupBy(group, "feature").agg(F.count("value").alias("n")), exact_quantiles(long, "value", [0.25, 0.5, 0.75], [group, "feature"]), [group, "feature"])
    return out.select(group, "feature", "n", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows over classes times the class's rows."""
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return per.crossJoin(whole).select(label, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))  # whole is one row


def table_fingerprint(df: DataFrame) -> DataFrame:
    """An order-free digest of a table: rows, and the xor and sum of 60 bits of their MD5, so that repeated rows count.

    Columns go by name; values are told apart from nulls by a mark in front.
    """
    cells = (F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns))
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))


def fold_summary(folds: DataFrame, metrics: Sequence[str], weight: str) -> DataFrame:
    """Every metric pooled by ``weight`` and as the plain mean over folds."""
    long = folds.unpivot([weight], list(metrics), "metric", "value")
    pooled = F.try_divide(F.sum(F.col("value") * F.col(weight)), F.sum(F.when(F.col("value").isNotNull(), F.col(weight))))
    return long.groupBy("metric").agg(pooled.alias("pooled"), F.avg("value").alias("macro"), F.count("value").alias("folds"))


def auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with ties averaged, from counts by value."""
    per = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_v")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    per = running(per, by, [F.col("_v").asc()], {"_upto": F.col("q")})
    won = per.withColumn("u", F.col("p") * (F.col("_upto") - F.col("q") / 2))
    out = won.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum("u").alias("_u"))
    return out.withColumn("auc", F.try_divide("_u", F.col("positives") * F.col("negatives"))).drop("_u")
