"""Forward selection of ranking signals with left-out stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .metrics import is_call, is_false
from .prefix import running

DIGITS = 12  # of the means that are compared, so that sets which order all rows alike tie
Signal = tuple[str, bool]


def rank_matrix(det: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``station, det_id, hit`` of the judged rows with ``hi0, lo0, hi1, ...``: twice the rank, ties averaged, of each column in
    both directions.  The largest or the smallest value has the greatest rank; a missing value ties at the top of either.
    Ranks are among all rows of the station, so they hold for every fold.
    """
    values = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))
    per = det.select("station", F.explode(values).alias("x")).groupBy("x.k", "station", "x.v").agg(F.count("*").alias("n"))
    upto = running(per, ["k", "station"], [F.col("v").asc_nulls_last()], {"upto": F.col("n")})
    known = per.where("v IS NOT NULL").groupBy(F.col("k").alias("_k"), F.col("station").alias("_s")).agg(F.sum("n").alias("known"))
    upto = upto.join(known, (F.col("k") == F.col("_k")) & F.col("station").eqNullSafe(F.col("_s")), "left")
    hi = 2 * F.col("upto") - F.col("n") + 1
    ranks = cut(upto.select("k", F.col("station").alias("_s"), F.col("v").alias("_v"), hi.alias("hi"), F.when(F.col("v").isNull(), hi).otherwise(2 * (F.col("known") + 1) - hi).alias("lo")))
    rows = det.where(is_call() | is_false()).select("station", "det_id", is_call().cast("int").alias("hit"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    for k in range(len(columns)):
        r = ranks.where(F.col("k") == k).select("_s", "_v", F.col("hi").alias(f"hi{k}"), F.col("lo").alias(f"lo{k}"))
        rows = rows.join(r, F.col("station").eqNullSafe(F.col("_s")) & F.col(f"v{k}").eqNullSafe(F.col("_v"))).drop("_s", "_v", f"v{k}")
    return rows


def _precisions(matrix: DataFrame, sets: Sequence[frozenset[Signal]], at: dict[str, int]) -> DataFrame:
    """``set, station, ap``: average precision of each set's summed ranks (by det_id where tied) in each station, all in one job."""

    def score(s: frozenset[Signal]) -> Column:
        names = [F.col(f"{'hi' if up else 'lo'}{at[c]}") for c, up in sorted(s)]
        return sum(names[1:], names[0]) if names else F.lit(0).cast("bigint")

    each = F.explode(F.array(*(F.struct(F.lit(i).alias("set"), score(s).alias("score")) for i, s in enumerate(sets))))
    rows = matrix.select("station", "det_id", "hit", each.alias("x")).select("station", "det_id", "hit", "x.set", "x.score")
    placed = running(rows, ["set", "station"], [F.col("score").desc(), F.col("det_id").asc()], {"pos": F.lit(1).cast("bigint"), "cum": F.col("hit")})
    return placed.groupBy("set", "station").agg(F.avg(F.when(F.col("hit") == 1, F.col("cum") / F.col("pos"))).alias("ap"))


def _name(signal: Signal) -> str:
    return f"{signal[0]}({'hi' if signal[1] else 'lo'})"


def holdout_selection(det: DataFrame, baseline: dict[str, bool], candidates: Sequence[str], most: int = 2) -> DataFrame:
    """``station, added, ap_baseline, ap_with_added, delta``: for each left-out station, signals added to the baseline one by one.

    A step adds the candidate, in the direction, that raises the mean average precision over the *other* stations most (of equal
    ones the first candidate named, larger values first), and nothing if none raises it; ``added`` lists them in that order.  The
    station's own average precision shows whether they help where they were not chosen.  It is null without calls, as is ``delta``.

    All sets that any fold asks about in a step are scored in one job as rows (set, station) from ranks made once, and a fold's mean
    is the set's total less its own.  The driver gets the distinct sets chosen, of which there are at most the candidates'
    signed combinations; the query of a step has a term for each set it scores.
    """
    names = [*baseline, *(c for c in dict.fromkeys(candidates) if c not in baseline)]
    at = {c: k for k, c in enumerate(names)}
    tries = [(c, up) for c in names[len(baseline) :] for up in (True, False)]
    spark = det.sparkSession
    matrix = cut(rank_matrix(det.where("station IS NOT NULL"), names))
    start = frozenset(baseline.items())
    state = det.where("station IS NOT NULL").select("station").distinct().withColumn("chosen", F.array().cast("array<int>"))
    for step in range(max(most, 1)):
        chosen = [tuple(r["chosen"]) for r in state.select("chosen").distinct().orderBy("chosen").collect()] or [()]
        sets: dict[frozenset[Signal], int] = {}
        options = []
        for c in chosen:
            used = start | {tries[i] for i in c}
            for order, i in enumerate([None, *(i for i, (name, _) in enumerate(tries) if name not in dict(used))] if most else [None]):
                s = used if i is None else used | {tries[i]}
                options.append((list(c), order, [*c, *([] if i is None else [i])], sets.setdefault(s, len(sets))))
        aps = cut(_precisions(matrix, list(sets), at))
        total = aps.groupBy("set").agg(F.coalesce(F.sum("ap"), F.lit(0.0)).alias("sum"), F.count("ap").alias("n"))
        own = aps.select(F.col("set").alias("_set"), F.col("station").alias("_s"), "ap")
        ways = spark.createDataFrame(options, "chosen array<int>, order int, next array<int>, set int").join(total, "set", "left")
        ways = state.join(ways, "chosen").join(own, (F.col("set") == F.col("_set")) & (F.col("station") == F.col("_s")), "left")
        mean = F.round(F.try_divide(F.col("sum") - F.coalesce("ap", F.lit(0.0)), F.col("n") - F.col("ap").isNotNull().cast("int")), DIGITS)
        first = F.min(F.struct((-mean).isNull().alias("none"), (-mean).alias("mean"), "order", "next", "ap"))
        best = ways.groupBy("station").agg(first.alias("x"), F.max(F.when(F.col("order") == 0, F.col("ap"))).alias("ap_now"))
        before = F.col("ap_now") if step == 0 else F.col("ap_baseline")
        keep = best if step == 0 else best.join(state.select("station", "ap_baseline"), "station")
        state = cut(keep.select("station", F.col("x.next").alias("chosen"), before.alias("ap_baseline"), F.col("x.ap").alias("ap_with_added")))
    label = F.transform("chosen", lambda i: F.get(F.array(*(F.lit(_name(t)) for t in tries)).cast("array<string>"), i))
    return state.select("station", F.array_join(label, ", ").alias("added"), "ap_baseline", "ap_with_added", (F.col("ap_with_added") - F.col("ap_baseline")).alias("delta"))
