"""Running sums in an order, of tables whose groups may be larger than a task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def spread_by(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in range partitions of the order given, written to the shared folder: adds ``_p``, the partition's number, and ``_m``, which rises in order."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Fixed in the shared folder: all that is made of it must see the same partitions.
    return cut(spread.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Adds to each row the sums, over the rows of its group up to itself, in an order that should be total.

    Rows are range-partitioned by group and order, summed in each partition, and raised by what the group has in earlier
    partitions (a row for each partition and group in it), so that no group is gathered in one task.
    """
    spread = spread_by(df, [*(F.col(c).asc() for c in by), *order])
    local = Window.partitionBy("_p", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spread.select("*", *(F.sum(c).over(local).alias(f"_{n}") for n, c in sums.items()))
    part = spread.groupBy("_p", *by).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("_p").alias("_q"), *(F.col(c).alias(f"_by_{c}") for c in by), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    on = F.col("_p") == F.col("_q")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(part, on).select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums))


def exact_quantiles(df: DataFrame, column: str | Column, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n``, ``q``: the number of values and their linearly interpolated quantiles ``at``, for each group that has a value.

    Counts by value are summed in order over range partitions; the values around each position are then minima over the
    counts that reach it, which combine before they are shuffled.  So no group's values are gathered in one task.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    per = df.select(*by, value.alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    upto = running(per, by, [F.col("_v").asc()], {"_upto": F.col("_n")})
    whole = upto.groupBy(*(F.col(c).alias(f"_of_{c}") for c in by)).agg(F.max("_upto").alias("_all"))  # a row a group
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    both = upto.join(whole, on) if by else upto.join(F.broadcast(whole))  # one row
    place = [F.lit(float(p)) * (F.col("_all") - 1) for p in at]
    reach = [F.min(F.when(F.col("_upto") > end(p), F.col("_v"))).alias(f"_{k}{i}") for i, p in enumerate(place) for k, end in (("a", F.floor), ("b", F.ceil))]
    found = both.groupBy(*by, "_all").agg(*reach) if reach else both.groupBy(*by, "_all").count()

    def between(i: int, p: Column) -> Column:
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    return found.select(*by, F.col("_all").alias("n"), F.array(*(between(i, p) for i, p in enumerate(place))).alias("q"))
