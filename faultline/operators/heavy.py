"""Exact top-k by count over many distinct values (Q10-Q12) without shuffling every value.

Grouping by value sends every distinct value of every task.  Here

1. values are counted by a hash slot (``SLOTS`` a group): no value is more frequent than its slot;
2. the values of the 2 k fullest slots are counted; the k-th of these counts is a bound that the k-th true count reaches;
3. the values of every other slot that reaches the bound are counted, too.  What is left cannot enter the top k.

So the result is exact whatever the distribution, and what is shuffled follows the slots and the frequent values; only
where many values are about as frequent as the k-th (there is no heavy hitter then) all of them are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 16


def _slot(keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def top_counts(rows: DataFrame, keys: list[str], k: int, by: list[str] | None = None, out: str = "event_count", slots: int = SLOTS) -> DataFrame:
    """The k most frequent values of ``keys`` (ties: the smaller value) with their counts; with ``by`` those of each
    group.  Columns: by, keys, out."""
    group = by or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    tagged = rows.select(*group, *keys, _slot(keys, slots).alias("_slot"))
    totals = tagged.groupBy(*group, "_slot").agg(F.count(F.lit(1)).alias("_total"))
    # At most SLOTS rows of a group are ranked.
    fullest = Window.partitionBy(*group).orderBy(F.desc("_total"), "_slot")
    first = totals.withColumn("_r", F.row_number().over(fullest)).where(F.col("_r") <= 2 * k).select(*group, "_slot", "_total")

    def counted(some: DataFrame) -> DataFrame:
        return _same(tagged, some, [*group, "_slot"], "left_semi").groupBy(*group, *keys).agg(F.count(F.lit(1)).alias(out))

    order = Window.partitionBy(*group).orderBy(F.desc(out), *keys)
    top = lambda df: df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    likely = counted(first)
    bound = top(likely).groupBy(*group).agg(F.max("_r").alias("_n"), F.min(out).alias("_least"))
    # Fewer than k values so far: every slot counts.
    bound = bound.select(*group, F.when(F.col("_n") == k, F.col("_least")).otherwise(F.lit(0)).alias("_bound"))
    rest = _same(_same(totals, first, [*group, "_slot"], "left_anti"), bound, group, "inner", ["_bound"]).where(F.col("_total") >= F.col("_bound"))
    both = likely.unionByName(counted(rest.select(*group, "_slot")))
    return top(both).select(*(by or []), *keys, out)


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str, more: list[str] | None = None) -> DataFrame:
    """Join on equal columns, nulls being equal."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *(more or []))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])
