"""Exact ranks and neighbours inside groups of any size, by range splits.

A window partitioned by a group alone sorts a hot group in one task.  Here the rows of a group are cut into *pieces*
along their order, windows run inside a piece, and a table with one row per piece carries results across:

* splitters come from a sample chosen by a hash of the order key, so they are a function of the data: every evaluation
  and every task that runs again sees the same pieces, and nothing has to be checkpointed;
* the sample has some ``SAMPLE`` rows however large the table (its rate follows from one row count), so the splitters are
  a broadcast of bounded size; a group with few sampled rows is one piece;
* a row finds its piece by bisection in its group's sorted splitters, an expression on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows and sampled rows for each splitter.  A piece has some STEP / SAMPLE of the table, a 4096th.
SAMPLE = 65_536
STEP = 16
_DEPTH = SAMPLE.bit_length()


def _bisect(splits: Column, key: Column) -> Column:
    """How many of the sorted splitters are <= key."""
    def halve(bounds: Column, _step: Column) -> Column:
        mid = F.floor((bounds["lo"] + bounds["hi"]) / 2).cast("int")
        go_on, right = bounds["lo"] < bounds["hi"], F.get(splits, mid) <= key
        return F.struct(
            F.when(go_on & right, mid + 1).otherwise(bounds["lo"]).alias("lo"),
            F.when(go_on & ~right, mid).otherwise(bounds["hi"]).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(_DEPTH)), whole, halve, lambda b: b["lo"])
    return F.when(splits.isNull() | (F.size(splits) == 0), F.lit(0)).otherwise(found)


def with_pieces(rows: DataFrame, group: str, order: list[str], sample: int = SAMPLE, step: int = STEP) -> DataFrame:
    """Adds ``piece``: pieces of one group follow each other in ascending ``order``; equal keys share a piece.

    The columns of ``order`` have to tell rows of a group apart for pieces to be small; they may not be null.
    """
    total = rows.count()  # one number: it fixes the sampling rate
    rate = max(1, total // sample)
    key = F.struct(*order)
    drawn = rows.where(F.pmod(F.xxhash64(*order), F.lit(rate)) == 0).select(F.col(group).alias("_g"), key.alias("_k"))
    splits = drawn.groupBy("_g").agg(F.array_sort(F.collect_list("_k")).alias("_s"))
    splits = splits.where(F.size("_s") >= 2 * step).select("_g", F.filter("_s", lambda _x, i: i % step == step - 1).alias("_s"))
    # At most some SAMPLE / STEP keys, whatever the size of the table.
    tagged = rows.join(F.broadcast(splits), F.col(group).eqNullSafe(F.col("_g")), "left")
    return tagged.withColumn("piece", _bisect(F.col("_s"), key)).drop("_g", "_s")


def _running(pieces: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over a group's earlier pieces, from the group's pieces as one array (a group has at most
    SAMPLE / STEP of them)."""
    whole = pieces.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("piece", value))).alias("_p"))
    start = F.array().cast(f"array<struct<piece:int,{out}:bigint,_end:bigint>>")
    sums = F.aggregate("_p", start, lambda done, p: F.concat(done, F.array(F.struct(
        p["piece"].alias("piece"), F.coalesce(F.try_element_at(done, F.lit(-1))["_end"], F.lit(0)).cast("bigint").alias(out),
        (F.coalesce(F.try_element_at(done, F.lit(-1))["_end"], F.lit(0)) + p[value]).cast("bigint").alias("_end")))))
    return whole.select(group, F.inline(F.when(F.size("_p") > 0, sums))).drop("_end")


def group_rank(rows: DataFrame, group: str, order: list[str], rank: str = "rn", descending: bool = True,
               sample: int = SAMPLE, step: int = STEP) -> DataFrame:
    """Adds ``rank``, the row number of each row in its group by ``order`` (all columns in one direction)."""
    pieced = with_pieces(rows, group, order, sample, step)
    counts = pieced.groupBy(group, "piece").agg(F.count(F.lit(1)).alias("_n"))
    if descending:  # pieces ascend: the rows of later pieces come first
        counts = counts.withColumn("piece", -F.col("piece"))
    offsets = _running(counts, group, "_n", "_off")
    if descending:
        offsets = offsets.withColumn("piece", -F.col("piece"))
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inside = pieced.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "piece").orderBy(*direction)))
    offsets = offsets.select(F.col(group).alias("_g"), F.col("piece").alias("_p"), "_off")
    out = inside.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("piece") == F.col("_p")))
    return out.withColumn(rank, F.col("_rn") + F.col("_off")).drop("_g", "_p", "_off", "_rn", "piece")


def group_neighbors(rows: DataFrame, group: str, order: list[str], value: str, sample: int = SAMPLE, step: int = STEP) -> DataFrame:
    """Adds ``older``, ``newer`` (``value`` of the rows before and after in the group's order), ``oldest``, ``newest``
    (of the whole group)."""
    pieced = with_pieces(rows, group, order, sample, step)
    w = Window.partitionBy(group, "piece").orderBy(*order)
    inside = pieced.withColumn("_older", F.lag(value).over(w)).withColumn("_newer", F.lead(value).over(w))
    key = F.struct(*order)
    ends = pieced.groupBy(group, "piece").agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"))
    whole = ends.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("piece", "first", "last"))).alias("_e"))
    e = F.col("_e")
    linked = F.transform(e, lambda p, i: F.struct(
        p["piece"].alias("_p"), F.when(i > 0, F.get(e, i - 1)["last"]).alias("_before"), F.get(e, i + 1)["first"].alias("_after"),
        F.get(e, F.lit(0))["first"].alias("oldest"), F.element_at(e, -1)["last"].alias("newest")))
    links = whole.select(F.col(group).alias("_g"), F.inline(linked))
    out = inside.join(links, F.col(group).eqNullSafe(F.col("_g")) & (F.col("piece") == F.col("_p")))
    return out.withColumn("older", F.coalesce("_older", "_before")).withColumn("newer", F.coalesce("_newer", "_after")).drop(
        "_g", "_p", "_older", "_newer", "_before", "_after", "piece")
