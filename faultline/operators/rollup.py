"""Hourly rollup of events with mergeable sketches (Q1, Q2, Q3 over any window).

A rollup row is one (project, issue, hour): event count, first and last event, and a HyperLogLog sketch of the users.  Counts
and times merge by sum, min and max, sketches by union, so the metrics of a window come from its whole hours in the rollup
and from the events of its two cut hours, which are turned into rows of the same shape.  Sketch sizes are fixed
(2^LG_K registers, some 2 kB at most; 1.04 / 2^(LG_K / 2) standard error), whatever the number of users.

Rows of one hour may be appended batch by batch: they merge like any others.  Live events only; events without a user
count, but their user does not.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import columns as X
from faultline.operators import analytics as Q

LG_K = 12
#: Distinct counts are within three standard errors of 1.04 / 2^(LG_K / 2).
USER_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
KEYS = ["pid", "gid", "hour"]


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("events").cast("bigint").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.hll_union_agg("users").alias("users"))


def hourly(events: DataFrame) -> DataFrame:
    """Live events -> rollup rows.  A map task sends one row per (project, issue, hour)."""
    live = events.where(F.col("deleted") == 0)
    # A null user is not counted by the sketch.
    return live.groupBy("pid", "gid", X.trunc_ntz("hour", F.col("created_at")).alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.hll_sketch_agg(F.nullif(F.col("user_ref"), F.lit("")), LG_K).alias("users"))


def append(events: DataFrame, path: str) -> None:
    """Add the rollup rows of a batch of events; one folder a day."""
    rows = hourly(events).withColumn("day", F.to_date("hour"))
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compact(spark: SparkSession, path: str, out: str) -> None:
    """One row per (project, issue, hour) in a new folder."""
    rows = _merged(read(spark, path), *KEYS, "day")
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(out)


def _whole_hours(frm: _dt.datetime, to: _dt.datetime) -> tuple[_dt.datetime, _dt.datetime]:
    """The first hour that begins in [frm, to), and the hour that ``to`` cuts or begins."""
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    first = floor(frm) if frm == floor(frm) else floor(frm) + _dt.timedelta(hours=1)
    return first, max(first, floor(to))


def window(rollup: DataFrame, events: DataFrame, frm: _dt.datetime, to: _dt.datetime, closed_upper: bool = False) -> DataFrame:
    """Rollup rows of [frm, to) or [frm, to]: whole hours as stored, the cut ones from the events in them."""
    first, last = _whole_hours(frm, to)
    stored = rollup.where((F.col("hour") >= X.ts_lit(first)) & (F.col("hour") < X.ts_lit(last)))
    if "day" in rollup.columns:  # whole days of the stored rollup are pruned
        stored = stored.where((F.col("day") >= F.lit(first.date())) & (F.col("day") <= F.lit(last.date())))
    cols = [*KEYS, "events", "first_seen", "last_seen", "users"]
    out = stored.select(*cols)
    edges = [(frm, min(first, to), closed_upper and first > to)] if frm < first else []
    if last <= to and first <= to:
        edges.append((last, to, closed_upper))
    for lo, hi, closed in edges:
        if lo < hi or (closed and lo == hi):
            out = out.unionByName(hourly(Q.live_between(events, lo, hi, closed)).select(*cols))
    return out


def issue_metrics(rows: DataFrame) -> DataFrame:
    """Q2 from rollup rows of a window; ``user_count`` is an estimate (USER_ERROR)."""
    return _merged(rows, "gid").select(
        "gid", F.col("events").alias("times_seen"), "first_seen", "last_seen",
        F.hll_sketch_estimate("users").cast("bigint").alias("user_count"))


def events_per_hour(rows: DataFrame) -> DataFrame:
    """Q1 from rollup rows of a window."""
    return rows.groupBy(F.col("hour").alias("ts"), "pid").agg(F.sum("events").cast("bigint").alias("event_count"))


def events_per_day(rows: DataFrame) -> DataFrame:
    """Q3 from rollup rows of a window."""
    return rows.groupBy("gid", F.to_date("hour").alias("day")).agg(F.sum("events").cast("bigint").alias("event_count"))
