"""Invariants for operators without an SQL oracle (approximate, sampled, skew paths)."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import analytics as Q
from faultline.operators import layout as L
from faultline.sources import adapters as A


def test_approx_metrics_close_to_exact(spark):
    ev = A.ev(spark, SF_SMALL)
    exact = Q.issue_metrics(ev, A.WINDOW_FROM, A.NOW)
    approx = Q.issue_metrics(ev, A.WINDOW_FROM, A.NOW, approx=True)
    j = exact.alias("e").join(approx.alias("a"), "gid")
    assert j.count() == exact.count()
    bad = j.where(F.abs(F.col("e.user_count") - F.col("a.user_count")) > F.greatest(F.lit(2), F.col("e.user_count") * 0.1))
    assert bad.count() == 0
    assert j.where(F.col("e.times_seen") != F.col("a.times_seen")).count() == 0


def test_sample_is_deterministic_subset(spark):
    ev = A.ev(spark, SF_SMALL)
    a = L.event_sample(ev, 1, 4).select("event_id")
    b = L.event_sample(ev, 1, 4).select("event_id")
    assert a.exceptAll(b).count() == 0
    n, total = a.count(), ev.count()
    assert 0 < n < total


def test_neighbors_on_skewed_issue_match_plain_window(spark):
    """One issue holding most events, split over many range pieces, gives the same
    neighbours as a plain window over the issue."""
    base = dt.datetime(2024, 1, 1)
    rows = [(1, 7 if i % 3 else 8, base + dt.timedelta(seconds=i // 2), f"e{i:05d}", 0) for i in range(3000)]
    ev = spark.createDataFrame(rows, "pid int, gid bigint, created_at timestamp_ntz, event_id string, deleted smallint")
    got = Q.event_neighbors(ev, base, base + dt.timedelta(days=1), sample=400, step=10)
    w = Window.partitionBy("gid").orderBy("created_at", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = ev.select("gid", "event_id",
                     F.nullif(F.last("event_id").over(whole), F.col("event_id")).alias("first_id"),
                     F.nullif(F.first("event_id").over(whole), F.col("event_id")).alias("last_id"),
                     F.lag("event_id").over(w).alias("next_id"), F.lead("event_id").over(w).alias("prev_id"))
    cols = ["gid", "event_id", "first_id", "last_id", "next_id", "prev_id"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
