"""Any window from whole stored hours and the events of cut ones; sketches within their error."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import analytics as Q
from faultline.operators import rollup as RU
from faultline.sources import adapters as A

D = dt.datetime
WINDOWS = [
    (A.WINDOW_FROM, A.NOW), (D(2024, 1, 5, 10, 20), D(2024, 1, 5, 10, 40)), (D(2024, 1, 5, 10), D(2024, 1, 5, 11)), (D(2024, 1, 5, 10, 20), D(2024, 1, 5, 11)),
    (D(2024, 1, 5, 10), D(2024, 1, 5, 10, 30)), (D(2024, 1, 5, 10, 59, 59), D(2024, 1, 9, 12, 0, 1)), (D(2024, 1, 5), D(2024, 1, 5)), (D(2024, 1, 6), D(2024, 1, 5)),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, ev = str(tmp_path_factory.mktemp("ru") / "r"), A.ev(spark, SF_SMALL)
    for k in range(3):
        RU.append(ev.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), path)
    return RU.read(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("frm,to,closed", [(*w, False) for w in WINDOWS] + [(*w, True) for w in WINDOWS[3:7]])
def test_windows(spark, stored, frm, to, closed):
    ev = A.ev(spark, SF_SMALL)
    got = RU.window(stored, ev, frm, to, closed)
    live = Q.live_between(ev, frm, to, closed)
    hours = live.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("ts"), "pid").agg(F.count("*"))
    assert rows(RU.events_per_hour(got)) == rows(hours)
    days = live.groupBy("gid", F.to_date("created_at")).agg(F.count("*"))
    assert rows(RU.events_per_day(got)) == rows(days)
    metrics = RU.issue_metrics(got)
    exact = live.groupBy("gid").agg(F.count("*"), F.min("created_at"), F.max("created_at"))
    assert rows(metrics.drop("user_count")) == rows(exact)


def test_compacted_rollup_is_equal(spark, stored, tmp_path):
    RU.append(A.ev(spark, SF_SMALL), str(tmp_path / "a"))
    RU.append(A.ev(spark, SF_SMALL).limit(0), str(tmp_path / "a"))
    RU.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    one = RU.read(spark, str(tmp_path / "b"))
    assert one.groupBy(*RU.KEYS).count().where("count > 1").count() == 0
    assert rows(RU.issue_metrics(one)) == rows(RU.issue_metrics(stored))


def test_estimates_of_many_users(spark):
    ev = spark.range(60_000).select(
        F.lit(1).alias("pid"), (F.col("id") % 3).alias("gid"), F.lit(0).alias("deleted"), (F.col("id") % 20_000).cast("string").alias("user_ref"),
        (F.lit(D(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("created_at"))
    est = {r["gid"]: r["user_count"] for r in RU.issue_metrics(RU.hourly(ev)).collect()}
    assert len(est) == 3 and all(abs(n - 20_000) <= 20_000 * RU.USER_ERROR for n in est.values())
