"""Lookups read fewer files and lose no row; the sweep leaves living rows only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.functions import predicates as P
from faultline.operators import analytics as Q
from faultline.operators import layout as L
from faultline.operators import skipping as SK
from faultline.sources import adapters as A


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ev") / "table")
    L.write_events(A.ev(spark, SF_SMALL), path, mode="overwrite", max_rows_per_file=25)
    SK.update_index(spark, path)
    return path


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def test_tag_probe_reads_fewer_files(spark, table):
    every = spark.read.parquet(table)
    files = every.inputFiles()
    assert len(files) > 30
    for user in ("id:1", "id:7", "id:33", "id:nobody"):
        tokens = P.parse_query(f"user:{user} os:linux")
        some = SK.candidate_files(spark, table, tags=P.tag_probes(tokens))
        assert len(some) < len(files)
        match = P.group_search_predicate(tokens, F.col("message"), F.col("title"), F.col("tags"))
        got = SK.read_where(spark, table, tags=P.tag_probes(tokens))
        assert sorted(got.columns) == sorted(every.columns)
        assert set(got.inputFiles()) == set(some) or not some
        assert ids(got.where(match)) == ids(every.where(match))
    absent = [SK.candidate_files(spark, table, tags=[f"user=missing{i}"]) for i in range(20)]
    assert sum(map(len, absent)) < len(files)  # false positives are rare


def test_issue_lookup_reads_fewer_files(spark, table):
    every = spark.read.parquet(table)
    rare = [r["gid"] for r in every.groupBy("gid").count().orderBy("count", "gid").limit(2).collect()]
    assert 0 < len(SK.candidate_files(spark, table, gids=rare)) < len(every.inputFiles())
    got = SK.read_where(spark, table, gids=rare)
    assert ids(got.where(F.col("gid").isin(rare))) == ids(every.where(F.col("gid").isin(rare)))
    assert SK.candidate_files(spark, table, gids=[]) == [] and SK.read_where(spark, table, gids=[]).count() == 0
    both = SK.candidate_files(spark, table, tags=["os=linux"], gids=rare)
    assert set(both) <= set(SK.candidate_files(spark, table, gids=rare)) & set(SK.candidate_files(spark, table, tags=["os=linux"]))


def test_weeks_and_files_are_pruned_together(spark, table):
    df = SK.read_where(spark, table, A.NOW - dt.timedelta(days=7), A.NOW, tags=["user=id:7"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week" in plan


def test_new_files_are_read_before_and_after_they_are_indexed(spark, table, tmp_path):
    path = str(tmp_path / "t")
    L.write_events(A.ev(spark, SF_SMALL).where("pid = 1"), path, mode="overwrite", max_rows_per_file=25)
    assert len(SK.candidate_files(spark, path, tags=["x=y"])) == len(spark.read.parquet(path).inputFiles())  # no index yet
    SK.update_index(spark, path)
    n = spark.read.parquet(SK.index_path(path)).count()
    odd = A.ev(spark, SF_SMALL).where("pid = 2").withColumn("tags", F.expr("array(named_struct('key', 'only', 'value', 'here'))"))
    L.write_events(odd.limit(3), path)
    probe = lambda: SK.read_where(spark, path, tags=["only=here"]).where(P.has_tag(F.col("tags"), "only", "here")).count()
    assert probe() == 3
    SK.update_index(spark, path)
    assert probe() == 3 and spark.read.parquet(SK.index_path(path)).count() > n
    SK.update_index(spark, path)
    assert len(SK.candidate_files(spark, path, tags=["only=here"])) <= 4


def test_many_tokens_use_several_blocks(spark, tmp_path):
    ev = A.ev(spark, SF_SMALL).crossJoin(spark.range(12).select(F.col("id").alias("copy")))
    tag = F.struct(F.lit("n").alias("key"), F.concat(F.substring("event_id", 1, 8), F.col("copy").cast("string")).alias("value"))
    ev = ev.withColumn("tags", F.array(tag)).drop("copy").coalesce(1)
    path = str(tmp_path / "t")
    L.write_events(ev, path, mode="overwrite")
    SK.update_index(spark, path)
    assert spark.read.parquet(SK.index_path(path)).agg(F.max("blocks")).first()[0] > 1
    sample = [r["tags"][0]["value"] for r in ev.orderBy("event_id").limit(40).collect()]
    for v in sample:
        assert SK.read_where(spark, path, tags=[f"n={v}"]).where(P.has_tag(F.col("tags"), "n", v)).count() >= 1
    assert sum(len(SK.candidate_files(spark, path, tags=[f"n=zz{i}"])) for i in range(30)) < 15


def test_filtered_groups_through_the_index(spark, table):
    tokens = P.parse_query("user:id:7 level:!info")
    want = Q.filtered_groups(A.ev(spark, SF_SMALL), tokens, A.WINDOW_FROM, A.NOW)
    got = Q.filtered_groups(SK.read_where(spark, table, A.WINDOW_FROM, A.NOW, tags=P.tag_probes(tokens)), tokens, A.WINDOW_FROM, A.NOW)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def folders(path):
    import os

    return sorted(os.path.join(r, x)[len(path):] for r, d, _ in os.walk(path) for x in d if x.startswith("week="))


def test_sweep_drops_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    L.write_events(A.ev(spark, SF_SMALL), path, mode="overwrite")
    before = folders(path)
    now = dt.datetime(2024, 4, 18, 12)
    cut = X_cut = now - dt.timedelta(days=90)
    want = ids(A.ev(spark, SF_SMALL).where(F.col("created_at") > F.lit(cut)))
    report = {r["week"]: r for r in L.drop_expired(spark, path, now).collect()}
    after = folders(path)
    assert {r["action"] for r in report.values()} == {"dropped", "rewritten", "kept"}
    assert len(before) - len(after) == sum(r["action"] == "dropped" for r in report.values()) > 0
    assert ids(spark.read.parquet(path)) == want and X_cut
    again = L.drop_expired(spark, path, now).collect()
    assert ids(spark.read.parquet(path)) == want and sum(r["rows_before"] for r in again) == len(want)
    L.drop_expired(spark, path, dt.datetime(2030, 1, 1))
    assert folders(path) == []
