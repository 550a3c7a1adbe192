"""Ingest reads and parses every envelope once, whoever asks for rows and rejects; checks open objects once."""

import datetime as dt
import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.functions import frames
from faultline.functions import normalize as N
from faultline.operators import ingest as I
from faultline.plans import registry as R
from faultline.sources import envelope as S

COLS = "envelope_id long, project_id string, auth string, remote_addr string, received_at timestamp_ntz, body string"
AT = dt.datetime(2024, 1, 1, 10)


def _body(event):
    return '{}\n{"type":"event"}\n' + (event if isinstance(event, str) else json.dumps(event))


def _reasons(spark, events):
    raw = spark.createDataFrame([(i, "1", "sentry_key=k", "10.0.0.1:5", AT, _body(e)) for i, e in enumerate(events)], COLS)
    _, rejects = S.parse_envelopes(raw)
    return {r[0] for r in rejects.select("envelope_id").collect()}


def test_types_are_checked_at_every_depth(spark):
    frame = {"function": "f", "lineno": 3, "in_app": True, "pre_context": ["a", None], "unknown": [{"x": 1}]}
    good = [
        {}, {"level": None, "user": None, "tags": None, "exception": None, "threads": None, "extra": None},
        {"user": {"id": "1", "data": {"k": None}}, "contexts": {"os": None, "device": {"num_cpu": 2}}, "other": {"level": 5}},
        {"exception": [{"type": "T", "stacktrace": {"frames": [frame, None]}}, None]},
        {"exception": {"values": [{"value": "v"}]}, "threads": {"values": None}}, {"exception": {}, "threads": []},
        {"sdk": {"integrations": [], "packages": [{"name": "n"}]}, "timestamp": 12.5}, {"modules": {"a": "b"}, "extra": {"n": [1]}},
    ]
    bad = [
        [], 7, None, "{", {"level": 5}, {"user": []}, {"user": {"id": 7}}, {"user": {"data": {"k": 1}}}, {"tags": {"a": 1}},
        {"tags": ["a"]}, {"contexts": {"device": {"num_cpu": "2"}}}, {"contexts": {"device": {"num_cpu": 2.5}}}, {"contexts": {"os": "x"}},
        {"exception": 3}, {"exception": ["x"]}, {"exception": {"values": {}}}, {"exception": [{"stacktrace": {"frames": [{"lineno": "3"}]}}]},
        {"exception": [{"stacktrace": {"frames": [{"pre_context": [1]}]}}]}, {"threads": [{"current": "yes"}]}, {"extra": [1]},
        {"threads": {"values": [{"id": 1}]}}, {"sdk": {"packages": [{"name": 1}]}}, {"sdk": {"integrations": "x"}}, {"timestamp": "noon"},
    ]
    assert _reasons(spark, good) == set()
    assert _reasons(spark, bad) == set(range(len(bad)))


def test_one_pass_gives_rows_and_rejects(spark):
    """Also where a project comes twice: accepted rows and bad addresses multiply, other rejects don't."""
    raw = spark.createDataFrame([
        (1, "1", "sentry_key=k", "10.0.0.1:5", AT, _body({"message": "m", "level": "error"})),
        (2, "x", "sentry_key=k", "10.0.0.1:5", AT, _body({})),
        (3, "1", "", "10.0.0.1:5", AT, _body({})),
        (4, "1", "sentry_key=k", "10.0.0.1:5", AT, "{}"),
        (5, "1", "sentry_key=k", "10.0.0.1:5", AT, _body({"level": 1})),
        (6, "2", "sentry_key=k", "10.0.0.1:5", AT, _body({})),
        (7, "1", "sentry_key=k", "nowhere", AT, _body({})),
        (8, None, None, None, None, None),
        (9, "1", "sentry_key=k", None, None, _body({})),
    ], COLS)
    projects = spark.createDataFrame([(1, "k"), (1, "k"), (None, None), (3, "")], "id int, key string")
    rows, rejects = I.split_outcomes(I.ingest_all(raw, projects, carry=("envelope_id",)))
    old_rows, _ = I.ingest(raw, projects, carry=("envelope_id",))
    assert sorted(map(str, rows.collect())) == sorted(map(str, old_rows.collect())) and rows.columns == old_rows.columns
    got = sorted((r["envelope_id"], r["reason"]) for r in rejects.collect())
    assert got == [(2, S.R_PROJECT_ID), (3, S.R_DSN), (4, S.R_LINES), (5, S.R_BODY), (6, S.R_PROJECT), (7, S.R_ADDR), (7, S.R_ADDR),
                   (8, S.R_PROJECT_ID), (9, S.R_ADDR), (9, S.R_ADDR)]
    assert rejects.columns == [*raw.columns, "reason"]


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_envelopes_are_parsed_once(spark):
    assert _scans(R.SPARK["ingest_envelope_parse"](spark, SF_SMALL)) == 1
    assert _scans(R.SPARK["issue_upsert"](spark, SF_SMALL)) == 0  # both batches read the written rows
    raw = R.A.raw_envelopes(spark, SF_SMALL)
    assert _scans(I.ingest(raw, R.A.projects(spark, SF_SMALL))[1]) == 1


def test_tasks_follow_the_size_of_a_table(spark, tmp_path):
    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert frames.spread(df, 1 << 40).rdd.getNumPartitions() == cores
    assert frames.spread(df, 1 << 14).rdd.getNumPartitions() > 2 * cores


def test_rules_that_are_skipped_could_not_match(spark):
    """Rules with a needed text give what the plain chain gives."""
    texts = ["", None, "a 2024-01-02T03:04:05Z b", "id=7 id:8 x", "userid=1 user_id: 2 session=ab token:cd", "12:30 PM 1:05AM",
             "see http://a.b/c?d=1 and C:\\dir\\file.txt", "/usr/lib/x 10.0.0.1 v1.2.3-rc1 a@b.co", "0xff deadbeef01 123456 3.14",
             "1:2:3:4:5:6:7:8 01/02/2024 01-02-2024", "550e8400-e29b-41d4-a716-446655440000 1234567890", "\u2003pad \t x\n\u00a0", "M - / : . @ id"]
    plain = F.col("t")
    for pattern, repl in N.rules():
        plain = F.regexp_replace(plain, N.to_java_regex(pattern), repl)
    plain = F.trim(plain, F.lit(N.TRIM_CHARS))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(N.normalize_message(F.col("t")).alias("n"), plain.alias("p")).collect()
    assert [r["n"] for r in got] == [r["p"] for r in got]
    assert set(N.NEEDS) == {p for p, _ in N.rules()} - {N.WHITESPACE_PATTERN}


def test_reading_only_times_builds_no_envelope(spark):
    """The replay's pass over the receive times leaves out the texts."""
    raw = R.A.raw_envelopes(spark, SF_SMALL)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan(raw) and "user_id" in plan(raw)
    times = plan(raw.agg(F.max("received_at")))
    assert "md5" not in times and "Generate" not in times
