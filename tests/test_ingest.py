"""Ingest helpers on hand-written inputs."""

import datetime as dt

from pyspark.sql import functions as F

from faultline.operators import ingest as I
from faultline.sources import envelope as S


def test_project_key(spark):
    df = spark.createDataFrame([("Sentry sentry_key=abc, sentry_version=7",), ("sentry_version=7,sentry_key=xyz",),
                                ("Sentry sentry_version=7",), ("",), ("sentry_key=, sentry_key=b",)], "h string")
    got = [r[0] for r in df.select(S.project_key(F.col("h"))).collect()]
    assert got == ["abc", "xyz", "", "", ""]  # the first sentry_key part wins even when empty


def test_split_ip(spark):
    df = spark.createDataFrame([("10.1.2.3:443",), ("[2001:db8::1]:80",), ("bad",), ("300.1.1.1:1",), ("1.2.3.4",)],
                               "a string")
    got = [None if r[0] is None else tuple(r[0]) for r in df.select(I.split_ip(F.col("a"))).collect()]
    assert got == [("10.1.2.3", "::1"), ("127.0.0.1", "2001:db8::1"), None, None, None]


def _parse(spark, event_json):
    body = '{}\n{"type":"event"}\n' + event_json
    raw = spark.createDataFrame([("1", "sentry_key=k", body)], "project_id string, auth string, body string")
    parsed, rejects = S.parse_envelopes(raw)
    assert rejects.count() == 0
    return parsed


def test_tags_and_contexts(spark):
    p = _parse(spark, '{"environment":"prod","level":"error","release":"","user":{"id":"7","ip_address":"1.2.3.4"},'
                      '"tags":{"b":"2","a":"1","":"x","c":""},"contexts":{"device":{"arch":"arm64","num_cpu":0},'
                      '"runtime":{"name":"go","go_maxprocs":4}},"extra":{"n":1,"s":"t","o":{"k":[1,2]}}}')
    r = p.select(I.build_tags(F.col("event")).alias("t"), I.build_contexts(F.col("event"), F.col("extra")).alias("c")
                 ).first()
    assert [(t.key, t.value) for t in r.t] == [("env", "prod"), ("level", "error"), ("user", "id:7"), ("a", "1"),
                                               ("b", "2")]
    assert [(c.key, c.value) for c in r.c] == [("user.ip", "1.2.3.4"), ("device.arch", "arm64"), ("runtime.name", "go"),
                                               ("runtime.go_maxprocs", "4"), ("extra.n", "1"),
                                               ("extra.o", '{"k":[1,2]}'), ("extra.s", "t")]


def test_thread_frames_pick_current_with_frames(spark):
    threads = ('[{"id":"1","current":false,"stacktrace":{"frames":[{"function":"a","abs_path":"/x/a.go","lineno":1}]}},'
               '{"id":"2","current":true,"stacktrace":{"frames":[]}},'
               '{"id":"3","current":true,"stacktrace":{"frames":[{"function":"b","abs_path":"/x/b.go","lineno":5,'
               '"in_app":true}]}}]')
    p = _parse(spark, '{"threads":{"values":' + threads + "}}")
    fr = p.select(I.thread_frames(F.col("threads")).alias("f")).first().f
    assert [(f.function, f.filename, f.lineno, f.colno, f.in_app) for f in fr] == [("b", "b.go", 5, 5, 1)]


def test_upsert_keeps_first_and_moves_last(spark):
    t0 = dt.datetime(2024, 1, 1)
    def rows(ts, msg):
        return spark.createDataFrame([(1, "h", 9, ts, "e" + msg, msg, "T", "v")],
                                     "pid int, primary_hash string, gid bigint, created_at timestamp_ntz, "
                                     "event_id string, error_value string, error_type string, view string")
    first = I.upsert_issues(None, rows(t0, "old"))
    second = I.upsert_issues(first, rows(t0 + dt.timedelta(hours=1), "new")).first()
    assert second.first_seen == t0 and second.last_seen == t0 + dt.timedelta(hours=1) and second.message == "new"
    replay = I.upsert_issues(first, rows(t0 - dt.timedelta(hours=1), "older")).first()
    assert replay.first_seen == t0 - dt.timedelta(hours=1) and replay.message == "old"


def test_ingested_rows_follow_the_event_schema(spark):
    from conftest import SF_SMALL
    from faultline.schema import EVENT
    from faultline.sources import adapters as A

    rows, _ = I.ingest(A.raw_envelopes(spark, SF_SMALL), A.projects(spark, SF_SMALL))
    got = {f.name: f.dataType for f in rows.schema.fields}
    for f in EVENT.fields:
        assert f.name in got, f.name
        assert got[f.name].simpleString() == f.dataType.simpleString(), f.name


def _raw(spark, rows):
    cols = ("envelope_id long, project_id string, auth string, remote_addr string, received_at timestamp_ntz, "
            "body string")
    return spark.createDataFrame(rows, cols)


def test_equal_bodies_get_ids_of_their_own(spark):
    at = dt.datetime(2024, 1, 1, 10)
    body = '{}\n{"type":"event"}\n{"message":"m"}'
    raw = _raw(spark, [(i, "1", "sentry_key=k", "10.0.0.1:5", at, body) for i in range(40)])
    projects = spark.createDataFrame([(1, "k")], "id int, key string")
    ids = lambda n: sorted(r[0] for r in I.ingest(raw.repartition(n), projects)[0].select("event_id").collect())
    assert len(set(ids(1))) == 40
    assert ids(1) == ids(7)


def test_repeated_key_takes_the_last_value(spark):
    p = _parse(spark, '{"message":"first","message":"last","level":"error"}')
    assert p.select("event.message").first()[0] == "last"


def test_ipv6_is_checked_and_canonical(spark):
    cases = {"2001:DB8:0:0:0:0:0:1": "2001:db8::1", "::": "::", "::1": "::1", "1::": "1::", "a:b": None, "1:::2": None,
             "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9": None, "0001:0:0:2:0:0:0:3": "1:0:0:2::3",
             "1::2::3": None, ":1::": None, "12345::": None, "1:0:2:3:4:5:6:7": "1:0:2:3:4:5:6:7", "fe80::0": "fe80::"}
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", I.canonical_v6(F.col("a")).alias("c"))
    assert {r["a"]: r["c"] for r in df.collect()} == cases
