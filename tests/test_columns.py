"""Scalar columns and parameter helpers (X*, P6, P9, Q14 grid)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.functions import columns as X
from faultline.functions import predicates as P
from faultline.plans import pages as G

PARSE_CASES = [
    ("", []),
    ("release:nordland@0.1.0", [P.Token("release", "is", "nordland@0.1.0")]),
    ("server_name:!Olegs-MacBook-Pro.local", [P.Token("server_name", "is not", "Olegs-MacBook-Pro.local")]),
    ('server_name:"delein computer"', [P.Token("server_name", "is", "delein computer")]),
    ('"pro error"', [P.Token(value="pro error", is_raw_text=True)]),
    ('release:nordland@0.1.0 level:error server_name:!Olegs-MacBook-Pro.local "pro error" "div error" '
     'server_name:"delein computer"',
     [P.Token("release", "is", "nordland@0.1.0"), P.Token("level", "is", "error"),
      P.Token("server_name", "is not", "Olegs-MacBook-Pro.local"), P.Token(value="pro error", is_raw_text=True),
      P.Token(value="div error", is_raw_text=True), P.Token("server_name", "is", "delein computer")]),
    ("tag:'value with spaces'", [P.Token("tag", "is", "value with spaces")]),
    ('"text" key:value', [P.Token(value="text", is_raw_text=True), P.Token("key", "is", "value")]),
    ('"a:b c"', [P.Token("a", "is", "b c")]),
    ('""', []),
]


@pytest.mark.parametrize("q,expected", PARSE_CASES)
def test_parse_query(q, expected):
    assert P.parse_query(q) == expected


def test_query_tokens_column_matches_parser(spark):
    rows = [(q,) for q, _ in PARSE_CASES]
    df = spark.createDataFrame(rows, "q string").select("q", P.query_tokens(F.col("q")).alias("t"))
    for r in df.collect():
        got = [P.Token(t.key, t.operator, t.value, t.is_raw_text) for t in r.t]
        assert got == P.parse_query(r.q), r.q


def test_parse_query_v2():
    assert P.parse_query_v2('env::prod level:!:error raw "k::a b"') == [
        P.Token("env", "is", "prod"), P.Token("level", "is not", "error"), P.Token("k", "is", "a b")]
    assert P.parse_query_v2("env:prod 'a b' n:>:5 k:'x y' url::http://h:1") == [
        P.Token("env", "is", "prod"), P.Token("n", ">", "5"), P.Token("k", "is", "x y"),
        P.Token("url", "is", "http://h:1")]


DURATIONS = [("", 0), ("2h", 7200), ("5m", 300), ("10s", 10), ("3d", 259200), ("1w", 604800),
             ("100h", 360000), ("0h", 0), ("-2h", 7200), ("1x", None), ("abc", None), ("5", None)]


@pytest.mark.parametrize("text,secs", DURATIONS)
def test_duration(spark, text, secs):
    assert G.duration_seconds(text) == secs
    col = spark.createDataFrame([(text,)], "t string").select(X.parse_duration(F.col("t"))).first()[0]
    assert col == secs


def test_codes(spark):
    df = spark.createDataFrame([("FATAL", "go", "sentry.go"), ("bogus", "Go", "sentry.rust"),
                                ("Info", "rust", "x")], "l string, p string, s string")
    got = df.select(X.level_code(F.col("l")), X.platform_code(F.col("p")), X.sdk_id(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (7, 0, 2), (4, 2, 0)]


def test_display_user(spark):
    df = spark.createDataFrame([("e", "u", "i", "n"), ("", "u", "i", "n"), ("", "", "i", "n"), ("", "", "", "n"),
                                ("", "", "", "")], "e string, u string, i string, n string")
    got = [r[0] for r in df.select(X.display_user(*[F.col(c) for c in "euin"])).collect()]
    assert got == ["e", "u", "i", "n", "(no value)"]


def test_dashboard_grid():
    now = dt.datetime(2025, 1, 15, 12, 0)
    start, interval, n = G.dashboard_grid(now, "24h")
    assert interval == 3600 and n == 24
    start, interval, n = G.dashboard_grid(now, "7d")
    assert interval == 6 * 3600
    start, interval, n = G.dashboard_grid(now, "200d")
    assert n == 201 and interval == 86400  # every day up to now
    assert G.dashboard_grid(now, "") == G.dashboard_grid(now, "24h") == G.dashboard_grid(now, "junk")


def test_tag_probe_escape(spark):
    df = spark.createDataFrame([([("a", "b=c")],), ([("a=b", "c")],), ([("a\\b", "c")],)],
                               "tags array<struct<key:string,value:string>>")
    got = [r[0] for r in df.select(P.has_tag(F.col("tags"), "a", "b=c")).collect()]
    assert got == [True, False, False]
    got = [r[0] for r in df.select(P.has_tag(F.col("tags"), "a=b", "c")).collect()]
    # the unescaped probe 'a=b=c' hits the stored (a, b=c); a key holding '=' never matches itself
    assert got == [True, False, False]


def test_time_range(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00", "2024-01-02T00:00:00"), ("invalid", "2024-01-02T00:00:00"),
                                ("2024-01-01T10:00:00", "invalid"), ("", ""),
                                ("2024-01-01T10:00:00.5", "2024-01-02T00:00:00")], "a string, b string")
    got = [r[0] for r in df.select(X.parse_time_range(F.col("a"), F.col("b"))).collect()]
    assert got[0] is not None and got[0].start == dt.datetime(2024, 1, 1, 10)
    assert got[1] is None and got[2] is None and got[3] is None
    assert got[4] is not None


def test_period_window():
    now = dt.datetime(2024, 1, 31)
    assert G.period_window(now, "", page="issues") == (now - dt.timedelta(days=14), now)
    assert G.period_window(now, "2h", page="issues") == (now - dt.timedelta(hours=2), now)
    assert G.period_window(now, "2h", "2024-01-01T00:00:00", "2024-01-02T00:00:00", page="issues") == (
        dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
    assert G.period_window(now, None, page="tags") == (now - dt.timedelta(days=1), now)
    first = dt.datetime(2024, 1, 5)
    assert G.period_window(now, None, page="events", first_seen=first) == (first - dt.timedelta(seconds=1), now)


def test_context_groups_compute_their_entries_once(spark):
    kv = "array<struct<key:string,value:string>>"
    rows = [([("os.name", "linux"), ("device.arch", "amd64"), ("device.a.b", "1"), ("plain", "x"), ("os.name", "darwin")],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"contexts {kv}").select(X.context_groups(F.col("contexts")).alias("g"))
    got = [None if r.g is None else [(x.prefix, x.fields) for x in r.g] for r in df.collect()]
    assert got[:2] == [[("device", {"arch": "amd64", "a.b": "1"}), ("os", {"name": "darwin"})], []]
    assert got[2] in (None, [])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries") == 1
