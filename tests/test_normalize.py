"""Normalization and fingerprints against hand-derived golden values (FIXTURES C)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.operators import ingest as I
from faultline.sources import envelope as S

CASES = [
    ("user id: 5 at 2024-01-01 10:00:00 session=abc id=7 1.25",
     r"user \bid=<id> at <timestamp> <timestamp> \bsession=<id> \bid=<id> <version>"),
    ("conn 10.0.0.1:5432 refused for a@b.io v1.2.3", "conn <ip>:5432 refused for <email> <version>"),
    ("open /var/log/app.log: no such file", "open <path> no such file"),
    ("call https://x.io/a?b=1 id: 42", r"call <path> \bid=<id>"),
    ("ptr 0xdeadbeef addr deadbeef01 n 1234567", "ptr <number> addr <number> n <number>"),
    (r"read C:\tmp\x.txt failed", "read <path>"),
    ("u 550e8400-e29b-41d4-a716-446655440000 at 3:05 PM", "u <uuid> at <timestamp>"),
    ("", ""),
    ("  spaced\t\tout  ", "spaced out"),
    # ASCII word boundaries: an accented letter does not glue a number to a word
    ("é1234567 x", "é<number> x"),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_normalize_message(spark, text, expected):
    out = spark.createDataFrame([(text,)], "t string").select(N.normalize_message(F.col("t"))).first()[0]
    assert out == expected


def _envelope(event_json: str) -> str:
    return '{"event_id":"x"}\n{"type":"event"}\n' + event_json + "\n"


def _fingerprint(spark, event_json: str):
    raw = spark.createDataFrame([("1", "sentry_key=k", _envelope(event_json))], "project_id string, auth string, body string")
    parsed, rejects = S.parse_envelopes(raw)
    assert rejects.count() == 0
    ev = F.col("event")
    exc = F.col("exceptions")
    return parsed.select(
        N.fingerprint(ev["message"], ev["level"], ev["platform"], exc).alias("fp"),
        I.culprit(exc).alias("view"),
        I.issue_type(exc, ev["message"]).alias("type"),
        I.issue_value(exc).alias("value"),
    ).first()


def md5(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def test_message_path_fingerprint(spark):
    row = _fingerprint(spark, '{"message":"Hor error","level":"error","platform":"go"}')
    assert row.fp == md5("Hor errorerrorgo") == "4d67e5e3cc4bca2a3f17f3273416e145"
    assert (row.type, row.value, row.view) == ("Hor error", "(No error message)", "")


def test_message_path_normalized_twice(spark):
    row = _fingerprint(spark, '{"message":"My error message at 2025-10-09T23:59:42+03:00","level":"error",'
                              '"platform":"go","threads":[{"current":true,"stacktrace":{"frames":['
                              '{"function":"main","module":"main","lineno":98,"in_app":true}]}}]}')
    assert row.fp == "df1680c6a251fe21bfe0990f9a471705"


def test_stack_path_fingerprint_and_view(spark):
    exc = ('[{"type":"*errors.errorString","value":"an example error occurred at 2025-10-11T02:59:21+03:00",'
           '"stacktrace":{"frames":[{"function":"main","module":"main","lineno":98,"in_app":true},'
           '{"function":"run","module":"main","lineno":170,"in_app":true}]}}]')
    for shape in (exc, '{"values":' + exc + "}"):
        row = _fingerprint(spark, '{"message":"m","level":"error","platform":"go","exception":' + shape + "}")
        assert row.fp == "38fb3214a9e9651772e0d9db4516f25d"
        assert row.view == "main in run"
        assert row.type == "*errors.errorString"


def test_untyped_exception_is_error_and_ignored_frames(spark):
    exc = ('[{"value":"boom","stacktrace":{"frames":[{"function":"main","module":"main","lineno":1,"in_app":true},'
           '{"function":"Msg","module":"github.com/rs/zerolog","lineno":2,"in_app":true}]}}]')
    row = _fingerprint(spark, '{"message":"m","level":"error","platform":"go","exception":' + exc + "}")
    assert row.type == "Error" and row.value == "boom" and row.view == "main in main"


def test_wrong_json_type_is_rejected(spark):
    raw = spark.createDataFrame([("1", "sentry_key=k", _envelope('{"level":5}')),
                                 ("1", "sentry_key=k", '{}\n{}'),
                                 ("x", "sentry_key=k", _envelope("{}")),
                                 ("1", "Sentry sentry_key=, v=7", _envelope("{}"))],
                                "project_id string, auth string, body string")
    _, rejects = S.parse_envelopes(raw)
    reasons = sorted(r.reason for r in rejects.collect())
    assert reasons == sorted([S.R_BODY, S.R_LINES, S.R_PROJECT_ID, S.R_DSN])
