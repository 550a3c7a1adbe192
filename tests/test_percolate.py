"""Reverse matching equals one pass per search, on ten thousand generated searches and on hard ones."""

import datetime as dt
import random

from pyspark.sql import functions as F

from faultline.functions import predicates as P
from faultline.operators import percolate as PC

T0 = dt.datetime(2024, 1, 1)
EVENTS = "pid int, gid long, created_at timestamp_ntz, deleted smallint, message string, title string, tags array<struct<key:string,value:string>>"
SEARCHES = "search_id long, pid int, query string, frm timestamp_ntz, to timestamp_ntz"


def make_events(spark, rng, n=600):
    words = ["Refused", "timeout", "ünïcode", "id=12", "id=123", "a b", "x"]
    rows = []
    for i in range(n):
        tags = [("env", rng.choice(["prod", "dev"])), ("k", str(rng.randrange(40))), ("a=b", "c\\d")][: rng.randrange(4)]
        msg = " ".join(rng.choice(words) for _ in range(rng.randrange(4)))
        rows.append((rng.randrange(3), i % 17, T0 + dt.timedelta(hours=rng.randrange(100)), int(i % 29 == 0), msg or None, rng.choice(["", None, "Title X"]), tags if i % 13 else None))
    return spark.createDataFrame(rows, EVENTS), rows


def token(tags, key, value):
    return any(k.replace("\\", "\\\\").replace("=", "\\=") + "=" + v == f"{key}={value}" for k, v in tags or [])


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def brute(rows, searches):
    out = {}
    for sid, pid, query, frm, to in searches:
        hit = []
        if query is not None:
            tokens = P.parse_query(query)
            for p, g, t, dead, msg, title, tags in rows:
                if p != pid or dead or frm is None or not frm <= t <= to:
                    continue
                if all((fold(x.value) in fold(msg) or fold(x.value) in fold(title)) if x.is_raw_text
                       else token(tags, x.key, x.value) != (x.operator == P.IS_NOT) for x in tokens):
                    hit.append(g)
        out[sid] = (len(hit), len(set(hit)))
    return out


def check(spark, events, rows, searches):
    df = spark.createDataFrame(searches, SEARCHES)
    got = {r["search_id"]: (r["match_events"], r["match_issues"]) for r in PC.saved_search_matches(events, df).collect()}
    want = brute(rows, searches)
    assert got == want
    return want


def test_hard_searches(spark):
    rng = random.Random(5)
    events, rows = make_events(spark, rng)
    queries = ["", None, "env:prod", "env:!prod", "env:prod env:!prod", "refused", '"REFUSED timeout"', "x", '"a b" x', "ÜN", "ünï", "k:3 env:dev refused", "nothing:here",
               "a=b:c\\d", "a\\=b:c\\d", "id=12", "id=123", "zzz", "env:!dev k:!7 x", "::", '"', "k:'3'", "refused timeout id=12"]
    searches = [(i, p, q, T0 + dt.timedelta(hours=f), T0 + dt.timedelta(hours=90)) for i, (q, p, f) in enumerate((q, p, f) for q in queries for p in (0, 2) for f in (0, 50))]
    searches += [(9000, 1, "env:prod", None, None), (9001, 77, "env:prod", T0, T0), (9002, None, "env:prod", T0, T0)]
    want = check(spark, events, rows, searches)
    assert sum(n > 0 for n, _ in want.values()) > 40


def test_ten_thousand_searches(spark):
    rng = random.Random(6)
    events, rows = make_events(spark, rng, 120)
    pick = lambda i: [f"k:{i % 60}", f"env:dev k:{i % 50}", f'"id={i % 200}"', f"k:!{i % 40} refused", f"k:{i % 40} env:!prod"][i % 5]
    searches = [(i, i % 4, pick(i), T0 + dt.timedelta(hours=i % 30), T0 + dt.timedelta(hours=60 + i % 40)) for i in range(10_000)]
    check(spark, events, rows, searches)


def test_anchor_is_the_rarest(spark):
    rows = [(0, 1, T0, 0, "rare word", "", [("env", "prod")])] + [(0, 1, T0, 0, "word", "", [("env", "prod"), ("k", "1")]) for _ in range(9)]
    events = spark.createDataFrame(rows, EVENTS)
    searches = spark.createDataFrame([(1, 0, "env:prod k:1", T0, T0), (2, 0, "rare", T0, T0), (3, 0, "env:!dev", T0, T0), (4, 0, "env:prod k:5", T0, T0)], SEARCHES)
    got = {r["search_id"]: r["token"] for r in PC.anchors(events, searches).collect()}
    assert got[1] == "tk=1" and got[2] in ("grar", "gare") and got[3] == "*" and 4 not in got
    assert F.col("x") is not None


def test_texts_are_cut_once_where_the_title_holds_the_message(spark):
    """Each token of an event comes once; a title that holds the message is the only text that is cut."""
    tags = [("k", "1"), ("k", "1")]
    texts = [("Refused", "Refused: (none)"), ("Refused", "other"), (None, "abcabc"), ("ABC", None), ("ab", "ab"), (None, None)]
    rows = [(1, i, T0, 0, m, t, tags) for i, (m, t) in enumerate(texts)]
    events = spark.createDataFrame(rows, EVENTS)
    asked = spark.createDataFrame([(1, "gabc"), (1, "*")], "pid int, token string")
    df = PC._event_tokens(events, asked)
    got = sorted((r.gid, r.token) for r in df.select("gid", "token").collect())
    grams = lambda s: {fold(s)[i:i + 3] for i in range(len(s or "") - 2)}
    assert got == sorted((i, x) for i, (m, t) in enumerate(texts)
                         for x in {"tk=1", "*"} | {"g" + g for g in grams(m) | grams(t)})
    assert "array_union" not in df._jdf.queryExecution().optimizedPlan().toString()
