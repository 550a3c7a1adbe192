"""Stream sinks: a snapshot that can't be read ends the batch."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.operators import layout as L
from faultline.sources import adapters as A
from faultline.streaming import alert_windows as AW
from faultline.streaming import jobs as ST
from faultline.streaming import snapshots as SN


def test_no_snapshot_yet(spark, tmp_path):
    assert ST.previous_snapshot(spark, str(tmp_path / "none"), 3) is None


def test_newest_snapshot_before(spark, tmp_path):
    path = str(tmp_path / "s")
    for v in (0, 1, 4):
        spark.range(v + 1).write.parquet(f"{path}/v={v}")
    assert ST.previous_snapshot(spark, path, 4).count() == 2
    assert ST.previous_snapshot(spark, path, 0) is None


def test_broken_snapshot_fails(spark, tmp_path):
    path = tmp_path / "s" / "v=0"
    os.makedirs(path)
    (path / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        ST.previous_snapshot(spark, str(tmp_path / "s"), 1).count()


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from faultline.session import ensure_checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(spark)


# --- bucketed snapshots -------------------------------------------------------------------
def _batch(spark, keys, n):
    return spark.createDataFrame([(k, n) for k in keys], "k long, n long")


def _sum(old, rows):
    both = rows if old is None else old.drop("bucket").unionByName(rows)
    return both.groupBy("k").agg(F.sum("n").alias("n"))


def _merge(spark, path, batch_id, rows):
    SN.merge(spark, path, batch_id, rows, F.col("k"), _sum, F.col("k"), buckets=16)


def _table(spark, path):
    return {r["k"]: r["n"] for r in SN.read(spark, path).collect()}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    assert SN.read(spark, path) is None
    _merge(spark, path, 0, _batch(spark, range(2000), 1))
    _merge(spark, path, 1, _batch(spark, [5, 5, 77], 1))
    assert _table(spark, path) == {k: 3 if k == 5 else 2 if k == 77 else 1 for k in range(2000)}
    size = lambda v: sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(f"{path}/data/v={v}") for f in fs if f.endswith(".parquet"))
    assert len([d for d in os.listdir(f"{path}/data/v=1") if d.startswith("bucket=")]) <= 2
    assert size(1) < size(0) / 4
    _merge(spark, path, 2, _batch(spark, [], 1))
    assert len(_table(spark, path)) == 2000


def test_a_batch_that_died_is_replayed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    _merge(spark, path, 0, _batch(spark, range(50), 1))
    rows = _batch(spark, range(10), 1)
    held = SN.manifest(spark, path)
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: 1 / 0 if schema == SN._MANIFEST else real(data, schema, **k))
    with pytest.raises(ZeroDivisionError):  # the data of batch 1 is written, its manifest is not
        _merge(spark, path, 1, rows)
    monkeypatch.undo()
    assert os.path.isdir(f"{path}/data/v=1") and SN.manifest(spark, path) == held
    assert set(_table(spark, path).values()) == {1}
    for _ in range(2):  # replayed, also after it has committed
        _merge(spark, path, 1, rows)
        assert _table(spark, path) == {k: 2 if k < 10 else 1 for k in range(50)}


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in range(5):
        _merge(spark, path, v, _batch(spark, range(30) if v == 0 else [v], 1))
    want = _table(spark, path)
    SN.vacuum(spark, path, keep=1)
    assert _table(spark, path) == want
    assert os.listdir(f"{path}/manifest") == ["v=4"]
    files = [f for _, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")]
    assert len(files) <= 16


# --- alert windows ------------------------------------------------------------------------
EVENT = "pid int, gid long, user_ref string, created_at timestamp_ntz, deleted smallint"
T0 = dt.datetime(2024, 1, 1)


def _alerts(spark, tmp_path, batches, rules):
    projects = spark.createDataFrame([(1,), (2,)], "id int")
    r = spark.createDataFrame(rules, "id int, project_id int, threshold int, condition int, timeframe int, status string")
    frame = spark.createDataFrame([(p, g, u, T0 + dt.timedelta(seconds=s), 0) for b in batches for p, g, u, s in b], EVENT)
    bounds = [T0 + dt.timedelta(seconds=max(x[3] for x in b)) for b in batches[:-1]]
    counts, state, ck = (str(tmp_path / n) for n in ("counts", "state", "ck"))
    ST.replay(frame, "created_at", len(batches), lambda s: ST.stream_alerts(s, r, projects, counts, state, ck), as_messages=True, bounds=bounds)
    rows = spark.read.parquet(state).orderBy("at").collect()
    out = {}
    for x in rows:
        out.setdefault(x["rule_id"], []).append((int((x["at"] - T0).total_seconds()), x["hit"], x["new_status"], x["transition"]))
    return out, SN.read(spark, f"{counts}/table")


def test_rules_resolve_by_timer(spark, tmp_path):
    """Project 1 falls silent: its window runs empty while only project 2 has events."""
    batches = [[(1, 10, f"u{i % 3}", i) for i in range(8)], [(2, 20, "a", 200)], [(2, 20, "a", 400), (2, 20, None, 401)]]
    rules = [(1, 1, 5, 1, 2, "Active"), (2, 1, 2, 2, 2, "Active"), (3, 2, 1, 1, 1, "Active"), (4, 1, 0, 1, 2, "Inactive"), (5, 9, 0, 1, 2, "Active")]
    got, counts = _alerts(spark, tmp_path, batches, rules)
    assert got[1] == [(7, True, "Triggered", "triggered"), (200, True, "Triggered", None), (401, False, "Active", "resolved")]
    assert got[2] == [(7, True, "Triggered", "triggered"), (200, True, "Triggered", None), (401, False, "Active", "resolved")]
    assert got[3][-1] == (401, True, "Triggered", "triggered")
    assert set(got) == {1, 2, 3}
    assert {(r["gid"], r["times_seen"], r["user_count"]) for r in counts.collect()} >= {(10, 0, 0)}


def test_windows_are_closed_at_both_ends(spark, tmp_path):
    """An event counts until the watermark is more than the timeframe (60 s) past it."""
    batches = [[(1, 10, "u", 0), (1, 10, "u", 1)], [(2, 1, "x", 60)], [(2, 1, "x", 61)], [(2, 1, "x", 62)]]
    _, counts = _alerts(spark, tmp_path, batches, [(1, 1, 0, 1, 1, "Active"), (2, 2, 0, 1, 1, "Active")])
    changes = spark.read.parquet(str(tmp_path / "counts" / "changes")).where("gid = 10").orderBy("at").collect()
    assert [(int((r["at"] - T0).total_seconds()), r["times_seen"], r["user_count"]) for r in changes] == [(1, 2, 1), (61, 1, 1), (62, 0, 0)]


def test_window_state_runs_once_a_batch(spark, tmp_path, monkeypatch):
    """The sink reads what it wrote, so the rows that the windows emit are computed once; an event without a time counts
    in no window."""
    emitted, real = spark.sparkContext.accumulator(0), AW.window_counts

    def seen(gid):
        emitted.add(1)
        return True

    monkeypatch.setattr(AW, "window_counts", lambda *a: real(*a).where(F.udf(seen, "boolean")("gid")))
    extra = spark.createDataFrame([(1, 10, "z", None, 0)], EVENT)
    replay = ST.replay
    monkeypatch.setattr(ST, "replay", lambda df, *a, **k: replay(df.unionByName(extra), *a, **k))
    got, counts = _alerts(spark, tmp_path, [[(1, 10, "u", 0), (1, 10, "v", 1)], [(1, 10, "u", 90)]], [(1, 1, 1, 2, 2, "Active")])
    assert got[1] == [(1, True, "Triggered", "triggered"), (90, True, "Triggered", None)]
    assert [(r["times_seen"], r["user_count"]) for r in counts.collect()] == [(3, 2)]
    assert emitted.value == spark.read.parquet(str(tmp_path / "counts" / "changes")).count() > 0


def test_replay_feeds_every_row_once(spark, tmp_path):
    df = spark.range(500).select("id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("created_at")).repartition(7)
    seen = []

    def run(stream):
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(
            lambda b, i: seen.append(sorted(r["id"] for r in b.collect()))).start()
        q.awaitTermination()

    ST.replay(df, "created_at", 4, run)
    seen = [x for x in seen if x]
    assert len(seen) == 4 and sum(seen, []) == list(range(500))


def test_events_are_published_once(spark, tmp_path):
    """A load batch that is replayed replaces its own files and leaves the others."""
    ev = A.ev(spark, SF_SMALL).drop("week")
    table = str(tmp_path / "t")
    for attempt, (part, prefix) in enumerate([("pid <= 2", "b0"), ("pid > 2", "b1"), ("pid > 2", "b1")]):
        staged = str(tmp_path / f"s{attempt}")
        L.write_events(ev.where(part), staged)
        ST.publish(spark, staged, table, prefix)
    back = spark.read.parquet(table)
    assert back.count() == ev.count() and back.select("event_id").distinct().count() == ev.select("event_id").distinct().count()
    assert {"week", "retention_days", "day"} <= set(back.columns)


def test_state_store_is_set_by_the_job(spark, tmp_path):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ST.json_stream(spark, str(tmp_path), spark.range(1).schema)
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
