"""Adapters: the driver's generic tables re-read as this engine's data model.

The driver ships TPC-H-like tables plus an ``events`` table.  Each adapter here
is a pure, row-local DataFrame expression (no shuffle, no driver collect) that
maps one of them onto a table of the error-event model, so that every operator
runs over data whose size grows with the input.  The same mappings are written
once more in DuckDB SQL (``faultline.oracle``) so every operator can be checked
against an independent engine.

Mapping rules (all deterministic):

* ``ev`` (event fact, one row per ``events`` row):
  pid = user_id % 5 + 1; created_at = ts truncated to the second;
  deleted = 1 when event_id % 97 = 0; event_id = md5(event_id);
  user_ref = '' when user_id % 10 = 0 else 'id:'+user_id;
  env by event_id % 3; release 'nordland@1.'+(event_id % 4)+'.0';
  level name by event_type; platform 'go'; message text built from
  event_type, user_id, a large number and the RFC 3339 time (so that the
  normalizer folds them into ~41 fingerprints); gid = issue_id(pid, md5 of the
  normalized message + level + platform); tags in ingest order (env, level,
  release, user, then custom k / os sorted by key).
* ``projects`` from ``nation``; ``teams`` from ``region``; ``accounts`` and
  ``members`` from ``customer``; ``comments`` from ``conversations``;
  ``assignment_feed`` from ``orders``; ``alert_rules`` from ``nation``;
  ``query_log`` from ``orders``; ``error_log`` from ``lineitem``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import columns as X
from faultline.functions.normalize import fingerprint, issue_id
from faultline.functions.frames import once, spread
from faultline.session import ensure_utc
from faultline.sources.tables import read_table

# Fixed clock of the fixtures: the events span 2024-01-01 .. 2024-01-30.
NOW = _dt.datetime(2024, 1, 31, 0, 0, 0)
WINDOW_FROM = NOW - _dt.timedelta(days=30)

# Fixed values of the adapter mapping.
ENVS = ["production", "staging", "development"]
LEVEL_BY_TYPE = {"error": "error", "click": "info", "view": "debug", "signup": "warning", "purchase": "fatal"}
OS_BY_MOD3 = {0: "linux", 1: "darwin"}  # event_id % 3 = 2 -> no os tag


#: Tables whose rows are parsed or normalized one by one, and how many stored bytes make one task (256 kB of ``events``
#: are some 13,000 rows, each of them an envelope of 2 kB).
PARSED = {"events": 1 << 18, "documents": 1 << 24}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    df = read_table(spark, f"{sf_dir}/{name}.parquet")
    return spread(df, PARSED[name]) if name in PARSED else df


def _kv(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def _nonempty(arr: Column) -> Column:
    return F.filter(arr, lambda t: t["value"] != "")


def level_name(event_type: Column) -> Column:
    out = F.lit("unknown")
    for k, v in reversed(LEVEL_BY_TYPE.items()):
        out = F.when(event_type == k, F.lit(v)).otherwise(out)
    return out


def ev_message(df: DataFrame) -> Column:
    """The raw message text of an adapted event."""
    big = (F.lit(1000000) + F.pmod(F.col("event_id") * 7919, F.lit(9000000))).cast("string")
    at = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.get_json_object("props", "$.k").cast("int")
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                  (F.col("event_id") % 256).cast("string"))
    return F.when(
        F.col("event_type") == "error",
        F.concat(F.lit("db error id="), F.col("user_id").cast("string"), F.lit(" conn "), ip,
                 F.lit(":5432 refused after "), big, F.lit(" ms at "), at),
    ).otherwise(
        F.concat(F.col("event_type"), F.lit(" failed id="), F.col("user_id").cast("string"), F.lit(" after "),
                 big, F.lit(" ms at "), at, F.lit(" step "), (k % 10).cast("string"))
    )


_EV_TABLES: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that the product keeps, written once per session in the shared folder and read back by every query."""
    from faultline.operators import layout as L

    ensure_utc(spark)
    key = (spark.sparkContext.applicationId, f"{sf_dir}#{name}")
    path = _EV_TABLES.get(key)
    if path is None:
        path = L.scratch_path(spark, f"{name}-table")
        build().write.parquet(path)
        _EV_TABLES[key] = path
    return spark.read.parquet(path)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table over ``events``, stored once per session.

    The first call runs the row-local mapping (normalization, fingerprint,
    tags) and writes the result as the partitioned, clustered event table
    (``layout.write_events``) under the shared checkpoint folder; later calls
    read that table, as every analytic query of the original reads its stored
    event table.  Reading also cuts the lineage of the mapping.
    """
    return as_events(spark.read.parquet(ev_path(spark, sf_dir)))


def ev_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the event table is stored; the first call writes it."""
    from faultline.operators import layout as L

    ensure_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _EV_TABLES.get(key)
    if path is None:
        path = L.scratch_path(spark, "event-table")
        L.write_events(ev_mapped(spark, sf_dir), path, mode="overwrite")
        _EV_TABLES[key] = path
    return path


def ev_indexed(spark: SparkSession, sf_dir: str) -> str:
    """The stored event table with its skipping index up to date."""
    from faultline.operators import skipping as SK

    path = ev_path(spark, sf_dir)
    SK.update_index(spark, path)
    return path


def as_events(stored: DataFrame) -> DataFrame:
    """Rows of the stored table in the event table's columns."""
    cols = [c for c in stored.columns if c not in ("retention_days", "week", "day")]
    return stored.select(*cols[:3], F.col("retention_days").cast("smallint").alias("retention_days"), *cols[3:],
                         "week")


def ev_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event fact table computed from ``events`` (the mapping itself)."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    os_name = F.when(F.col("event_id") % 3 == 0, F.lit(OS_BY_MOD3[0])).when(
        F.col("event_id") % 3 == 1, F.lit(OS_BY_MOD3[1])).otherwise(F.lit(""))
    env = F.element_at(F.array(*[F.lit(x) for x in ENVS]), (F.col("event_id") % 3 + 1).cast("int"))
    user_ref = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(
        F.concat(F.lit("id:"), F.col("user_id").cast("string")))
    base = e.select(
        (F.col("user_id") % 5 + 1).cast("int").alias("pid"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("event_id") % 97 == 0, 1).otherwise(0).cast("smallint").alias("deleted"),
        F.lit(90).cast("smallint").alias("retention_days"),
        F.md5(F.col("event_id").cast("string")).alias("event_id"),
        F.lit("go").alias("platform_name"),
        env.alias("env"),
        F.concat(F.lit("nordland@1."), (F.col("event_id") % 4).cast("string"), F.lit(".0")).alias("release"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                 (F.col("event_id") % 256).cast("string")).alias("ipv4"),
        F.lit("::1").alias("ipv6"),
        user_ref.alias("user_ref"),
        F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(
            F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))).alias("user_email"),
        F.lit("").alias("user_name"),
        F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("user_username"),
        F.lit(1).cast("smallint").alias("sdk_id"),
        F.lit("0.29.0").alias("sdk_version"),
        level_name(F.col("event_type")).alias("level_name"),
        ev_message(e).alias("message"),
        k.alias("k"),
        os_name.alias("os"),
    )
    tags = F.concat(
        _nonempty(F.array(_kv("env", F.col("env")), _kv("level", F.col("level_name")),
                          _kv("release", F.col("release")), _kv("user", F.col("user_ref")))),
        _nonempty(F.array(_kv("k", F.col("k")), _kv("os", F.col("os")))),
    )
    contexts = _nonempty(F.array(
        _kv("device.arch", F.lit("amd64")),
        _kv("device.num_cpu", (F.col("k").cast("int") % 8 + 1)),
        _kv("runtime.name", F.lit("go")),
        _kv("os.name", F.col("os")),
    ))
    fp = fingerprint(F.col("message"), F.col("level_name"), F.col("platform_name"), None)
    return base.select(
        "pid", "created_at", "deleted", "retention_days", "event_id",
        X.platform_code(F.col("platform_name")).alias("platform"),
        "env", "release", "ipv4", "ipv6", "user_ref", "user_email", "user_name", "user_username",
        "sdk_id", "sdk_version",
        tags.alias("tags"),
        contexts.alias("contexts"),
        "message",
        F.concat(F.col("message"), F.lit(": (No error message)")).alias("title"),
        X.level_code(F.col("level_name")).alias("level"),
        F.lit(1).cast("smallint").alias("type"),
        fp.alias("primary_hash"),
    ).withColumn("gid", issue_id(F.col("pid"), F.col("primary_hash")))


def live(events: DataFrame) -> DataFrame:
    """Rows not tombstoned."""
    return events.where(F.col("deleted") == 0)


# ---------------------------------------------------------------------------
# Raw envelopes (S1, T1-T19) over ``events``
# ---------------------------------------------------------------------------
def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SDK envelope per ``events`` row, as the ingest endpoint receives it.

    Columns: envelope_id (source event_id), project_id (URL text), auth
    (header), remote_addr, received_at, body (three lines; the event JSON is the
    third).  The body exercises every shape the ingest job accepts: exception
    lists as arrays or ``{"values": ...}``, string or number timestamps,
    thread-only stacks, custom tags, extra values of several JSON types - and
    the rejects: bad project id (i % 53 = 0), empty key (i % 41 = 0), unknown
    key (i % 41 = 1), two-line body (i % 50 = 1), broken JSON (i % 50 = 0),
    wrong JSON type (i % 50 = 2), bad client address (i % 89 = 0).
    """
    e = read(spark, sf_dir, "events")
    i, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    pid = (u % 5 + 1).cast("int")
    ts_text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    os_name = F.when(i % 3 == 0, F.lit("linux")).when(i % 3 == 1, F.lit("darwin")).otherwise(F.lit(""))
    platform = F.when(u % 7 == 0, F.lit("rust")).otherwise(F.lit("go"))

    def frame(function, module, abs_path, lineno, in_app, package=None):
        return F.struct(
            F.lit(function).alias("function"),
            (module if isinstance(module, Column) else F.lit(module)).alias("module"),
            F.lit(package).cast("string").alias("package"),
            F.lit(abs_path).alias("abs_path"),
            lineno.cast("bigint").alias("lineno"),
            (in_app if isinstance(in_app, Column) else F.lit(in_app)).alias("in_app"),
        )

    frames = F.array(
        frame("main", "main", "/app/cmd/main.go", F.lit(10) + k % 40, True),
        frame("run", F.when(t == "signup", F.lit("")).otherwise(F.lit("app/db")), "/app/db/db.go",
              F.lit(100) + i % 9, i % 4 != 3, package="app/pkg"),
        frame("CaptureException", "github.com/getsentry/sentry-go", "sentry.go", F.lit(55), False),
    )

    def exc(type_, value, frs):
        return F.struct(type_.alias("type"), value.alias("value"), F.struct(frs.alias("frames")).alias("stacktrace"))

    empty_frames = F.array().cast("array<struct<function:string,module:string,package:string,abs_path:string,"
                                  "lineno:bigint,in_app:boolean>>")
    main_exc = exc(F.when(t == "error", F.lit("DBError")).otherwise(F.lit("")),
                   F.concat(F.lit("query failed id="), u.cast("string"), F.lit(" at "), ts_text), frames)
    no_frames = exc(F.lit("*net.OpError"), F.lit("dial tcp 10.0.0.1:5432: connection refused"), empty_frames)
    second = exc(F.lit("*errors.errorString"), F.lit("wrapped id=7"), F.array(
        frame("wrap", "app/errs", "/app/errs/wrap.go", F.lit(31), True)))
    exceptions = (
        F.when((t == "error") & (i % 4 == 0), F.array(no_frames, main_exc))
        .when((t == "error") & (i % 4 == 2), F.array(main_exc, second))
        .when(t.isin("error", "signup"), F.array(main_exc))
        .when((t == "purchase") & (i % 5 == 0), F.array(exc(F.lit(""), F.lit(""), empty_frames)))
    )
    tframes1 = F.array(frame("handle", "", "/app/web/h.go", F.lit(20) + k % 5, True, package="app/web"),
                       frame("serve", "net/http", "/usr/go/net/http/server.go", F.lit(2000), False))
    tframes3 = F.array(frame("loop", "app/bg", "/app/bg/loop.go", F.lit(7), True))

    def thread(tid, name, current, frs):
        return F.struct(F.lit(tid).alias("id"), F.lit(name).alias("name"), current.alias("current"),
                        F.struct(frs.alias("frames")).alias("stacktrace"))

    threads = F.when(t == "click", F.array(
        thread("1", "main", i % 3 == 0, tframes1),
        thread("2", "worker", F.lit(True), empty_frames),
        thread("3", "bg", i % 3 == 1, tframes3),
    ))

    def list_json(arr: Column) -> Column:
        txt = F.to_json(arr)
        return F.when(arr.isNull(), F.lit(None)).when(i % 2 == 0, txt).otherwise(
            F.concat(F.lit('{"values":'), txt, F.lit("}")))

    user = F.struct(
        F.when(u % 10 == 0, F.lit("")).otherwise(u.cast("string")).alias("id"),
        F.concat(F.lit("user"), u.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("10.1."), (u % 256).cast("string"), F.lit(".1")).alias("ip_address"),
        F.concat(F.lit("user"), u.cast("string")).alias("username"),
    )
    fixed = F.struct(
        F.when(i % 17 == 0, F.lit("")).otherwise(F.md5(i.cast("string"))).alias("event_id"),
        level_name(t).alias("level"),
        platform.alias("platform"),
        ev_message(e).alias("message"),
        F.element_at(F.array(*[F.lit(x) for x in ENVS]), (i % 3 + 1).cast("int")).alias("environment"),
        F.concat(F.lit("nordland@1."), (i % 4).cast("string"), F.lit(".0")).alias("release"),
        F.concat(F.lit("host-"), (u % 4).cast("string")).alias("server_name"),
        user.alias("user"),
        F.struct(F.when(platform == "rust", F.lit("sentry.rust")).otherwise(F.lit("sentry.go")).alias("name"),
                 F.lit("0.29.0").alias("version")).alias("sdk"),
        F.create_map(F.lit("k"), k.cast("string"), F.lit("os"), os_name).alias("tags"),
        F.struct(
            F.struct(F.lit("amd64").alias("arch"), (k % 8 + 1).alias("num_cpu")).alias("device"),
            F.struct(F.lit("go").alias("name"), F.lit("go1.22.1").alias("version"),
                     F.lit(8).alias("go_maxprocs"), F.lit(0).alias("go_numcgocalls"),
                     (k % 20).alias("go_numroutines")).alias("runtime"),
            F.struct(os_name.alias("name")).alias("os"),
        ).alias("contexts"),
    )
    extra = F.concat(F.lit('{"attempt":'), (k % 3).cast("string"), F.lit(',"note":"step '),
                     (k % 10).cast("string"), F.lit('","flags":{"retry":'),
                     F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")), F.lit("}}"))
    ts_json = F.when(i % 2 == 0, F.concat(F.lit('"'), ts_text, F.lit('"'))).otherwise(
        F.format_string("%.3f", F.unix_millis(F.col("ts").cast("timestamp")) / F.lit(1000.0)))
    # In two steps: each JSON text is read several times below.
    e = once(e, _exc=exceptions, _thr=threads)
    e = once(e, _fixed=F.to_json(fixed), _exc_json=list_json(F.col("_exc")), _thr_json=list_json(F.col("_thr")))
    fixed_json, exc_json, thr_json = F.col("_fixed"), F.col("_exc_json"), F.col("_thr_json")
    level_bad = F.regexp_replace(fixed_json, r'"level":"[a-z]+"', '"level":5')
    event_json = F.concat(
        F.lit('{"timestamp":'), ts_json,
        F.when(exc_json.isNotNull(), F.concat(F.lit(',"exception":'), exc_json)).otherwise(F.lit("")),
        F.when(thr_json.isNotNull(), F.concat(F.lit(',"threads":'), thr_json)).otherwise(F.lit("")),
        F.lit(',"extra":'), extra, F.lit(","),
        F.substring(F.when(i % 50 == 2, level_bad).otherwise(fixed_json), 2, 1 << 30),
    )
    line0 = F.concat(F.lit('{"event_id":"'), F.md5(i.cast("string")), F.lit('","sent_at":"'), ts_text, F.lit('"}'))
    line1 = F.lit('{"type":"event"}')
    line2 = F.when(i % 50 == 0, F.lit('{"event_id": "broken')).otherwise(event_json)
    body = F.when(i % 50 == 1, F.concat_ws("\n", line0, line1)).otherwise(
        F.concat(F.concat_ws("\n", line0, line1, line2), F.when(i % 2 == 0, F.lit("\n")).otherwise(F.lit(""))))
    auth = (
        F.when(i % 41 == 0, F.lit("Sentry sentry_key=, sentry_version=7"))
        .when(i % 41 == 1, F.lit("Sentry sentry_version=7, sentry_key=nokey"))
        .otherwise(F.concat(F.lit("Sentry sentry_version=7, sentry_key=key"), pid.cast("string"),
                            F.lit(", sentry_client=sentry.go/0.29.0")))
    )
    remote = (
        F.when(i % 89 == 0, F.lit("not-an-ip"))
        .when(i % 13 == 0, F.concat(F.lit("[2001:db8::"), (i % 99 + 1).cast("string"), F.lit("]:443")))
        .otherwise(F.concat(F.lit("10.1."), (u % 256).cast("string"), F.lit("."), (i % 256).cast("string"),
                            F.lit(":"), (F.lit(40000) + i % 1000).cast("string")))
    )
    project_id = F.when(i % 53 == 0, F.concat(F.lit("p"), pid.cast("string"))).otherwise(pid.cast("string"))
    return e.select(
        i.alias("envelope_id"), project_id.alias("project_id"), auth.alias("auth"), remote.alias("remote_addr"),
        F.col("ts").alias("received_at"), body.alias("body"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects from ``supplier``: id = s_suppkey + 1, key 'key<id>', team = nation % 5 + 1."""
    sp = read(spark, sf_dir, "supplier")
    pid = (F.col("s_suppkey") + 1).cast("int")
    return sp.select(
        pid.alias("id"),
        F.concat(F.lit("project-"), F.lower(F.col("s_name"))).alias("name"),
        F.concat(F.lit("key"), pid.cast("string")).alias("key"),
        F.when(pid % 2 == 0, F.lit(2)).otherwise(F.lit(1)).cast("smallint").alias("platform"),
        (F.col("s_nationkey") % 5 + 1).cast("int").alias("team_id"),
        (X.ts_lit(NOW) - F.make_dt_interval(F.lit(0) + (pid * 10) % 1000)).cast("timestamp_ntz").alias("created_at"),
    )


# ---------------------------------------------------------------------------
# Relational tables (teams, accounts, members, comments, assignments, alerts)
# ---------------------------------------------------------------------------
N_USERS = 150  # fixed: every scale factor has at least 150 customers


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    return r.select((F.col("r_regionkey") + 1).cast("int").alias("id"), F.lower("r_name").alias("name"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    uid = F.col("c_custkey") + 1
    return c.select(uid.alias("id"), F.concat(F.lit("user"), uid.cast("string")).alias("username"),
                    F.concat(F.lit("user"), uid.cast("string"), F.lit("@example.com")).alias("email"),
                    F.col("c_name").alias("name"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_relation: every customer in team (nation % 5) + 1; every 7th also in the next team."""
    c = read(spark, sf_dir, "customer")
    uid = F.col("c_custkey") + 1
    team = (F.col("c_nationkey") % 5 + 1).cast("int")
    first = c.select(uid.alias("user_id"), team.alias("team_id"))
    second = c.where(F.col("c_custkey") % 7 == 0).select(uid.alias("user_id"), (team % 5 + 1).cast("int")
                                                         .alias("team_id"))
    return first.unionByName(second)


def _event_gids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source event id, issue id) of every adapted event."""
    e = ev(spark, sf_dir)
    return e.select("event_id", "gid", "pid")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue discussion messages from ``conversations``: the conversation with id c
    discusses the issue of event c; authors cycle over the accounts."""
    return _stored(spark, sf_dir, "comments", lambda: _comments(spark, sf_dir))


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = read(spark, sf_dir, "conversations")
    g = _event_gids(spark, sf_dir)
    j = cv.join(g, F.md5(cv.conv_id.cast("string")) == g.event_id)
    return j.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.col("gid").alias("issue_id"),
        ((F.col("conv_id") * 7 + F.col("turn")) % N_USERS + 1).alias("user_id"),
        (X.ts_lit(NOW) - F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.lit(0))
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).cast("timestamp_ntz").alias("created_at"),
        F.col("text").alias("content"),
        F.array((F.col("conv_id") % N_USERS + 1), ((F.col("conv_id") + F.col("turn")) % N_USERS + 1),
                (F.col("conv_id") % N_USERS + 1)).alias("mentions"),
    )


def assignment_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assign / unassign requests from ``orders``: order o concerns the issue of event
    o mod (number of events), so every order is a request."""
    return _stored(spark, sf_dir, "assignment_feed", lambda: _assignment_feed(spark, sf_dir))


def _assignment_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    g = _event_gids(spark, sf_dir)
    n_events = g.count()  # one scalar: orders wrap around the events so every order is used
    j = o.join(g, F.md5((o.o_orderkey % F.lit(n_events)).cast("string")) == g.event_id)
    return j.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("gid").alias("issue_id"),
        (F.col("o_custkey") % N_USERS + 1).alias("user_id"),
        (F.col("o_orderkey") % N_USERS + 1).alias("assigned_by"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400))
        .cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit("delete")).otherwise(F.lit("assign")).alias("action"),
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rules from ``part``: rule k watches project k % 5 + 1 and belongs to that
    project's team; threshold, condition, timeframe and status cycle with k."""
    pt = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    status = F.element_at(F.array(F.lit("Active"), F.lit("Inactive"), F.lit("Triggered")), (k % 3 + 1).cast("int"))
    rules = pt.select(
        (k + 1).cast("int").alias("id"),
        (k % 5 + 1).cast("int").alias("project_id"),
        F.concat(F.lit("rule-"), (k + 1).cast("string")).alias("rule_name"),
        ((k * 13) % 40 - 3).cast("int").alias("threshold"),
        (k % 2 + 1).cast("int").alias("condition"),
        (k % 7 + 1).cast("int").alias("timeframe"),
        status.alias("status"),
        (k % 2 == 0).alias("high_priority"),
        (X.ts_lit(NOW) - F.make_dt_interval(secs=(k * 97) % 2592000)).cast("timestamp_ntz").alias("created_at"),
    )
    teams_of = projects(spark, sf_dir).select(F.col("id").alias("project_id"), "team_id")
    return rules.join(teams_of, "project_id")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels per team: a webhook (enabled) and an email one (enabled on even regions)."""
    r = read(spark, sf_dir, "region")
    k = F.col("r_regionkey")
    hook = r.select((k * 2 + 1).cast("int").alias("id"), (k + 1).cast("int").alias("team_id"),
                    F.lit("webhook").alias("channel_type"), F.lit(True).alias("enabled"),
                    (X.ts_lit(NOW) - F.make_dt_interval(F.lit(1) + k.cast("int"))).cast("timestamp_ntz")
                    .alias("created_at"))
    mail = r.select((k * 2 + 2).cast("int").alias("id"), (k + 1).cast("int").alias("team_id"),
                    F.lit("email").alias("channel_type"), (k % 2 == 0).alias("enabled"),
                    (X.ts_lit(NOW) - F.make_dt_interval(F.lit(0) + k.cast("int"))).cast("timestamp_ntz")
                    .alias("created_at"))
    return hook.unionByName(mail)


def webhook_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs of the webhook channels; region 4 has none, regions 0 and 3 are unverified."""
    r = read(spark, sf_dir, "region").where(F.col("r_regionkey") != 4)
    k = F.col("r_regionkey")
    return r.select((k * 2 + 1).cast("int").alias("channel_id"),
                    F.concat(F.lit("https://hooks.example.com/"), F.lower("r_name")).alias("url"),
                    (k % 3 != 0).alias("verified"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue table of the adapted events (what ingest's upsert builds from them)."""
    return _stored(spark, sf_dir, "issues", lambda: _issues(spark, sf_dir))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev(spark, sf_dir)
    return e.groupBy(F.col("gid").alias("id"), F.col("pid").alias("project_id"), F.col("primary_hash").alias("hash")
                     ).agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.lit("(No error message)").alias("message"),
        F.max_by("message", F.struct("created_at", "event_id")).alias("error_type"),
        F.lit("").alias("view"), F.lit(3).alias("priority"), F.lit(0).cast("bigint").alias("num_comments"))


# ---------------------------------------------------------------------------
# System logs for the reports (Q19, Q20)
# ---------------------------------------------------------------------------
QUERY_LOG_NOW = _dt.datetime(2001, 8, 2)
ERROR_LOG_SINCE = _dt.datetime(2001, 1, 1)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    kind = F.substring("o_orderpriority", 1, 1)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    query = (
        F.when(kind == "1", F.concat(F.lit("SELECT count() FROM event WHERE pid = "), (cust % 10).cast("string")))
        .when(kind == "2", F.concat(F.lit("SELECT * FROM event WHERE gid = "), cust.cast("string"),
                                    F.lit(" AND env = '"), F.col("o_orderstatus"), F.lit("'")))
        .when(kind == "3", F.concat(F.lit("INSERT INTO event VALUES ("), key.cast("string"), F.lit(", 'x')")))
        .when(kind == "4", F.concat(F.lit("SELECT gid FROM event  WHERE created_at > "), (key % 1000).cast("string"),
                                    F.lit(".5")))
        .otherwise(F.lit("SELECT 1"))
    )
    return o.select(
        query.alias("query"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=key % 86400)).cast("timestamp_ntz").alias("event_time"),
        (F.floor("o_totalprice").cast("bigint") % 5000).alias("query_duration_ms"),
        (cust % 100).alias("result_rows"),
        F.floor(F.col("o_totalprice") * 10).cast("bigint").alias("read_bytes"),
        F.when(key % 10 == 0, 1).otherwise(2).alias("type"),
        (key % 7 != 0).alias("is_initial_query"),
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("ERR_"), F.col("l_returnflag"), F.lit("_"), F.col("l_linestatus"), F.lit("_"),
                 (F.col("l_linenumber") % 3).cast("string")).alias("name"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_orderkey") % 86400)).cast("timestamp_ntz")
        .alias("last_error_time"),
    )


def ev_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev`` plus a re-delivered copy of about 3/16 of it with the tombstone flag
    flipped and a later ingest sequence (for the version dedup, L2 / R2)."""
    e = ev(spark, sf_dir).withColumn("ingest_seq", F.lit(0))
    again = e.where(F.substring("event_id", 1, 1).isin("0", "1", "2")).withColumn(
        "deleted", (F.lit(1) - F.col("deleted")).cast("smallint")).withColumn("ingest_seq", F.lit(1))
    return e.unionByName(again)


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches from ``nation``: one per nation, project (n % 5) + 1, window of the
    last n + 1 days, query text by template n % 4."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    query = (
        F.when(k % 4 == 0, F.lit('level:error "refused"'))
        .when(k % 4 == 1, F.lit("env:!staging os:linux"))
        .when(k % 4 == 2, F.concat(F.lit('"FAILED id" k:'), ((k * 3) % 100).cast("string")))
        .otherwise(F.concat(F.lit("release:'nordland@1."), (k % 4).cast("string"), F.lit(".0' level:!info")))
    )
    return n.select(
        k.cast("bigint").alias("search_id"), (k % 5 + 1).cast("int").alias("pid"), query.alias("query"),
        (X.ts_lit(NOW) - F.make_dt_interval(days=(k + 1).cast("int"))).alias("frm"), X.ts_lit(NOW).alias("to"))


def part_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches from ``part``, so that they grow with the data: project (k % 5) + 1, window of the last
    k % 30 + 1 days, query text by template k % 5."""
    pt = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = lambda n: (k % n).cast("string")
    level = F.element_at(F.array(F.lit("error"), F.lit("info"), F.lit("debug")), (k % 3 + 1).cast("int"))
    query = (
        F.when(k % 5 == 0, F.concat(F.lit("user:id:"), text(1000)))
        .when(k % 5 == 1, F.concat(F.lit("k:"), text(100), F.lit(" os:linux")))
        .when(k % 5 == 2, F.concat(F.lit('"ID='), text(1000), F.lit(' "')))
        .when(k % 5 == 3, F.concat(F.lit('"Refused" release:nordland@1.'), text(4), F.lit(".0 level:!info")))
        .otherwise(F.concat(F.lit("env:!staging level:!"), level))
    )
    return pt.select(
        k.cast("bigint").alias("search_id"), (k % 5 + 1).cast("int").alias("pid"), query.alias("query"),
        (X.ts_lit(NOW) - F.make_dt_interval(days=(k % 30 + 1).cast("int"))).alias("frm"), X.ts_lit(NOW).alias("to"))
