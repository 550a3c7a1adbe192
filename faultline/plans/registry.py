"""Named queries: one Spark job and (where SQL can express it) one DuckDB oracle each.

Each Spark callable takes ``(spark, sf_dir)``, reads the driver's tables through
the adapters, runs the operator over the *whole* tables and returns a
DataFrame of scalar columns (arrays are rendered as text) whose names equal the
oracle's.  Time windows are the operators' own parameters: the fixtures span
``WINDOW_FROM .. NOW`` so the windows below cover every event.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import oracle as O
from faultline.functions import normalize as N
from faultline.functions import predicates as P
from faultline.functions import columns as X
from faultline.operators import analytics as Q
from faultline.operators import layout as L
from faultline.operators import rollup as RU
from faultline.operators import skipping as SK
from faultline.sources import adapters as A

FRM, NOW = A.WINDOW_FROM, A.NOW
SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def tags_text(c: str = "tags"):
    return F.array_join(F.transform(F.col(c), lambda t: F.concat(t["key"], F.lit("="), t["value"])), ",")


# --- T7 / T9 ------------------------------------------------------------------
@register("normalize_message", f"""
SELECT doc_id, md5({O.norm('text')}) AS norm_md5, length({O.norm('text')}) AS norm_len FROM documents""")
def _normalize_message(spark, d):
    docs = A.read(spark, d, "documents")
    n = N.normalize_message(F.col("text"))
    return docs.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("bigint").alias("norm_len"))


# --- Q1-Q13 --------------------------------------------------------------------
_RANGE_HALF = f"created_at >= {O.T_FROM} AND created_at < {O.T_NOW}"
_RANGE_CLOSED = f"created_at >= {O.T_FROM} AND created_at <= {O.T_NOW}"


@register("events_per_hour", O.sql(f"""
SELECT date_trunc('hour', created_at) AS ts, pid, count(*) AS event_count FROM live
WHERE {_RANGE_HALF} GROUP BY 1, 2"""))
def _events_per_hour(spark, d):
    return Q.events_per_hour(A.ev(spark, d), FRM, NOW)


@register("issue_metrics", O.sql(f"""
SELECT gid, count(*) AS times_seen, min(created_at) AS first_seen, max(created_at) AS last_seen,
       count(DISTINCT nullif(user_ref, '')) AS user_count
FROM live WHERE {_RANGE_CLOSED} GROUP BY gid"""))
def _issue_metrics(spark, d):
    return Q.issue_metrics(A.ev(spark, d), FRM, NOW)


# The rollup answers windows that cut hours: both ends lie inside an hour.
_CUT_FROM, _CUT_TO = FRM + _dt.timedelta(days=2, hours=3, minutes=17, seconds=5), NOW - _dt.timedelta(days=3, minutes=41)
_CUT = f"created_at >= TIMESTAMP '{_CUT_FROM:%Y-%m-%d %H:%M:%S}' AND created_at <= TIMESTAMP '{_CUT_TO:%Y-%m-%d %H:%M:%S}'"


def _rollup_rows(spark, d):
    """The rollup stored in two batches, read back for the cut window."""
    path, ev = L.scratch_path(spark, "rollup"), A.ev(spark, d)
    half = X.ts_lit(FRM + _dt.timedelta(days=14, minutes=30))  # one hour comes in both batches
    RU.append(ev.where(F.col("created_at") < half), path)
    RU.append(ev.where(F.col("created_at") >= half), path)
    return RU.window(RU.read(spark, path), ev, _CUT_FROM, _CUT_TO, closed_upper=True)


@register("issue_metrics_approx", O.sql(f"""
SELECT gid, count(*) AS times_seen, min(created_at) AS first_seen, max(created_at) AS last_seen,
       count(DISTINCT nullif(user_ref, '')) AS users, true AS within_error
FROM live WHERE {_CUT} GROUP BY gid"""))
def _issue_metrics_approx(spark, d):
    """Sketch estimates next to exact counts: the error stays within three standard errors (one user at least)."""
    est = RU.issue_metrics(_rollup_rows(spark, d))
    exact = Q.issue_metrics(A.ev(spark, d), _CUT_FROM, _CUT_TO).select("gid", F.col("user_count").alias("users"))
    within = F.abs(F.col("user_count") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * RU.USER_ERROR)
    return est.join(exact, "gid", "full").select("gid", "times_seen", "first_seen", "last_seen", "users", within.alias("within_error"))


@register("rollup_events_per_hour", O.sql(f"""
SELECT date_trunc('hour', created_at) AS ts, pid, count(*) AS event_count FROM live WHERE {_CUT} GROUP BY 1, 2"""))
def _rollup_events_per_hour(spark, d):
    return RU.events_per_hour(_rollup_rows(spark, d))


@register("rollup_events_per_day", O.sql(f"""
SELECT gid, CAST(CAST(created_at AS DATE) AS TIMESTAMP) AS day, count(*) AS event_count FROM live WHERE {_CUT} GROUP BY 1, 2"""))
def _rollup_events_per_day(spark, d):
    return RU.events_per_day(_rollup_rows(spark, d)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@register("events_per_day", O.sql(f"""
SELECT gid, CAST(CAST(created_at AS DATE) AS TIMESTAMP) AS day, count(*) AS event_count FROM live
WHERE {_RANGE_HALF} GROUP BY 1, 2"""))
def _events_per_day(spark, d):
    return Q.events_per_day(A.ev(spark, d), FRM, NOW).withColumn("day", F.col("day").cast("timestamp_ntz"))


@register("issue_totals_30d_24h", O.sql(f"""
SELECT gid, CAST(sum(event_count) AS BIGINT) AS total_30d, CAST(arg_max(event_count, day) AS BIGINT) AS total_24h
FROM (SELECT gid, CAST(created_at AS DATE) AS day, count(*) AS event_count FROM live
      WHERE {_RANGE_HALF} GROUP BY 1, 2) GROUP BY gid"""))
def _issue_totals(spark, d):
    return Q.issue_totals(Q.events_per_day(A.ev(spark, d), FRM, NOW))


_TV_AGG = f"""tv AS (SELECT gid, tag, value, count(*) AS event_count, min(created_at) AS first_seen,
       max(created_at) AS last_seen FROM tagrows WHERE {_RANGE_HALF} GROUP BY 1, 2, 3),
tv4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid, tag ORDER BY event_count DESC, value) AS r1
        FROM tv) WHERE r1 <= 4),
tvk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY event_count DESC, tag, value) AS r2
        FROM tv4) WHERE r2 <= 1000)"""


@register("tag_value_counts", O.sql(
    "SELECT gid, tag, value, event_count, first_seen, last_seen FROM tvk", _TV_AGG))
def _tag_value_counts(spark, d):
    return Q.tag_value_counts(A.ev(spark, d), FRM, NOW)


@register("tag_key_counts", O.sql(f"""
SELECT gid, tag, event_count FROM (
  SELECT *, row_number() OVER (PARTITION BY gid ORDER BY event_count DESC, tag) AS r FROM (
    SELECT gid, tag, count(*) AS event_count FROM tagrows WHERE {_RANGE_HALF} GROUP BY 1, 2)) WHERE r <= 1000"""))
def _tag_key_counts(spark, d):
    return Q.tag_key_counts(A.ev(spark, d), FRM, NOW)


@register("tag_value_percent", O.sql("""
SELECT tvk.gid, tvk.tag, value, event_count, first_seen, last_seen, tk.tag_count,
       round(CASE WHEN tk.key_rank <= 1000 THEN event_count / tk.tag_count * 100 ELSE 0 END, 6) AS percent,
       CAST(floor(CASE WHEN tk.key_rank <= 1000 THEN event_count / tk.tag_count * 100 ELSE 0 END) AS BIGINT)
         AS percent_floor
FROM tvk LEFT JOIN tk ON tvk.gid = tk.gid AND tvk.tag = tk.tag""", _TV_AGG + f""",
tk AS (SELECT gid, tag, tag_count, row_number() OVER (PARTITION BY gid ORDER BY tag_count DESC, tag) AS key_rank
       FROM (SELECT gid, tag, CAST(sum(event_count) AS BIGINT) AS tag_count FROM tv GROUP BY 1, 2))"""))
def _tag_value_percent(spark, d):
    return Q.tag_value_percent(A.ev(spark, d), FRM, NOW)


@register("issue_event_detail", O.sql(f"""
SELECT gid, replace(arg_max(event_id, (created_at, event_id)), '-', '') AS event_id,
       max(created_at) AS created_at,
       arg_max(message, (created_at, event_id)) AS message, arg_max(title, (created_at, event_id)) AS title,
       arg_max(env, (created_at, event_id)) AS env, arg_max(release, (created_at, event_id)) AS release,
       arg_max(user_ref, (created_at, event_id)) AS user_ref,
       arg_max({O.tags_text()}, (created_at, event_id)) AS tags_text
FROM live WHERE {_RANGE_HALF} GROUP BY gid"""))
def _issue_event_detail(spark, d):
    return Q.issue_event_detail(A.ev(spark, d), FRM, NOW).select(
        "gid", "event_id", "created_at", "message", "title", "env", "release", "user_ref",
        tags_text().alias("tags_text"))


_EL_FILTER = f"{O.contains_ci('message', O.q('FAILED'))} AND NOT {O.has_tag('tags', O.q('env'), O.q('staging'))}"


@register("event_list", O.sql(f"""
SELECT gid, replace(event_id, '-', '') AS event_id, created_at, title, message, release, env, user_ref, user_email,
       user_username, user_name,
       coalesce(list_filter(tags, lambda t: t.key = 'os')[1].value, '') AS os,
       coalesce(nullif(user_email, ''), nullif(user_username, ''), nullif(user_ref, ''), nullif(user_name, ''),
                '(no value)') AS display_user,
       rn
FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY created_at DESC, event_id DESC) AS rn FROM live
      WHERE {_RANGE_HALF} AND {_EL_FILTER}) WHERE rn > 0 AND rn <= 50"""))
def _event_list(spark, d):
    return Q.event_list(A.ev(spark, d), FRM, NOW, message="FAILED", tags={"env": ("staging", True)})


@register("event_count", O.sql(f"""
SELECT gid, count(*) AS event_count FROM live WHERE {_RANGE_HALF} AND {_EL_FILTER} GROUP BY gid"""))
def _event_count(spark, d):
    return Q.event_count(A.ev(spark, d), FRM, NOW, message="FAILED", tags={"env": ("staging", True)})


@register("event_neighbors", O.sql(f"""
SELECT pid, gid, created_at, event_id,
  nullif(last_value(event_id) OVER w_all, event_id) AS first_id,
  nullif(first_value(event_id) OVER w_all, event_id) AS last_id,
  lag(event_id) OVER w AS next_id,
  lead(event_id) OVER w AS prev_id
FROM live WHERE {_RANGE_CLOSED}
WINDOW w AS (PARTITION BY gid ORDER BY created_at, event_id),
       w_all AS (PARTITION BY gid ORDER BY created_at, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""))
def _event_neighbors(spark, d):
    return Q.event_neighbors(A.ev(spark, d), FRM, NOW)


@register("field_filters", O.sql(f"""
SELECT tag, value FROM (SELECT tag, value, count(*) AS freq FROM tagrows WHERE {_RANGE_HALF} GROUP BY 1, 2
ORDER BY freq DESC, tag, value LIMIT 1000)"""))
def _field_filters(spark, d):
    return Q.field_filters(A.ev(spark, d), FRM, NOW)


@register("popular_tags", O.sql(f"""
SELECT tag, count(*) AS event_count FROM tagrows WHERE {_RANGE_CLOSED} GROUP BY 1
ORDER BY event_count DESC, tag LIMIT 1000"""))
def _popular_tags(spark, d):
    return Q.popular_tags(A.ev(spark, d), FRM, NOW)


@register("tag_values", O.sql(f"""
SELECT tag, value, event_count FROM (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY event_count DESC, value) AS r FROM (
    SELECT tag, value, count(*) AS event_count FROM tagrows WHERE {_RANGE_CLOSED} GROUP BY 1, 2)) WHERE r <= 100"""))
def _tag_values(spark, d):
    return Q.tag_values(A.ev(spark, d), FRM, NOW)


_GS_QUERY = 'level:error "REFUSED" os:!darwin'
_GS_FILTER = (f"{O.has_tag('tags', O.q('level'), O.q('error'))} AND "
              f"({O.contains_ci('message', O.q('REFUSED'))} OR {O.contains_ci('title', O.q('REFUSED'))}) AND NOT "
              f"{O.has_tag('tags', O.q('os'), O.q('darwin'))}")


@register("filtered_groups", O.sql(f"SELECT DISTINCT gid FROM live WHERE {_RANGE_CLOSED} AND {_GS_FILTER}"))
def _filtered_groups(spark, d):
    tokens = P.parse_query(_GS_QUERY)
    ev = A.as_events(SK.read_where(spark, A.ev_indexed(spark, d), FRM, NOW, tags=P.tag_probes(tokens)))
    return Q.filtered_groups(ev, tokens, FRM, NOW)


@register("tag_lookup", O.sql(f"""
SELECT replace(event_id, '-', '') AS event_id, gid, created_at FROM live
WHERE {_RANGE_CLOSED} AND {O.has_tag('tags', O.q('user'), O.q('id:42'))} AND {O.has_tag('tags', O.q('os'), O.q('linux'))}"""))
def _tag_lookup(spark, d):
    """Events of one user on one system: files without both tags are not read."""
    tokens = P.parse_query("user:id:42 os:linux")
    ev = A.as_events(SK.read_where(spark, A.ev_indexed(spark, d), FRM, NOW, tags=P.tag_probes(tokens)))
    ev = Q.live_between(ev, FRM, NOW, True).where(P.group_search_predicate(tokens, F.col("message"), F.col("title"), F.col("tags")))
    return ev.select(X.id_no_dashes(F.col("event_id")).alias("event_id"), "gid", "created_at")


@register("issue_lookup", O.sql(f"""
SELECT gid, count(*) AS times_seen, min(created_at) AS first_seen, max(created_at) AS last_seen,
       count(DISTINCT nullif(user_ref, '')) AS user_count
FROM live WHERE {_RANGE_CLOSED} AND gid IN (SELECT DISTINCT gid FROM ev ORDER BY gid LIMIT 3) GROUP BY gid"""))
def _issue_lookup(spark, d):
    """Metrics of three issues by an id list: files without any of them are not read."""
    gids = [r["gid"] for r in A.ev(spark, d).select("gid").distinct().orderBy("gid").limit(3).collect()]  # the request's ids
    ev = A.as_events(SK.read_where(spark, A.ev_indexed(spark, d), FRM, NOW, gids=gids))
    return Q.issue_metrics(ev, FRM, NOW, gids=gids)


@register("text_search", O.sql(f"""
SELECT pid, count(*) AS event_count FROM live WHERE {O.contains_ci('message', O.q('DB Error ID=1'))} GROUP BY pid"""))
def _text_search(spark, d):
    ev = A.live(A.ev(spark, d))
    return ev.where(P.contains_ci(F.col("message"), "DB Error ID=1")).groupBy("pid").agg(
        F.count(F.lit(1)).alias("event_count"))


@register("tag_filter", O.sql(f"""
SELECT gid, CAST(sum(CASE WHEN {O.has_tag('tags', O.q('k'), O.q('42'))} THEN 1 ELSE 0 END) AS BIGINT) AS with_k42,
       CAST(sum(CASE WHEN NOT {O.has_tag('tags', O.q('os'), O.q('linux'))} THEN 1 ELSE 0 END) AS BIGINT)
         AS without_linux
FROM live GROUP BY gid"""))
def _tag_filter(spark, d):
    ev = A.live(A.ev(spark, d))
    return ev.groupBy("gid").agg(
        F.sum(F.when(P.tag_filter(F.col("tags"), "k", "42"), 1).otherwise(0)).cast("bigint").alias("with_k42"),
        F.sum(F.when(P.tag_filter(F.col("tags"), "os", "linux", negate=True), 1).otherwise(0)).cast("bigint")
        .alias("without_linux"),
    )


# --- S1, T1-T19: ingest over raw envelopes ------------------------------------------
from faultline.operators import ingest as I  # noqa: E402
from faultline.sources import envelope as S  # noqa: E402

_PARSED_OK = ("status NOT IN ('invalid project identifier', 'invalid dsn', 'premature end of input', "
              "'invalid event body')")


def _ingested(spark, d):
    raw = A.raw_envelopes(spark, d)
    rows, rejects = I.ingest(raw, A.projects(spark, d), carry=("envelope_id", "event"))
    return raw, rows, rejects


def _raw_sql(body: str) -> str:
    return O.sql(body, O.raw_ctes())


@register("ingest_envelope_parse", _raw_sql("SELECT i AS envelope_id, status FROM rs"))
def _ingest_envelope_parse(spark, d):
    outcomes = I.ingest_all(A.raw_envelopes(spark, d), A.projects(spark, d))
    return outcomes.select("raw.envelope_id", F.coalesce("reason", F.lit("ok")).alias("status"))


@register("ingest_project_key", _raw_sql("""
SELECT i AS envelope_id, CASE WHEN i % 41 = 0 THEN '' WHEN i % 41 = 1 THEN 'nokey'
       ELSE 'key' || CAST(pid AS VARCHAR) END AS project_key FROM rs"""))
def _ingest_project_key(spark, d):
    raw = A.raw_envelopes(spark, d)
    return raw.select("envelope_id", S.project_key(F.col("auth")).alias("project_key"))


@register("ingest_timestamp", _raw_sql(f"""
SELECT i AS envelope_id, CASE WHEN i % 2 = 0 THEN ts ELSE date_trunc('millisecond', ts) END AS sdk_ts
FROM rs WHERE {_PARSED_OK}"""))
def _ingest_timestamp(spark, d):
    parsed, _ = S.parse_envelopes(A.raw_envelopes(spark, d))
    return parsed.select("envelope_id", "sdk_ts")


@register("ingest_exceptions", _raw_sql(f"""
SELECT i AS envelope_id, CAST(len(exceptions) AS BIGINT) AS n_exceptions,
       array_to_string(list_transform(exceptions, lambda e: e.type), '|') AS exc_types,
       array_to_string(list_transform(exceptions, lambda e: e.value), '|') AS exc_values,
       CAST(len(flatten(list_transform(exceptions, lambda e: e.frames))) AS BIGINT) AS n_frames
FROM rx WHERE {_PARSED_OK}"""))
def _ingest_exceptions(spark, d):
    parsed, _ = S.parse_envelopes(A.raw_envelopes(spark, d))
    e = F.col("exceptions")
    return parsed.select(
        "envelope_id", F.size(e).cast("bigint").alias("n_exceptions"),
        F.array_join(F.transform(e, lambda x: F.coalesce(x["type"], F.lit(""))), "|").alias("exc_types"),
        F.array_join(F.transform(e, lambda x: F.coalesce(x["value"], F.lit(""))), "|").alias("exc_values"),
        F.size(F.flatten(F.transform(e, lambda x: F.coalesce(x["stacktrace"]["frames"], F.array()))))
        .cast("bigint").alias("n_frames"))


@register("ingest_ip_split", _raw_sql("""
SELECT i AS envelope_id,
       CASE WHEN i % 89 = 0 THEN NULL WHEN i % 13 = 0 THEN '127.0.0.1'
            ELSE '10.1.' || CAST(u % 256 AS VARCHAR) || '.' || CAST(i % 256 AS VARCHAR) END AS ipv4,
       CASE WHEN i % 89 = 0 THEN NULL WHEN i % 13 = 0 THEN '2001:db8::' || CAST(i % 99 + 1 AS VARCHAR)
            ELSE '::1' END AS ipv6
FROM rs"""))
def _ingest_ip_split(spark, d):
    raw = A.raw_envelopes(spark, d)
    ip = I.split_ip(F.col("remote_addr"))
    return raw.select("envelope_id", ip["ipv4"].alias("ipv4"), ip["ipv6"].alias("ipv6"))


@register("event_fingerprint", _raw_sql(f"""
SELECT i AS envelope_id, fingerprint, {O.issue_id('pid', 'fingerprint')} AS gid FROM rv WHERE status = 'ok'"""))
def _event_fingerprint(spark, d):
    _, rows, _ = _ingested(spark, d)
    return rows.select("envelope_id", F.col("primary_hash").alias("fingerprint"), "gid")


@register("event_fingerprint_raw", _raw_sql(
    "SELECT i AS envelope_id, raw_fingerprint FROM rv WHERE status = 'ok'"))
def _event_fingerprint_raw(spark, d):
    parsed, _ = S.parse_envelopes(A.raw_envelopes(spark, d))
    ok = parsed.join(A.projects(spark, d).select(F.col("id").alias("project_id"),
                                                  F.col("key").alias("project_key")),
                     ["project_id", "project_key"], "left_semi")
    ok = ok.where(I.split_ip(F.col("remote_addr")).isNotNull())
    return ok.select("envelope_id", N.raw_fingerprint(F.col("event.message"), F.col("exceptions"))
                     .alias("raw_fingerprint"))


@register("issue_title", _raw_sql("""
SELECT i AS envelope_id, error_type, error_value, error_type || ': ' || error_value AS title
FROM rv WHERE status = 'ok'"""))
def _issue_title(spark, d):
    _, rows, _ = _ingested(spark, d)
    return rows.select("envelope_id", "error_type", "error_value", "title")


@register("issue_culprit", _raw_sql("SELECT i AS envelope_id, view FROM rv WHERE status = 'ok'"))
def _issue_culprit(spark, d):
    _, rows, _ = _ingested(spark, d)
    return rows.select("envelope_id", "view")


@register("event_tags", _raw_sql(f"SELECT i AS envelope_id, {O.tags_text()} AS tags_text FROM rv WHERE status = 'ok'"))
def _event_tags(spark, d):
    _, rows, _ = _ingested(spark, d)
    return rows.select("envelope_id", tags_text().alias("tags_text"))


@register("event_contexts", _raw_sql(
    f"SELECT i AS envelope_id, {O.tags_text('contexts')} AS contexts_text FROM rv WHERE status = 'ok'"))
def _event_contexts(spark, d):
    _, rows, _ = _ingested(spark, d)
    return rows.select("envelope_id", tags_text("contexts").alias("contexts_text"))


_FRAMES_SQL = (f"CASE WHEN len(flatten(list_transform(exceptions, lambda e: e.frames))) > 0 THEN "
               f"{O.frames_text('flatten(list_transform(exceptions, lambda e: e.frames))', chr(39) + '1' + chr(39))} "
               f"ELSE {O.frames_text('thread_frames', 'CASE WHEN f.in_app THEN 1 ELSE 0 END')} END")


def frames_text(c: str = "exception_frames"):
    return F.array_join(F.transform(F.col(c), lambda f: F.concat_ws(
        "|", f["function"], f["filename"], f["lineno"].cast("string"), f["colno"].cast("string"),
        f["in_app"].cast("string"))), ";")


@register("event_frames", _raw_sql(f"SELECT i AS envelope_id, {_FRAMES_SQL} AS frames_text FROM rv WHERE status = 'ok'"))
def _event_frames(spark, d):
    _, rows, _ = _ingested(spark, d)
    return rows.select("envelope_id", frames_text().alias("frames_text"))


@register("ingest_event_rows", _raw_sql(f"""
SELECT i AS envelope_id, pid, date_trunc('second', ts) AS created_at,
       CAST({O._case('level_name', {k: v for k, v in __import__('faultline.functions.columns', fromlist=['x']).LEVELS.items()}, '7')} AS SMALLINT) AS level,
       CAST(CASE platform WHEN 'go' THEN 1 WHEN 'rust' THEN 2 ELSE 0 END AS SMALLINT) AS platform,
       CAST(CASE platform WHEN 'rust' THEN 2 ELSE 1 END AS SMALLINT) AS sdk_id,
       error_type || ': ' || error_value AS title, fingerprint AS primary_hash,
       {O.issue_id('pid', 'fingerprint')} AS gid,
       CASE WHEN i % 17 = 0 THEN 'generated:true' ELSE md5(CAST(i AS VARCHAR)) END AS event_id_shown
FROM rv WHERE status = 'ok'"""))
def _ingest_event_rows(spark, d):
    _, rows, _ = _ingested(spark, d)
    shown = F.when(F.coalesce(F.col("event.event_id"), F.lit("")) == "",
                   F.concat(F.lit("generated:"), F.when(F.col("event_id").rlike("^[0-9a-f]{32}$"), "true")
                            .otherwise("false"))).otherwise(F.col("event_id"))
    return rows.select("envelope_id", "pid", "created_at", "level", "platform", "sdk_id", "title", "primary_hash",
                       "gid", shown.alias("event_id_shown"))


@register("issue_upsert", _raw_sql(f"""
SELECT {O.issue_id('pid', 'fingerprint')} AS id, pid AS project_id, fingerprint AS hash,
       min(date_trunc('second', ts)) AS first_seen, max(date_trunc('second', ts)) AS last_seen,
       arg_max(error_value, (date_trunc('second', ts), md5(CAST(i AS VARCHAR)))) AS message,
       arg_max(error_type, (date_trunc('second', ts), md5(CAST(i AS VARCHAR)))) AS error_type,
       arg_max(view, (date_trunc('second', ts), md5(CAST(i AS VARCHAR)))) AS view,
       3 AS priority, CAST(0 AS BIGINT) AS num_comments
FROM rv WHERE status = 'ok' GROUP BY pid, fingerprint"""))
def _issue_upsert(spark, d):
    _, rows, _ = _ingested(spark, d)
    rows = L.written(rows.select(*I.UPSERT_INPUT), "upsert-rows")  # two batches read them
    cut = F.col("created_at") < X.ts_lit("2024-01-15 00:00:00")
    first = I.upsert_issues(None, rows.where(cut))
    return I.upsert_issues(first, rows.where(~cut))


# --- J*, U*: relational ------------------------------------------------------------
from faultline.operators import access as AC  # noqa: E402
from faultline.operators import relational as R  # noqa: E402


@register("message_counts", O.rel_sql("""
SELECT i.id AS issue_id, CAST(count(c.id) AS BIGINT) AS message_count
FROM issues i LEFT JOIN comments c ON c.issue_id = i.id GROUP BY i.id"""))
def _message_counts(spark, d):
    return R.message_counts(A.issues(spark, d), A.comments(spark, d))


@register("issue_discussion", O.rel_sql("""
SELECT c.id, c.issue_id, c.user_id, a.username, c.created_at,
       row_number() OVER (PARTITION BY c.issue_id ORDER BY c.created_at DESC, c.id DESC) AS rn
FROM comments c JOIN accounts a ON a.id = c.user_id"""))
def _issue_discussion(spark, d):
    return R.issue_discussion(A.comments(spark, d), A.accounts(spark, d)).select(
        "id", "issue_id", "user_id", "username", "created_at", F.col("rn").cast("bigint").alias("rn"))


@register("teammates", O.rel_sql("""
SELECT m.team_id, m.user_id, a.username, a.email, a.name FROM members m JOIN accounts a ON a.id = m.user_id"""))
def _teammates(spark, d):
    return R.teammates(A.members(spark, d), A.accounts(spark, d)).select(
        "team_id", "user_id", "username", "email", "name")


@register("user_teams", O.rel_sql("""
SELECT m.user_id, m.team_id, t.name AS team_name FROM members m JOIN teams t ON t.id = m.team_id"""))
def _user_teams(spark, d):
    return R.user_teams(A.members(spark, d), A.teams(spark, d)).select("user_id", "team_id", "team_name")


@register("alert_list", O.rel_sql("""
SELECT id, team_id, project_name, rule_name, rn, total FROM (
  SELECT r.id, r.team_id, p.name AS project_name, r.rule_name,
         row_number() OVER (PARTITION BY r.team_id ORDER BY r.created_at DESC, r.id DESC) AS rn,
         count(*) OVER (PARTITION BY r.team_id) AS total
  FROM alert_rules r JOIN projects p ON p.id = r.project_id) WHERE rn <= 50"""))
def _alert_list(spark, d):
    return R.alert_list(A.alert_rules(spark, d), A.projects(spark, d)).select(
        "id", "team_id", "project_name", "rule_name", F.col("rn").cast("bigint").alias("rn"),
        F.col("total").cast("bigint").alias("total"))


@register("alerts_by_project", O.rel_sql("""
SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rn
FROM alert_rules"""))
def _alerts_by_project(spark, d):
    return R.alerts_by_project(A.alert_rules(spark, d)).select("id", "project_id",
                                                               F.col("rn").cast("bigint").alias("rn"))


_ACCEPTED = """accepted AS (
  SELECT f.* FROM feed f WHERE f.action = 'delete' OR EXISTS (
    SELECT 1 FROM members ma JOIN members mb ON ma.team_id = mb.team_id
    WHERE ma.user_id = f.assigned_by AND mb.user_id = f.user_id)),
current_assign AS (
  SELECT issue_id, l.user_id, l.assigned_by, l.created_at AS assigned_at FROM (
    SELECT issue_id, arg_max({'action': action, 'user_id': user_id, 'assigned_by': assigned_by,
                              'created_at': created_at}, (created_at, request_id)) AS l
    FROM accepted GROUP BY issue_id) WHERE l.action <> 'delete')"""


@register("assignment_current", O.rel_sql("SELECT * FROM current_assign", _ACCEPTED))
def _assignment_current(spark, d):
    cur, _ = R.assignment_current(A.assignment_feed(spark, d), A.members(spark, d))
    return cur.select("issue_id", "user_id", "assigned_by", "assigned_at")


@register("issue_assignees", O.rel_sql("""
SELECT i.id AS issue_id, i.project_id, p.team_id, CAST(ca.user_id AS VARCHAR) AS assignee_id, a.username, a.email
FROM issues i JOIN projects p ON p.id = i.project_id
LEFT JOIN current_assign ca ON ca.issue_id = i.id
  AND EXISTS (SELECT 1 FROM members m WHERE m.user_id = ca.user_id AND m.team_id = p.team_id)
LEFT JOIN accounts a ON a.id = ca.user_id""", _ACCEPTED))
def _issue_assignees(spark, d):
    cur, _ = R.assignment_current(A.assignment_feed(spark, d), A.members(spark, d))
    return R.issue_assignees(A.issues(spark, d), A.projects(spark, d), cur, A.members(spark, d),
                             A.accounts(spark, d)).select(
        "issue_id", "project_id", "team_id", F.col("user_id").cast("string").alias("assignee_id"), "username", "email")


@register("visible_projects", O.rel_sql("""
SELECT DISTINCT m.user_id, p.id AS project_id, p.name FROM members m JOIN projects p ON p.team_id = m.team_id"""))
def _visible_projects(spark, d):
    return R.visible_projects(A.members(spark, d), A.projects(spark, d))


@register("project_access", O.rel_sql(f"""
SELECT o_orderkey AS request_id, EXISTS (
  SELECT 1 FROM members m JOIN projects p ON p.team_id = m.team_id
  WHERE m.user_id = o_custkey % {A.N_USERS} + 1 AND p.id = o_orderkey % 12) AS allowed FROM orders"""))
def _project_access(spark, d):
    asked = A.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % A.N_USERS + 1).alias("user_id"),
        (F.col("o_orderkey") % 12).cast("int").alias("project_id"))
    return AC.project_access(asked, A.projects(spark, d), A.members(spark, d)).select("request_id", "allowed")


@register("project_list", O.rel_sql("""
SELECT id, name, team_id FROM projects WHERE team_id IN (1, 2, 3) AND lower(name) LIKE '%supplier#00000000%'"""))
def _project_list(spark, d):
    return R.project_list(A.projects(spark, d), team_ids=[1, 2, 3], name="SUPPLIER#00000000").select("id", "name", "team_id")


@register("team_webhook", O.rel_sql("""
SELECT h.team_id, h.channel_id, w.url, w.verified FROM (
  SELECT team_id, arg_max(id, (created_at, id)) AS channel_id FROM channels WHERE channel_type = 'webhook'
  GROUP BY team_id) h JOIN webhook_configs w ON w.channel_id = h.channel_id"""))
def _team_webhook(spark, d):
    return R.team_webhook(A.channels(spark, d), A.webhook_configs(spark, d)).select(
        "team_id", "channel_id", "url", "verified")


@register("assigned_filters", O.rel_sql("""
SELECT team_id, assigned_value FROM (
  SELECT DISTINCT team_id, assigned_value FROM (
    SELECT m.team_id, a.username AS assigned_value FROM members m JOIN accounts a ON a.id = m.user_id
    UNION ALL SELECT DISTINCT team_id, 'unassigned' FROM members))
UNION ALL SELECT DISTINCT team_id, 'me' FROM members"""))
def _assigned_filters(spark, d):
    return R.assigned_filters(A.members(spark, d), A.accounts(spark, d))


@register("mention_dedup", O.rel_sql("""
SELECT id AS message_id, unnest(list_distinct(mentions)) AS user_id FROM comments"""))
def _mention_dedup(spark, d):
    return R.mention_dedup(A.comments(spark, d))


# --- Q14-Q18: pages ------------------------------------------------------------------
from faultline.plans import pages as G  # noqa: E402


def _dash_sql(period: str) -> str:
    """Own grid: edges are multiples of the interval counted from year 1; the last bucket holds ``now``."""
    count, unit = int(period[:-1]), period[-1]
    secs = count * {"h": 3600, "d": 86400}[unit]
    step = 3600 if secs <= 86400 else 21600 if secs <= 604800 else 86400
    return O.sql(f"""
SELECT make_timestamp(g.e * 1000000) AS bucket, CAST(coalesce(c.c, 0) AS BIGINT) AS event_count
FROM (SELECT unnest(range(a, z, {step})) AS e FROM (
  SELECT ((top - {secs} + 62135596800) // {step}) * {step} - 62135596800 AS a,
         CASE WHEN ((top + 62135596800) // {step}) * {step} - 62135596800 < n
              THEN ((top + 62135596800) // {step} + 1) * {step} - 62135596800
              ELSE ((top + 62135596800) // {step}) * {step} - 62135596800 END AS z
  FROM (SELECT CAST(epoch({O.T_NOW}) AS BIGINT) AS n, (CAST(epoch({O.T_NOW}) AS BIGINT) // 3600 + 1) * 3600 AS top))) g
LEFT JOIN (
  SELECT ((CAST(epoch(created_at) AS BIGINT) // 3600 * 3600 + 62135596800) // {step}) * {step} - 62135596800 AS e, count(*) AS c
  FROM live WHERE created_at >= {O.T_NOW} - to_seconds({secs}) AND created_at < {O.T_NOW} GROUP BY 1) c ON c.e = g.e""")


def _dash(period: str):
    def run(spark, d):
        frm = NOW - _dt.timedelta(seconds=G.duration_seconds(period))
        return G.dashboard_series(Q.events_per_hour(A.ev(spark, d), frm, NOW, limit=None), NOW, period)
    return run


register("dashboard_series", _dash_sql("30d"))(_dash("30d"))
register("dashboard_series_7d", _dash_sql("7d"))(_dash("7d"))
register("dashboard_series_24h", _dash_sql("24h"))(_dash("24h"))
register("dashboard_series_200d", _dash_sql("200d"))(_dash("200d"))


@register("project_totals", O.rel_sql(f"""
SELECT p.id AS pid, p.name, CAST(coalesce(s.total, 0) AS BIGINT) AS total, coalesce(s.series, '') AS series
FROM projects p LEFT JOIN (
  SELECT pid, sum(event_count) AS total,
         string_agg(strftime(ts, '%Y-%m-%dT%H:%M') || '=' || CAST(event_count AS VARCHAR), ',' ORDER BY ts) AS series
  FROM (SELECT date_trunc('hour', created_at) AS ts, pid, count(*) AS event_count FROM live
        WHERE created_at >= {O.T_NOW} - INTERVAL 1 DAY AND created_at < {O.T_NOW} GROUP BY 1, 2) GROUP BY pid
) s ON s.pid = p.id"""))
def _project_totals(spark, d):
    return G.project_totals(A.projects(spark, d), A.ev(spark, d), NOW)


_FRM14 = NOW - _dt.timedelta(days=14)
_T14 = f"TIMESTAMP '{_FRM14:%Y-%m-%d %H:%M:%S}'"


def _entries_sql(search: str = "") -> str:
    return f"""
met AS (SELECT gid, count(*) AS times_seen, min(created_at) AS first_seen, max(created_at) AS last_seen,
               count(DISTINCT nullif(user_ref, '')) AS user_count
        FROM live WHERE created_at >= {_T14} AND created_at <= {O.T_NOW} GROUP BY gid),
mcount AS (SELECT issue_id, count(*) AS cnt FROM comments GROUP BY issue_id),
entries AS (
  SELECT i.id, i.project_id, i.message, i.error_type, i.view, i.priority, met.times_seen, met.first_seen,
         met.last_seen, met.user_count, CAST(coalesce(mcount.cnt, 0) AS BIGINT) AS message_count
  FROM issues i JOIN met ON met.gid = i.id LEFT JOIN mcount ON mcount.issue_id = i.id
  WHERE (i.last_seen BETWEEN {_T14} AND {O.T_NOW} OR i.first_seen BETWEEN {_T14} AND {O.T_NOW}) {search})"""


_LIST_COLS = ("id, project_id, message, error_type, view, priority, times_seen, first_seen, last_seen, user_count, "
              "message_count")


def _issue_list_sql(search: str = "") -> str:
    return O.rel_sql(f"""
SELECT {_LIST_COLS}, rn, total FROM (
  SELECT *, row_number() OVER (ORDER BY times_seen DESC, last_seen DESC, id) AS rn, count(*) OVER () AS total
  FROM entries) WHERE rn > 0 AND rn <= 50""", _entries_sql(search))


def _list_out(df):
    return df.select(*[c.strip() for c in _LIST_COLS.split(",")], F.col("rn").cast("bigint").alias("rn"),
                     F.col("total").cast("bigint").alias("total"))


@register("issue_list", _issue_list_sql())
def _issue_list(spark, d):
    return _list_out(G.issue_list(A.issues(spark, d), A.ev(spark, d), A.comments(spark, d), _FRM14, NOW))


_SEARCH = 'level:error "REFUSED" os:!darwin'


@register("issue_list_search", _issue_list_sql(
    f"AND i.id IN (SELECT DISTINCT gid FROM live WHERE created_at >= {_T14} AND created_at <= {O.T_NOW} "
    f"AND {_GS_FILTER})"))
def _issue_list_search(spark, d):
    return _list_out(G.issue_list(A.issues(spark, d), A.ev(spark, d), A.comments(spark, d), _FRM14, NOW,
                                  query=_SEARCH))


@register("new_issues", O.rel_sql(f"""
SELECT id, project_id, first_seen FROM entries WHERE first_seen > {O.T_NOW} - INTERVAL 7 DAY""", _entries_sql()))
def _new_issues(spark, d):
    e = G._entries(A.issues(spark, d), A.ev(spark, d), A.comments(spark, d), _FRM14, NOW)
    return G.new_issues(e, NOW).select("id", "project_id", "first_seen")


@register("project_issue_page", O.rel_sql(f"""
SELECT project_id, id, times_seen, is_new, total_all, total_new, rn, page FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY times_seen DESC, last_seen DESC, id) AS rn,
         CAST(floor((row_number() OVER (PARTITION BY project_id ORDER BY times_seen DESC, last_seen DESC, id) - 1)
              / 5) AS BIGINT) + 1 AS page
  FROM (SELECT *, first_seen > {O.T_NOW} - INTERVAL 7 DAY AS is_new,
               count(*) OVER (PARTITION BY project_id) AS total_all,
               CAST(sum(CASE WHEN first_seen > {O.T_NOW} - INTERVAL 7 DAY THEN 1 ELSE 0 END)
                    OVER (PARTITION BY project_id) AS BIGINT) AS total_new FROM entries))
WHERE page = 1""", _entries_sql()))
def _project_issue_page(spark, d):
    df = G.project_issue_page(A.issues(spark, d), A.ev(spark, d), A.comments(spark, d), _FRM14, NOW, NOW)
    return df.select("project_id", "id", "times_seen", "is_new", F.col("total_all").cast("bigint").alias("total_all"),
                     "total_new", F.col("rn").cast("bigint").alias("rn"), "page")


@register("issue_detail", O.rel_sql(f"""
SELECT i.id AS gid, i.project_id, m.times_seen, m.user_count, m.m_first AS first_seen, m.m_last AS last_seen,
       CAST(coalesce(tot.total_30d, 0) AS BIGINT) AS total_30d, CAST(coalesce(tot.total_24h, 0) AS BIGINT) AS total_24h,
       coalesce(tg.top_tags, '') AS top_tags, nw.latest_event_id, nb.next_id AS previous_event_id,
       nb.first_id AS newest_other_id, CAST(coalesce(mcount.cnt, 0) AS BIGINT) AS message_count,
       coalesce(asg.username, '') AS assignee, i.first_seen > {O.T_NOW} - INTERVAL 7 DAY AS is_new,
       CASE nw.platform WHEN 1 THEN 'Go' WHEN 2 THEN 'Rust' ELSE 'unknown' END AS platform_name,
       CASE i.priority WHEN 1 THEN 'Low' WHEN 2 THEN 'Med' WHEN 3 THEN 'High' ELSE 'Unknown' END AS priority_name
FROM issues i
JOIN (SELECT e.gid, count(*) AS times_seen, min(e.created_at) AS m_first, max(e.created_at) AS m_last,
             count(DISTINCT nullif(e.user_ref, '')) AS user_count
      FROM live e JOIN issues i2 ON i2.id = e.gid
      WHERE e.created_at >= i2.first_seen - INTERVAL 10 MINUTE AND e.created_at <= {O.T_NOW} GROUP BY e.gid) m
  ON m.gid = i.id
LEFT JOIN (SELECT gid, sum(c) AS total_30d, arg_max(c, day) AS total_24h FROM (
             SELECT gid, CAST(created_at AS DATE) AS day, count(*) AS c FROM live WHERE {_RANGE_HALF} GROUP BY 1, 2)
           GROUP BY gid) tot ON tot.gid = i.id
LEFT JOIN (SELECT tvk.gid, array_to_string(list_sort(list(tvk.tag || '=' || tvk.value || '=' ||
             CAST(CAST(floor(CASE WHEN tk.key_rank <= 1000 THEN event_count / tk.tag_count * 100 ELSE 0 END) AS BIGINT)
                  AS VARCHAR))), ',') AS top_tags
           FROM tvk LEFT JOIN tk ON tvk.gid = tk.gid AND tvk.tag = tk.tag GROUP BY tvk.gid) tg ON tg.gid = i.id
LEFT JOIN (SELECT gid, arg_max(event_id, (created_at, event_id)) AS latest_event_id,
                  arg_max(platform, (created_at, event_id)) AS platform
           FROM live WHERE {_RANGE_HALF} GROUP BY gid) nw ON nw.gid = i.id
LEFT JOIN (SELECT gid, event_id, lag(event_id) OVER w AS next_id,
                  nullif(last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
                         event_id) AS first_id
           FROM live WHERE created_at >= {O.T_NOW} - INTERVAL 360 DAY AND created_at <= {O.T_NOW}
           WINDOW w AS (PARTITION BY gid ORDER BY created_at, event_id)) nb
  ON nb.gid = i.id AND nb.event_id = nw.latest_event_id
LEFT JOIN (SELECT issue_id, count(*) AS cnt FROM comments GROUP BY issue_id) mcount ON mcount.issue_id = i.id
LEFT JOIN (SELECT ca.issue_id, a.username FROM current_assign ca JOIN issues ii ON ii.id = ca.issue_id
           JOIN projects p ON p.id = ii.project_id JOIN accounts a ON a.id = ca.user_id
           WHERE EXISTS (SELECT 1 FROM members mm WHERE mm.user_id = ca.user_id AND mm.team_id = p.team_id)) asg
  ON asg.issue_id = i.id""", _ACCEPTED + "," + _TV_AGG + """,
tk AS (SELECT gid, tag, tag_count, row_number() OVER (PARTITION BY gid ORDER BY tag_count DESC, tag) AS key_rank
       FROM (SELECT gid, tag, CAST(sum(event_count) AS BIGINT) AS tag_count FROM tv GROUP BY 1, 2))"""))
def _issue_detail(spark, d):
    cur, _ = R.assignment_current(A.assignment_feed(spark, d), A.members(spark, d))
    asg = R.issue_assignees(A.issues(spark, d), A.projects(spark, d), cur, A.members(spark, d), A.accounts(spark, d))
    return G.issue_detail(A.issues(spark, d), A.ev(spark, d), A.comments(spark, d), asg, NOW)


_NEW_NOW = FRM + _dt.timedelta(days=6, minutes=30)  # a few issues are older than seven days then, most are new
_TNEW = f"TIMESTAMP '{_NEW_NOW:%Y-%m-%d %H:%M:%S}'"
_T14NEW = f"TIMESTAMP '{_NEW_NOW - _dt.timedelta(days=14):%Y-%m-%d %H:%M:%S}'"


def _new_sql(body: str) -> str:
    return O.rel_sql(body, _entries_sql().replace(O.T_NOW, _TNEW).replace(_T14, _T14NEW))


def _new_inputs(spark, d):
    return A.issues(spark, d), A.ev(spark, d), A.comments(spark, d), _NEW_NOW - _dt.timedelta(days=14), _NEW_NOW


@register("new_issues_week", _new_sql(f"""
SELECT id, project_id, first_seen, message_count FROM entries WHERE first_seen > {_TNEW} - INTERVAL 7 DAY"""))
def _new_issues_week(spark, d):
    """P12 at a time when most issues are younger than a week."""
    return G.new_issues(G._entries(*_new_inputs(spark, d)), _NEW_NOW).select("id", "project_id", "first_seen", "message_count")


def _page_sql(where: str) -> str:
    return _new_sql(f"""
SELECT project_id, id, times_seen, is_new, total_all, total_new, rn, page FROM (
  SELECT *, CAST(floor((rn - 1) / 5) AS BIGINT) + 1 AS page
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY times_seen DESC, last_seen DESC, id) AS rn
        FROM (SELECT *, first_seen > {_TNEW} - INTERVAL 7 DAY AS is_new, count(*) OVER (PARTITION BY project_id) AS total_all,
                     CAST(sum(CASE WHEN first_seen > {_TNEW} - INTERVAL 7 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY project_id) AS BIGINT)
                       AS total_new FROM entries) {where})) WHERE page = 2""")


def _page(view):
    def run(spark, d):
        df = G.project_issue_page(*_new_inputs(spark, d), _NEW_NOW, view=view, page=2)
        return df.select("project_id", "id", "times_seen", "is_new", F.col("total_all").cast("bigint").alias("total_all"),
                         "total_new", F.col("rn").cast("bigint").alias("rn"), "page")
    return run


register("project_issue_page_new", _page_sql("WHERE is_new"))(_page("new"))
register("project_issue_page_2", _page_sql(""))(_page("all"))


@register("event_page", O.sql(f"""
SELECT gid, event_id, created_at, rn, total FROM (
  SELECT gid, replace(event_id, '-', '') AS event_id, created_at,
         row_number() OVER (PARTITION BY gid ORDER BY created_at DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY gid) AS total
  FROM live WHERE created_at >= {O.T_NOW} - INTERVAL 14 DAY AND created_at < {O.T_NOW} AND {O.contains_ci('message', O.q('failed id'))}
    AND {O.has_tag('tags', O.q('os'), O.q('linux'))} AND NOT {O.has_tag('tags', O.q('env'), O.q('staging'))}) WHERE rn > 2 AND rn <= 6"""))
def _event_page(spark, d):
    """P7 with a window by period text (X28): raw words form one phrase, a repeated key keeps its last value."""
    frm, to = G.period_window(NOW, "2w", page="events")
    page = G.event_page(A.ev(spark, d), "os:darwin failed env:!staging id os:linux", frm, to, limit=4, offset=2)
    return page.select("gid", "event_id", "created_at", "rn", "total")


@register("events_second_dialect", O.sql(f"""
SELECT gid, count(*) AS event_count FROM live WHERE {_RANGE_HALF} AND {O.has_tag('tags', O.q('os'), O.q('linux'))}
  AND NOT {O.has_tag('tags', O.q('level'), O.q('info'))} GROUP BY gid"""))
def _events_second_dialect(spark, d):
    tokens = P.parse_query_v2("os:linux level:!:info words")
    return Q.event_count(A.ev(spark, d), FRM, NOW, where=P.group_search_predicate(tokens, F.col("message"), F.col("title"), F.col("tags")))


@register("metrics_by_ids", O.sql(f"""
SELECT form, gid, count(*) AS times_seen, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT nullif(user_ref, '')) AS user_count
FROM (SELECT *, 'pids' AS form FROM live WHERE pid IN (1, 3)
      UNION ALL SELECT *, 'gids' FROM live WHERE gid IN (SELECT gid FROM ev GROUP BY gid ORDER BY count(*) DESC, gid LIMIT 5))
WHERE {_RANGE_CLOSED} GROUP BY form, gid"""))
def _metrics_by_ids(spark, d):
    """A list of projects, a table of issues, an empty list."""
    ev = A.ev(spark, d)
    most = ev.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gid").limit(5).select("gid")
    forms = {"pids": {"pids": [1, 3]}, "gids": {"gids": most}, "none": {"gids": []}}
    parts = [Q.issue_metrics(ev, FRM, NOW, **ids).withColumn("form", F.lit(name)) for name, ids in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("values_of_tag", O.sql(f"""
SELECT tag, value, count(*) AS event_count FROM tagrows WHERE {_RANGE_CLOSED} AND tag = 'user' GROUP BY 1, 2
ORDER BY event_count DESC, value LIMIT 100"""))
def _values_of_tag(spark, d):
    return Q.tag_values(A.ev(spark, d), FRM, NOW, tag="user")


# --- A1-A5: alerts -------------------------------------------------------------------------
from faultline.operators import alerts as AL  # noqa: E402


def _alert_sql(body: str, more: str = "") -> str:
    return O.rel_sql(body, O.alert_ctes(O.T_NOW) + ("," + more if more else ""))


def _evaluated(spark, d):
    return AL.alert_evaluate(A.alert_rules(spark, d), A.projects(spark, d), A.issues(spark, d), A.ev(spark, d), NOW)


@register("alert_evaluate", _alert_sql("SELECT * FROM evaluated"))
def _alert_evaluate(spark, d):
    return _evaluated(spark, d)


@register("alert_transitions", _alert_sql("SELECT rule_id, status, hit, new_status, transition FROM transitions"))
def _alert_transitions(spark, d):
    return AL.alert_transitions(_evaluated(spark, d), NOW).select("rule_id", "status", "hit", "new_status",
                                                                 "transition")


def _outbox(spark, d):
    tr = AL.alert_transitions(_evaluated(spark, d), NOW)
    return AL.notification_outbox(tr, A.alert_rules(spark, d), A.channels(spark, d), A.webhook_configs(spark, d),
                                  NOW)


@register("notification_outbox", _alert_sql("""
SELECT id, rule_id, channel_id, notification_type,
       CASE WHEN error_message IS NULL THEN 'pending' ELSE 'failed' END AS status, error_message FROM outbox"""))
def _notification_outbox(spark, d):
    return _outbox(spark, d).select("id", "rule_id", "channel_id", "notification_type", "status", "error_message")


@register("pending_notifications", _alert_sql("""
SELECT id, rule_id, channel_id, notification_type FROM outbox WHERE error_message IS NULL ORDER BY id LIMIT 100"""))
def _pending_notifications(spark, d):
    return R.pending_notifications(_outbox(spark, d)).select("id", "rule_id", "channel_id", "notification_type")


@register("alert_payload", O.rel_sql(f"""
SELECT id AS alert_id, '{{"timestamp":"{NOW:%Y-%m-%dT%H:%M:%SZ}","alert_name":"' || rule_name ||
       '","status":"triggered","condition":"' ||
       CASE condition WHEN 1 THEN 'occurrences' WHEN 2 THEN 'users_affected' ELSE 'unknown' END ||
       '","timeframe":"' ||
       CASE timeframe WHEN 1 THEN '1m' WHEN 2 THEN '5m' WHEN 3 THEN '15m' WHEN 4 THEN '1h' WHEN 5 THEN '1d'
                      WHEN 6 THEN '1w' WHEN 7 THEN '30d' ELSE 'unknown' END ||
       '","alert_id":' || CAST(id AS VARCHAR) || ',"project_id":' || CAST(project_id AS VARCHAR) ||
       ',"team_id":' || CAST(team_id AS VARCHAR) || ',"threshold":' || CAST(threshold AS VARCHAR) ||
       ',"high_priority":' || CASE WHEN high_priority THEN 'true' ELSE 'false' END || '}}' AS payload
FROM alert_rules"""))
def _alert_payload(spark, d):
    return AL.alert_payload(A.alert_rules(spark, d), "triggered", NOW).select(F.col("id").alias("alert_id"),
                                                                             "payload")


def _requests(spark, d):
    s = A.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("request_id"), (k % A.N_USERS + 1).alias("user_id"),
                    (F.col("s_nationkey") + 1).cast("int").alias("project_id"),
                    F.concat(F.lit("rule-"), F.col("s_name")).alias("rule_name"),
                    ((k * 7) % 50).cast("int").alias("threshold"), (k % 3 + 1).cast("int").alias("condition"),
                    (k % 8 + 1).cast("int").alias("timeframe"), (F.col("s_acctbal") > 5000).alias("high_priority"))


@register("alert_rules", O.rel_sql(f"""
SELECT s_suppkey AS request_id, p.id AS project_id, p.team_id, 'rule-' || s_name AS rule_name,
       'Alert when more than ' || CAST((s_suppkey * 7) % 50 AS VARCHAR) || ' ' ||
       CASE s_suppkey % 3 + 1 WHEN 2 THEN 'users affected' ELSE 'occurrences' END || ' in ' ||
       CASE s_suppkey % 8 + 1 WHEN 1 THEN '1 minute' WHEN 2 THEN '5 minutes' WHEN 3 THEN '15 minutes'
            WHEN 4 THEN '1 hour' WHEN 5 THEN '1 day' WHEN 6 THEN '1 week' WHEN 7 THEN '30 days' ELSE '1 hour' END
         AS description,
       'Active' AS status
FROM supplier JOIN projects p ON p.id = s_nationkey + 1
WHERE EXISTS (SELECT 1 FROM members m WHERE m.user_id = s_suppkey % {A.N_USERS} + 1 AND m.team_id = p.team_id)"""))
def _alert_rules(spark, d):
    return AL.alert_rules(_requests(spark, d), A.projects(spark, d), A.members(spark, d), NOW).select(
        "request_id", "project_id", "team_id", "rule_name", "description", "status")


@register("alert_update", O.rel_sql("""
SELECT id, project_id, rule_name, status, changed, 'Alert when more than ' || CAST(threshold AS VARCHAR) || ' ' ||
       CASE condition WHEN 2 THEN 'users affected' ELSE 'occurrences' END || ' in ' ||
       CASE timeframe WHEN 1 THEN '1 minute' WHEN 2 THEN '5 minutes' WHEN 3 THEN '15 minutes' WHEN 4 THEN '1 hour' WHEN 5 THEN '1 day'
         WHEN 6 THEN '1 week' WHEN 7 THEN '30 days' ELSE '1 hour' END AS description FROM merged""", f"""
asked AS (
  SELECT o_orderkey AS request_id, CAST(o_orderkey % 300 + 1 AS INTEGER) AS alert_id, o_custkey % {A.N_USERS} + 1 AS user_id,
         'renamed-' || CAST(o_orderkey AS VARCHAR) AS rule_name, CAST(o_orderkey % 50 AS INTEGER) AS threshold,
         CAST(o_orderkey % 3 + 1 AS INTEGER) AS condition, CAST(o_orderkey % 8 + 1 AS INTEGER) AS timeframe,
         CASE WHEN o_orderkey % 4 = 0 THEN 'Inactive' ELSE '' END AS status FROM orders),
best AS (SELECT a.* FROM asked a JOIN alert_rules r ON r.id = a.alert_id
         WHERE EXISTS (SELECT 1 FROM members m WHERE m.user_id = a.user_id AND m.team_id = r.team_id)
         QUALIFY row_number() OVER (PARTITION BY a.alert_id ORDER BY request_id DESC) = 1),
merged AS (SELECT r.id, r.project_id, coalesce(b.rule_name, r.rule_name) AS rule_name, coalesce(b.threshold, r.threshold) AS threshold,
         coalesce(b.condition, r.condition) AS condition, coalesce(b.timeframe, r.timeframe) AS timeframe,
         coalesce(nullif(b.status, ''), r.status) AS status, b.request_id IS NOT NULL AS changed
  FROM alert_rules r LEFT JOIN best b ON b.alert_id = r.id)"""))
def _alert_update(spark, d):
    k = F.col("o_orderkey")
    asked = A.read(spark, d, "orders").select(
        k.alias("request_id"), (k % 300 + 1).cast("int").alias("alert_id"), (F.col("o_custkey") % A.N_USERS + 1).alias("user_id"),
        F.concat(F.lit("renamed-"), k.cast("string")).alias("rule_name"), (k % 50).cast("int").alias("threshold"),
        (k % 3 + 1).cast("int").alias("condition"), (k % 8 + 1).cast("int").alias("timeframe"), F.lit(True).alias("high_priority"),
        F.when(k % 4 == 0, F.lit("Inactive")).otherwise(F.lit("")).alias("status"))
    out = AL.alert_update(A.alert_rules(spark, d), asked, A.members(spark, d), NOW)
    return out.select("id", "project_id", "rule_name", "status", F.col("updated_at").isNotNull().alias("changed"), "description")


_TICK0, _TICK_EVERY = _dt.datetime(2024, 1, 1, 6), _dt.timedelta(hours=6)
_N_TICKS = int((NOW - _TICK0) / _TICK_EVERY) + 1


@register("alert_timeline", _alert_sql(f"""
SELECT rule_id, tick, hit,
       CASE WHEN after <> before THEN CASE WHEN hit THEN 'triggered' ELSE 'resolved' END END AS transition
FROM (SELECT *, coalesce(lag(after) OVER (PARTITION BY rule_id ORDER BY tick), status) AS before FROM (
  SELECT rt.rule_id, rt.status, rt.tick, f.rule_id IS NOT NULL AS hit,
         CASE WHEN f.rule_id IS NOT NULL THEN 'Triggered' ELSE 'Active' END AS after
  FROM rt LEFT JOIN fired f ON f.rule_id = rt.rule_id AND f.tick = rt.tick))""", f"""
rt AS (SELECT rw.rule_id, rw.project_id, rw.status, rw.threshold, rw.condition, rw.tf,
              TIMESTAMP '{_TICK0:%Y-%m-%d %H:%M:%S}' + to_seconds(CAST(g.range * {int(_TICK_EVERY.total_seconds())} AS BIGINT)) AS tick
       FROM rw, range({_N_TICKS}) g),
tper AS (SELECT rt.rule_id, rt.tick, e.gid, count(*) AS ts_n, count(DISTINCT nullif(e.user_ref, '')) AS uc
         FROM rt JOIN live e ON e.pid = rt.project_id AND e.created_at >= rt.tick - to_seconds(CAST(rt.tf AS BIGINT))
              AND e.created_at <= rt.tick GROUP BY 1, 2, 3),
fired AS (SELECT DISTINCT tper.rule_id, tper.tick FROM tper JOIN rt ON rt.rule_id = tper.rule_id AND rt.tick = tper.tick
          WHERE rt.threshold >= 0 AND (CASE WHEN rt.condition = 2 THEN uc ELSE ts_n END) > rt.threshold)"""))
def _alert_timeline(spark, d):
    return AL.alert_timeline(A.alert_rules(spark, d), A.projects(spark, d), A.ev(spark, d), _TICK0, NOW,
                             _TICK_EVERY)


# --- S5, L1-L6: layout; Q19-Q21: reports -----------------------------------------------
from faultline.operators import reports as RP  # noqa: E402


@register("layout_weekly_partitions", O.sql("""
SELECT CAST(retention_days AS INTEGER) AS retention_days, CAST(date_trunc('week', created_at) AS TIMESTAMP) AS week,
       count(*) AS n_rows, count(DISTINCT pid) AS n_projects FROM ev GROUP BY 1, 2"""))
def _layout_weekly_partitions(spark, d):
    path = L.scratch_path(spark, "events")
    L.write_events(A.ev(spark, d), path, mode="overwrite")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("retention_days").cast("int").alias("retention_days"),
                        F.col("week").cast("timestamp_ntz").alias("week")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pid").alias("n_projects"))


@register("event_latest_state", O.sql("""
SELECT pid, primary_hash, event_id, created_at, deleted FROM (
  SELECT *, row_number() OVER (PARTITION BY pid, CAST(created_at AS DATE), primary_hash, event_id
                               ORDER BY deleted DESC, ingest_seq DESC) AS rn
  FROM (SELECT *, 0 AS ingest_seq FROM ev
        UNION ALL
        SELECT * REPLACE (CAST(1 - deleted AS SMALLINT) AS deleted), 1 AS ingest_seq FROM ev
        WHERE substr(event_id, 1, 1) IN ('0', '1', '2'))) WHERE rn = 1 AND deleted = 0"""))
def _event_latest_state(spark, d):
    return L.latest_state(A.ev_dup(spark, d)).select("pid", "primary_hash", "event_id", "created_at", "deleted")


_RET_NOW = _dt.datetime(2024, 4, 15)


def _ret() -> str:
    return f"TIMESTAMP '{_RET_NOW:%Y-%m-%d %H:%M:%S}'"


@register("retention_sweep", O.sql(f"""
SELECT pid, count(*) AS kept FROM ev
WHERE created_at + to_days(CAST(retention_days AS INTEGER)) > TIMESTAMP '{_RET_NOW:%Y-%m-%d %H:%M:%S}' GROUP BY pid"""))
def _retention_sweep(spark, d):
    return L.retention_sweep(A.ev(spark, d), _RET_NOW).groupBy("pid").agg(F.count(F.lit(1)).alias("kept"))


@register("retention_drop", O.sql(f"""
SELECT CAST(week AS TIMESTAMP) AS week, n AS rows_before, alive AS rows_after,
  CASE WHEN week + INTERVAL 97 DAY <= {_ret()} THEN 'dropped' WHEN week + INTERVAL 90 DAY > {_ret()} THEN 'kept'
       WHEN alive = 0 THEN 'dropped' ELSE 'rewritten' END AS action, alive AS stored
FROM (SELECT date_trunc('week', created_at) AS week, count(*) AS n,
             CAST(sum(CASE WHEN created_at + INTERVAL 90 DAY > {_ret()} THEN 1 ELSE 0 END) AS BIGINT) AS alive
      FROM ev GROUP BY 1)"""))
def _retention_drop(spark, d):
    """Sweep a stored copy of the event table; ``stored`` counts what its folders hold afterwards."""
    path = L.scratch_path(spark, "events-swept")
    L.write_events(A.ev(spark, d), path, mode="overwrite")
    report = L.drop_expired(spark, path, _RET_NOW)
    stored = spark.read.parquet(path).groupBy("week").agg(F.count(F.lit(1)).alias("stored"))
    return report.join(stored, "week", "left").select(
        F.col("week").cast("timestamp_ntz").alias("week"), "rows_before", "rows_after", "action",
        F.coalesce("stored", F.lit(0)).cast("bigint").alias("stored"))


@register("event_sample", O.sql("""
SELECT event_id, pid, gid FROM ev
WHERE CAST(('0x' || substr(md5(event_id), 1, 8)) AS BIGINT) % 10 < 1"""))
def _event_sample(spark, d):
    return L.event_sample(A.ev(spark, d), 1, 10).select("event_id", "pid", "gid")


_QL_CTE = f"""ql AS (
  SELECT CASE substr(o_orderpriority, 1, 1)
           WHEN '1' THEN 'SELECT count() FROM event WHERE pid = ' || CAST(o_custkey % 10 AS VARCHAR)
           WHEN '2' THEN 'SELECT * FROM event WHERE gid = ' || CAST(o_custkey AS VARCHAR) || ' AND env = ''' ||
                         o_orderstatus || ''''
           WHEN '3' THEN 'INSERT INTO event VALUES (' || CAST(o_orderkey AS VARCHAR) || ', ''x'')'
           WHEN '4' THEN 'SELECT gid FROM event  WHERE created_at > ' || CAST(o_orderkey % 1000 AS VARCHAR) || '.5'
           ELSE 'SELECT 1' END AS query,
         o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS event_time,
         CAST(floor(o_totalprice) AS BIGINT) % 5000 AS query_duration_ms, o_custkey % 100 AS result_rows,
         CAST(floor(o_totalprice * 10) AS BIGINT) AS read_bytes, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 2 END AS type,
         o_orderkey % 7 <> 0 AS is_initial_query
  FROM orders)"""


def _strip_sql(expr: str) -> str:
    out = expr
    for pattern, repl in X.QUERY_LITERAL_RULES:
        out = f"regexp_replace({out}, {O.q(pattern)}, {O.q(repl)}, 'g')"
    return out


@register("query_log_report", O.sql(f"""
SELECT normalized_query, round(avg_duration, 6) AS avg_duration, round(avg_result_rows, 6) AS avg_result_rows,
       total_calls, rb, round(calls_per_minute, 6) AS calls_per_minute, round(percentage_iops, 6) AS percentage_iops,
       round(percentage_runtime, 6) AS percentage_runtime, round(rb / sum(rb) OVER () * 100, 6) AS percent
FROM (
  SELECT normalized_query, avg_duration, avg_result_rows, total_calls, rb,
         total_calls / greatest(1, date_diff('minute', t0, t1)) AS calls_per_minute,
         rb / sum(rb) OVER () * 100 AS percentage_iops, runtime / sum(runtime) OVER () * 100 AS percentage_runtime
  FROM (SELECT {_strip_sql('query')} AS normalized_query, avg(query_duration_ms) AS avg_duration,
               avg(result_rows) AS avg_result_rows, count(*) AS total_calls, min(event_time) AS t0,
               max(event_time) AS t1, CAST(sum(read_bytes) AS BIGINT) AS rb, sum(query_duration_ms) AS runtime
        FROM ql WHERE is_initial_query AND type = 2
          AND event_time >= TIMESTAMP '{A.QUERY_LOG_NOW:%Y-%m-%d %H:%M:%S}' - INTERVAL 30 DAY
        GROUP BY 1)
  ORDER BY rb DESC, normalized_query LIMIT 10)""", _QL_CTE))
def _query_log_report(spark, d):
    r = RP.query_log_report(A.query_log(spark, d), A.QUERY_LOG_NOW)
    dbl = ["avg_duration", "avg_result_rows", "calls_per_minute", "percentage_iops", "percentage_runtime", "percent"]
    return r.select("normalized_query", "total_calls", F.col("rb").cast("bigint").alias("rb"),
                    *[F.round(c, 6).alias(c) for c in dbl])


@register("error_log_report", O.sql(f"""
SELECT *, row_number() OVER (ORDER BY error_count DESC, name) AS rn FROM (
SELECT name, count(*) AS error_count, max(last_error_time) AS max_last_error_time FROM (
  SELECT 'ERR_' || l_returnflag || '_' || l_linestatus || '_' || CAST(l_linenumber % 3 AS VARCHAR) AS name,
         l_shipdate + to_seconds(CAST(l_orderkey % 86400 AS BIGINT)) AS last_error_time FROM lineitem)
WHERE last_error_time > TIMESTAMP '{A.ERROR_LOG_SINCE:%Y-%m-%d %H:%M:%S}' GROUP BY name)"""))
def _error_log_report(spark, d):
    return RP.error_log_report(A.error_log(spark, d), A.ERROR_LOG_SINCE)


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
           "benchmark", "labels", "conversations"]


@register("storage_report", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS total_rows, true AS has_bytes, {len(_TABLES)} AS datasets FROM {n}" for n in _TABLES))
def _storage_report(spark, d):
    """Rows per dataset; sizes of files differ between machines, so only their presence and the ranks' number are shown."""
    report = RP.storage_report(spark, {n: f"{d}/{n}.parquet" for n in _TABLES})
    last = report.agg(F.max("rn").cast("int").alias("n")).scalar()
    return report.select("name", "total_rows", (F.col("total_bytes") > 0).alias("has_bytes"), last.alias("datasets"))


# --- S2-S4, R1-R5: streaming (file streams, availableNow) ------------------------------
from faultline.streaming import jobs as ST  # noqa: E402

_STREAM_FILES = 4


def _replayed(spark, frame, job):
    """Feed ``frame`` as slices of S3 records (one JSON text per event) to a job that keeps its place in a checkpoint."""
    ck = L.scratch_path(spark, "ck")
    ST.replay(frame, "created_at", _STREAM_FILES, lambda stream: job(stream, ck), as_messages=True)


@register("stream_event_load", O.sql(f"SELECT event_id, pid, created_at, gid, {O.tags_text()} AS tags_text FROM ev"))
def _stream_event_load(spark, d):
    out = L.scratch_path(spark, "stream-events")
    _replayed(spark, A.ev(spark, d).drop("week"), lambda stream, ck: ST.stream_event_load(stream, out, ck))
    return spark.read.parquet(out).select("event_id", "pid", "created_at", "gid", tags_text().alias("tags_text"))


@register("stream_dedup", O.sql("SELECT DISTINCT pid, event_id FROM ev"))
def _stream_dedup(spark, d):
    out = L.scratch_path(spark, "stream-dedup")
    _replayed(spark, A.ev_dup(spark, d), lambda stream, ck: ST.stream_dedup(stream, out, ck))
    return spark.read.parquet(out).select("pid", "event_id")


@register("stream_events_per_hour", O.sql("""
SELECT date_trunc('hour', created_at) AS ts, pid, count(*) AS event_count FROM live GROUP BY 1, 2"""))
def _stream_events_per_hour(spark, d):
    out = L.scratch_path(spark, "stream-hourly")
    _replayed(spark, A.ev(spark, d), lambda stream, ck: ST.stream_events_per_hour(stream, out, ck))
    return ST.hourly_counts(spark, out)


def _run_issue_stream(spark, d):
    issues, events, rejects, ck = (L.scratch_path(spark, n) for n in ("stream-issues", "stream-ev", "stream-rejects", "ck"))
    projects = A.projects(spark, d)
    ST.replay(A.raw_envelopes(spark, d), "received_at", _STREAM_FILES,
              lambda stream: ST.stream_issue_upsert(stream, projects, issues, events, rejects, ck))
    return issues, rejects


@register("stream_ingest_rejects", _raw_sql("SELECT i AS envelope_id, status AS reason FROM rs WHERE status <> 'ok'"))
def _stream_ingest_rejects(spark, d):
    return spark.read.parquet(_run_issue_stream(spark, d)[1]).select("envelope_id", "reason")


@register("stream_issue_upsert", ORACLE["issue_upsert"])
def _stream_issue_upsert(spark, d):
    return ST.latest_snapshot(spark, _run_issue_stream(spark, d)[0]).drop("bucket")


_ALERT_BOUNDS = [_dt.datetime(2024, 1, 8), _dt.datetime(2024, 1, 15), _dt.datetime(2024, 1, 22)]


def _stream_alerts_sql() -> str:
    b = ", ".join(f"({k}, TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}')" for k, t in enumerate(_ALERT_BOUNDS))
    n = len(_ALERT_BOUNDS)
    return O.rel_sql(f"""
SELECT now AS at, rule_id, status, hit, new_status,
       CASE WHEN status = 'Active' AND hit THEN 'triggered' WHEN status = 'Triggered' AND NOT hit THEN 'resolved'
       END AS transition
FROM (SELECT now, rule_id, hit, new_status,
             coalesce(lag(new_status) OVER (PARTITION BY rule_id ORDER BY v), orig_status) AS status
      FROM (SELECT bn.v, bn.now, rw.rule_id, rw.status AS orig_status, coalesce(h.hit, false) AS hit,
                   CASE WHEN coalesce(h.hit, false) THEN 'Triggered' ELSE 'Active' END AS new_status
            FROM bn CROSS JOIN rw LEFT JOIN hits h ON h.v = bn.v AND h.rule_id = rw.rule_id))""", f"""
ub AS (SELECT * FROM (VALUES {b}, ({n}, TIMESTAMP '9999-01-01 00:00:00')) t(v, hi)),
bn AS (SELECT ub.v, (SELECT max(created_at) FROM live WHERE created_at <= ub.hi
                     AND created_at > coalesce((SELECT u2.hi FROM ub u2 WHERE u2.v = ub.v - 1), TIMESTAMP '0001-01-01'))
                 AS now FROM ub),
r_listed AS (SELECT ar.* FROM alert_rules ar JOIN projects p ON p.id = ar.project_id
             ),
rw AS (SELECT id AS rule_id, project_id, threshold, condition, status, {O.timeframe_seconds('timeframe')} AS tf
       FROM r_listed WHERE status IN ('Active', 'Triggered')),
win AS (SELECT bn.v, bn.now, rw.*, bn.now - to_seconds(CAST(rw.tf AS BIGINT)) AS w_from FROM bn CROSS JOIN rw),
iss AS (SELECT bn.v, e.gid, e.pid, min(e.created_at) AS first_seen, max(e.created_at) AS last_seen
        FROM bn JOIN ev e ON e.created_at <= bn.now GROUP BY 1, 2, 3),
per AS (SELECT w.v, w.rule_id, e.gid, count(*) AS ts_n, count(DISTINCT nullif(e.user_ref, '')) AS uc
        FROM win w JOIN live e ON e.pid = w.project_id AND e.created_at >= w.w_from AND e.created_at <= w.now
        GROUP BY 1, 2, 3),
hits AS (SELECT per.v, per.rule_id,
                bool_or(w.threshold >= 0 AND (CASE WHEN w.condition = 2 THEN uc ELSE ts_n END) > w.threshold) AS hit
         FROM per JOIN win w ON w.v = per.v AND w.rule_id = per.rule_id
         JOIN iss i ON i.v = per.v AND i.gid = per.gid AND i.pid = w.project_id
              AND (i.last_seen BETWEEN w.w_from AND w.now OR i.first_seen BETWEEN w.w_from AND w.now)
         GROUP BY 1, 2)""")


@register("stream_alerts", _stream_alerts_sql())
def _stream_alerts(spark, d):
    """Statuses after each arrival, at the newest live event's time (the watermark)."""
    counts, state, ck = (L.scratch_path(spark, n) for n in ("alert-counts", "alert-state", "ck"))
    rules, projects = A.alert_rules(spark, d), A.projects(spark, d)
    ST.replay(A.ev(spark, d), "created_at", len(_ALERT_BOUNDS) + 1, lambda stream: ST.stream_alerts(stream, rules, projects, counts, state, ck),
              as_messages=True, bounds=_ALERT_BOUNDS)
    return spark.read.parquet(state).select("at", "rule_id", "status", "hit", "new_status", "transition")


# --- X13 / X17 over ingested events -------------------------------------------------------
@register("stack_details", _raw_sql(f"""
SELECT i AS envelope_id, array_to_string(list_transform(list_reverse(CASE
         WHEN len(flatten(list_transform(exceptions, lambda e: e.frames))) > 0
         THEN list_transform(flatten(list_transform(exceptions, lambda e: e.frames)),
                             lambda f: {{'p': f.abs_path, 'fn': f.function, 'l': f.lineno, 'a': true}})
         ELSE list_transform(thread_frames, lambda f: {{'p': f.abs_path, 'fn': f.function, 'l': f.lineno, 'a': f.in_app}})
       END), lambda s: s.p || '|' || s.fn || '|' || CAST(s.l AS VARCHAR) || '|' || CASE WHEN s.a THEN 'In App' ELSE '' END),
       ';') AS stack_text
FROM rv WHERE status = 'ok'"""))
def _stack_details(spark, d):
    _, rows, _ = _ingested(spark, d)
    st = X.stack_details(F.col("exception_frames"))
    text = F.array_join(F.transform(st, lambda s: F.concat_ws(
        "|", s["filepath"], s["function"], s["lineno"].cast("string"),
        F.when(s["in_app"], F.lit("In App")).otherwise(F.lit("")))), ";")
    return rows.select("envelope_id", text.alias("stack_text"))


@register("context_groups", _raw_sql("""
SELECT rv.i AS envelope_id, coalesce(g.groups_text, '') AS groups_text FROM rv LEFT JOIN (
  SELECT i, string_agg(prefix || '{' || fields || '}', ';' ORDER BY prefix) AS groups_text FROM (
    SELECT i, prefix, string_agg(k || '=' || v, ',' ORDER BY k) AS fields FROM (
      SELECT i, split_part(kv.key, '.', 1) AS prefix, substr(kv.key, instr(kv.key, '.') + 1) AS k, kv.value AS v
      FROM (SELECT i, unnest(contexts) AS kv FROM rv WHERE status = 'ok') WHERE instr(kv.key, '.') > 0)
    GROUP BY i, prefix) GROUP BY i) g ON g.i = rv.i
WHERE rv.status = 'ok'"""))
def _context_groups(spark, d):
    _, rows, _ = _ingested(spark, d)
    groups = X.context_groups(F.col("contexts"))
    text = F.array_join(F.transform(groups, lambda g: F.concat(
        g["prefix"], F.lit("{"),
        F.array_join(F.transform(F.array_sort(F.map_entries(g["fields"])),
                                 lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","),
        F.lit("}"))), ";")
    return rows.select("envelope_id", text.alias("groups_text"))


# --- S7: outbox status fold -------------------------------------------------------------
@register("notification_status", _alert_sql(f"""
SELECT id, rule_id, channel_id, CASE WHEN error_message IS NOT NULL THEN 'failed' WHEN rule_id % 6 = 3 THEN 'failed' ELSE 'sent' END AS status,
       CASE WHEN error_message IS NOT NULL THEN error_message WHEN rule_id % 6 = 3 THEN 'timeout' END AS error_message,
       CASE WHEN error_message IS NOT NULL OR rule_id % 6 = 3 THEN NULL WHEN rule_id % 6 = 0 THEN {O.T_NOW} + INTERVAL 2 MINUTE
            ELSE {O.T_NOW} + INTERVAL 1 MINUTE END AS sent_at FROM outbox"""))
def _notification_status(spark, d):
    """The outbox as an append-only log: created rows, the sender's results for what is pending a minute later (every
    third fails), and a second try a minute after that, which every other failed one survives."""
    path = L.scratch_path(spark, "outbox")
    L.outbox_append(_outbox(spark, d), path)

    def sender(tried, minutes, ok):
        at = F.lit(NOW + _dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
        L.outbox_update(tried.select(
            "id", F.when(ok, F.lit(AL.SENT)).otherwise(F.lit(AL.FAILED)).alias("status"),
            F.when(~ok, F.lit("timeout")).alias("error_message"), F.when(ok, at).alias("sent_at"), at.alias("updated_at")), path)

    sender(L.outbox_current(spark, path).where(F.col("status") == AL.PENDING), 1, F.col("rule_id") % 3 != 0)
    sender(L.outbox_current(spark, path).where(F.col("error_message") == "timeout"), 2, F.col("rule_id") % 6 == 0)
    return L.outbox_current(spark, path).select("id", "rule_id", "channel_id", "status", "error_message", "sent_at")


# --- P6 as a job: saved searches ---------------------------------------------------------
from faultline.operators import percolate as PC  # noqa: E402


def _ss_pred() -> str:
    msg_or_title = lambda t: f"({O.contains_ci('e.message', O.q(t))} OR {O.contains_ci('e.title', O.q(t))})"
    return f"""CASE s.n % 4
  WHEN 0 THEN {O.has_tag('e.tags', O.q('level'), O.q('error'))} AND {msg_or_title('refused')}
  WHEN 1 THEN NOT {O.has_tag('e.tags', O.q('env'), O.q('staging'))} AND {O.has_tag('e.tags', O.q('os'), O.q('linux'))}
  WHEN 2 THEN {msg_or_title('FAILED id')} AND {O.has_tag('e.tags', O.q('k'), 'CAST((s.n * 3) % 100 AS VARCHAR)')}
  ELSE {O.has_tag('e.tags', O.q('release'), "'nordland@1.' || CAST(s.n % 4 AS VARCHAR) || '.0'")}
       AND NOT {O.has_tag('e.tags', O.q('level'), O.q('info'))} END"""


@register("saved_search_matches", O.sql(f"""
SELECT s.search_id, CAST(count(e.gid) AS BIGINT) AS match_events, CAST(count(DISTINCT e.gid) AS BIGINT) AS match_issues
FROM ss s LEFT JOIN live e ON e.pid = s.pid AND e.created_at >= s.frm AND e.created_at <= s.to AND {_ss_pred()}
GROUP BY s.search_id""", f"""ss AS (SELECT CAST(n_nationkey AS BIGINT) AS search_id, n_nationkey AS n,
       CAST(n_nationkey % 5 + 1 AS INTEGER) AS pid, {O.T_NOW} - to_days(CAST(n_nationkey + 1 AS INTEGER)) AS frm,
       {O.T_NOW} AS "to" FROM nation)"""))
def _saved_search_matches(spark, d):
    return PC.saved_search_matches(A.ev(spark, d), A.saved_searches(spark, d))


@register("saved_search_matches_many", O.sql(f"""
SELECT s.search_id, CAST(count(e.gid) AS BIGINT) AS match_events, CAST(count(DISTINCT e.gid) AS BIGINT) AS match_issues
FROM ss s LEFT JOIN ev_tokens e ON e.pid = s.pid AND e.created_at >= s.frm AND e.created_at <= {O.T_NOW}
  AND list_has_all(e.tokens, s.must) AND NOT list_has_any(e.tokens, s.never) AND instr(e.folded, s.phrase) > 0
GROUP BY s.search_id""", f"""
ss AS (SELECT p_partkey AS search_id, CAST(p_partkey % 5 + 1 AS INTEGER) AS pid,
         {O.T_NOW} - to_days(CAST(p_partkey % 30 + 1 AS INTEGER)) AS frm,
         CASE p_partkey % 5 WHEN 0 THEN ['user=id:' || CAST(p_partkey % 1000 AS VARCHAR)]
           WHEN 1 THEN ['k=' || CAST(p_partkey % 100 AS VARCHAR), 'os=linux']
           WHEN 3 THEN ['release=nordland@1.' || CAST(p_partkey % 4 AS VARCHAR) || '.0'] ELSE []::VARCHAR[] END AS must,
         CASE p_partkey % 5 WHEN 3 THEN ['level=info'] WHEN 4 THEN ['env=staging', 'level=' || ['error', 'info', 'debug'][p_partkey % 3 + 1]]
           ELSE []::VARCHAR[] END AS never,
         CASE p_partkey % 5 WHEN 2 THEN 'id=' || CAST(p_partkey % 1000 AS VARCHAR) || ' ' WHEN 3 THEN 'refused' ELSE '' END AS phrase
       FROM part),
ev_tokens AS (SELECT pid, gid, created_at, list_transform(tags, lambda t: {O.STORED_TOKEN}) AS tokens,
         translate(message, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(10) ||
         translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM live)"""))
def _saved_search_matches_many(spark, d):
    return PC.saved_search_matches(A.ev(spark, d), A.part_searches(spark, d))

