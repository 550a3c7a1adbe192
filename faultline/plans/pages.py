"""Composite plans behind the product's pages.

Each page of the original is a sequence of store round trips stitched together
in application code; here each is one lazy DataFrame plan: semi joins for the
id lists, inner / left joins for the lookups, windows partitioned by project or
issue for the per-group pages, and a TakeOrdered (``orderBy().limit()``) for a
global top-k page, so no full sort and nothing collected on the driver.
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import columns as X
from faultline.functions import predicates as P
from faultline.operators import analytics as Q
from faultline.operators import layout as L
from faultline.operators import relational as R

GO_EPOCH_OFFSET = 62135596800  # fixed: seconds from 0001-01-01 to 1970-01-01 (Go's Truncate origin)
NEW_ISSUE_AGE = _dt.timedelta(days=7)
PAGE_SIZE = 5  # fixed: issues per project page
DEFAULT_PERIOD = "24h"
VIEWS = ("all", "new")


# X1 / X28 (driver-side: parameters, not data) -------------------------------------
def duration_seconds(text: str) -> int | None:
    """X1 for one request parameter: '<int><h|m|s|d|w>' -> seconds; '' -> 0; else None."""
    if text == "":
        return 0
    units = X.DURATION_UNIT_SECONDS
    num, unit = text[:-1], text[-1:]
    if unit not in units:
        return None
    try:
        n = int(num, 10)
    except ValueError:
        return None
    return abs(n) * units[unit]


def period_window(now: _dt.datetime, period: str | None, start: str | None = None, end: str | None = None,
                  page: str = "issues", first_seen: _dt.datetime | None = None) -> tuple[_dt.datetime, _dt.datetime]:
    """(from, to) of a page request.

    issues: start+end first, else period, zero -> 14 days; project: period, else
    start+end; tags / popular: period, default 24 h; events: period, else
    start+end, else issue first_seen - 1 s .. now.
    """
    def parse_pair():
        if start and end:
            fmt = "%Y-%m-%dT%H:%M:%S"
            return _dt.datetime.strptime(start[:19], fmt), _dt.datetime.strptime(end[:19], fmt)
        return None

    if page == "issues":
        pair = parse_pair()
        if pair:
            return pair
        secs = duration_seconds(period or "") or 14 * 86400
        return now - _dt.timedelta(seconds=secs), now
    if page in ("tags", "popular"):
        secs = duration_seconds(period or "") if period else None
        return now - _dt.timedelta(seconds=secs or 86400), now
    if page == "events" and not period and not (start and end) and first_seen is not None:
        return first_seen - _dt.timedelta(seconds=1), now
    secs = duration_seconds(period or "")
    if secs:
        return now - _dt.timedelta(seconds=secs), now
    pair = parse_pair()
    if pair:
        return pair
    raise ValueError("period or start and end required")


# Q14 ---------------------------------------------------------------------------
def _go_trunc(epoch: int, interval: int) -> int:
    return math.floor((epoch + GO_EPOCH_OFFSET) / interval) * interval - GO_EPOCH_OFFSET


def dashboard_grid(now: _dt.datetime, period: str = DEFAULT_PERIOD) -> tuple[int, int, int]:
    """Bucket grid (start epoch, interval seconds, bucket count) of a dashboard: every bucket up to ``now``, however
    many the period has."""
    secs = duration_seconds(period or DEFAULT_PERIOD) or duration_seconds(DEFAULT_PERIOD)
    interval = 3600 if secs <= 86400 else (6 * 3600 if secs <= 7 * 86400 else 86400)
    now_e = int(now.replace(tzinfo=_dt.timezone.utc).timestamp())
    end = now_e - now_e % 3600 + 3600
    start = end - secs if secs >= 6 * 3600 else end - 86400
    start, end = _go_trunc(start, interval), _go_trunc(end, interval)
    if end < now_e:
        end += interval
    return start, interval, (end - start) // interval


def dashboard_series(per_hour: DataFrame, now: _dt.datetime, period: str = DEFAULT_PERIOD) -> DataFrame:
    """Q14: hourly counts (summed over projects) folded into a zero-filled bucket series.

    ``per_hour`` is the Q1 output (ts, pid, event_count).  Hours outside every
    bucket are dropped.  Output: bucket (timestamp), event_count.
    """
    start, interval, n = dashboard_grid(now, period)
    spark = per_hour.sparkSession
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    b = F.floor((epoch - F.lit(start)) / F.lit(interval)).cast("bigint")
    counts = per_hour.select(b.alias("b"), "event_count").where((F.col("b") >= 0) & (F.col("b") < n)).groupBy(
        "b").agg(F.sum("event_count").alias("c"))
    grid = spark.range(n).select(F.col("id").alias("b"))
    return grid.join(counts, "b", "left").select(
        F.timestamp_seconds(F.lit(start) + F.col("b") * F.lit(interval)).cast("timestamp_ntz").alias("bucket"),
        F.coalesce("c", F.lit(0)).cast("bigint").alias("event_count"))


# Q15 ---------------------------------------------------------------------------
def project_totals(projects: DataFrame, events: DataFrame, now: _dt.datetime) -> DataFrame:
    """Q15: every project with its last-24h hourly series (text) and total; projects
    without events keep an empty series and total 0."""
    per_hour = Q.events_per_hour(events, now - _dt.timedelta(days=1), now, limit=None)
    series = per_hour.groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_count"))).alias("s"),
        F.sum("event_count").alias("total"))
    p = projects.select(F.col("id").alias("pid"), "name")
    j = p.join(series, "pid", "left")
    text = F.array_join(F.transform(F.coalesce("s", F.array()), lambda x: F.concat(
        F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm"), F.lit("="), x["event_count"].cast("string"))), ",")
    return j.select("pid", "name", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
                    text.alias("series"))


# P11 / P12 ---------------------------------------------------------------------
def issues_in_window(issues: DataFrame, frm, to, pids=None) -> DataFrame:
    """last_seen in [frm, to] OR first_seen in [frm, to] (an issue spanning the
    whole window is excluded, as in the original)."""
    lo, hi = X.ts_lit(frm), X.ts_lit(to)
    c = F.col("last_seen").between(lo, hi) | F.col("first_seen").between(lo, hi)
    df = issues.where(c)
    return df if pids is None else df.where(F.col("project_id").isin(list(pids)))


def new_issues(entries: DataFrame, now: _dt.datetime) -> DataFrame:
    """In-window first_seen strictly after now - 7 days."""
    return entries.where(F.col("first_seen") > X.ts_lit(now - NEW_ISSUE_AGE))


def _window_issues(issues: DataFrame, events: DataFrame, frm, to, pids=None, query: str | None = None) -> DataFrame:
    """Issues active in the window that match the query (if there is one; its issues are written once, as pages read
    them for the rows and for the total)."""
    iw = issues_in_window(issues, frm, to, pids)
    if query:
        groups = L.written(Q.filtered_groups(events, P.parse_query(query), frm, to, pids), "matching-issues")
        iw = iw.join(groups.select(F.col("gid").alias("id")), "id", "left_semi")
    return iw


def _entries(issues: DataFrame, events: DataFrame, comments: DataFrame, frm, to, pids=None,
             query: str | None = None) -> DataFrame:
    """Issues in the window with their in-window metrics (inner) and comment counts (left)."""
    return _with_metrics(_window_issues(issues, events, frm, to, pids, query), events, comments, frm, to, pids)


def _with_metrics(iw: DataFrame, events: DataFrame, comments: DataFrame, frm, to, pids=None) -> DataFrame:
    metrics = Q.issue_metrics(events, frm, to, pids).withColumnRenamed("gid", "id")
    base = iw.select("id", "project_id", "message", "error_type", "view", "priority").join(metrics, "id")
    counts = R.message_counts(iw.select("id"), comments).withColumnRenamed("issue_id", "id")
    return base.join(counts, "id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)).cast("bigint"))


def _order():
    return [F.desc("times_seen"), F.desc("last_seen"), F.asc("id")]


# Q16 ---------------------------------------------------------------------------
def issue_list(issues: DataFrame, events: DataFrame, comments: DataFrame, frm, to, pids=None,
               query: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q16: issues of the projects in the window (optionally matching a search
    query), most seen first, page ``offset .. offset+limit``; ``total`` is the
    number of entries before paging.  The page is a TakeOrdered of
    offset+limit rows; the total a scalar subquery."""
    iw = _window_issues(issues, events, frm, to, pids, query)
    entries = _with_metrics(iw, events, comments, frm, to, pids)
    limit = max(limit, 0)
    offset = max(offset, 0)
    top = entries.orderBy(*_order()).limit(offset + limit)
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(*_order()))).where(F.col("rn") > offset)
    # An entry is an issue of the window with an event in it: counting them needs no metrics.
    seen = Q.live_between(events, frm, to, True).select(F.col("gid").alias("id"))
    total = iw.join(seen, "id", "left_semi")
    return ranked.withColumn("total", total.agg(F.count(F.lit(1)).alias("total")).scalar())


# Q17 ---------------------------------------------------------------------------
def project_issue_page(issues: DataFrame, events: DataFrame, comments: DataFrame, frm, to,
                       now: _dt.datetime, view: str = "all", page: int = 1, page_size: int = PAGE_SIZE
                       ) -> DataFrame:
    """Q17 (batch over projects): per project the counts of all and new issues and
    page ``page`` of the chosen view (P13: anything but 'new' means 'all');
    page <= 0 -> every entry; a page past the end -> no rows.

    The counts are a per-project aggregate joined back; the ranking keeps only
    the first page * page_size rows per project (a WindowGroupLimit, applied
    before the shuffle too), so a project holding most issues is never sorted
    whole in one task.
    """
    view = view if view in VIEWS else "all"
    entries = _entries(issues, events, comments, frm, to)
    entries = entries.withColumn("is_new", F.col("first_seen") > X.ts_lit(now - NEW_ISSUE_AGE))
    counts = entries.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_all"), F.sum(F.col("is_new").cast("int")).cast("bigint").alias("total_new"))
    shown = entries if view == "all" else entries.where("is_new")
    ranked = shown.withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy(*_order())))
    if page > 0:
        ranked = ranked.where(F.col("rn") <= page * page_size)
    ranked = ranked.withColumn("page", F.floor((F.col("rn") - 1) / page_size).cast("bigint") + 1)
    if page > 0:
        ranked = ranked.where(F.col("page") == page)
    return ranked.join(counts, "project_id")


# Q18 ---------------------------------------------------------------------------
DAY = "\x00day"  # not a tag key: the days of an issue are counted in the same pass as its tag values


def _metrics(live: DataFrame) -> DataFrame:
    return live.groupBy("gid").agg(
        F.count(F.lit(1)).alias("times_seen"), F.min("created_at").alias("m_first"), F.max("created_at").alias("m_last"),
        F.count_distinct(F.nullif(F.col("user_ref"), F.lit(""))).alias("user_count"))


def _metrics_since(issues: DataFrame, events: DataFrame, now: _dt.datetime) -> DataFrame:
    """Per issue the metrics from first_seen - 10 min to now.

    Every event of an issue is normally younger than that, so one aggregate without the bound is right for it, and no event
    is joined to its issue.  Issues with an older event (seen by the minimum) are counted again with the bound.
    """
    upto = Q.live_between(events, _dt.datetime(1970, 1, 5), now, True)
    per = L.written(_metrics(upto), "issue-metrics")  # a row an issue; read twice
    lower = issues.select(F.col("id").alias("gid"), (F.col("first_seen") - F.expr("INTERVAL 10 MINUTES")).alias("lo"))
    both = per.join(lower, "gid")
    early = both.where("m_first < lo").select("gid", "lo")
    again = _metrics(upto.join(early, "gid").where("created_at >= lo"))
    return both.where("m_first >= lo").drop("lo").unionByName(again)


def _newest(events: DataFrame, now: _dt.datetime) -> DataFrame:
    """Per issue the newest event of the last 30 days before ``now``, its platform, the next older one of the last 360
    days, and the newest event exactly at ``now``, from one pass that keeps two rows for each."""
    at = X.ts_lit(now)
    recent = Q.live_between(events, now - _dt.timedelta(days=360), now, True).select(
        "gid", (F.col("created_at") == at).alias("at_now"), "created_at", "event_id", "platform")
    w = Window.partitionBy("gid", "at_now").orderBy(F.desc("created_at"), F.desc("event_id"))
    two = recent.withColumn("rn", F.row_number().over(w)).where("rn <= 2")  # a group limit
    kept = two.groupBy("gid").agg(F.collect_list(F.struct("at_now", "rn", "created_at", "event_id", "platform")).alias("e"))
    pick = lambda now_, rn: F.get(F.filter("e", lambda x: (x["at_now"] == now_) & (x["rn"] == rn)), F.lit(0))
    top, second, other = pick(False, 1), pick(False, 2), pick(True, 1)
    inside = top["created_at"] >= X.ts_lit(now - _dt.timedelta(days=30))
    shown = lambda x: F.when(inside, X.id_no_dashes(x["event_id"]))
    return kept.select("gid", shown(top).alias("latest_event_id"), F.when(inside, top["platform"]).alias("platform"),
                       shown(second).alias("next_id"), shown(other).alias("first_id"))


def issue_detail(issues: DataFrame, events: DataFrame, comments: DataFrame, assignees: DataFrame,
                 now: _dt.datetime) -> DataFrame:
    """Q18: one wide row per issue: metrics from first_seen - 10 min to now, 30-day
    and newest-day totals, top tag values with percents (text), the newest event
    and its neighbours, comment count, assignee, is_new, platform and priority.

    Events are read three times (metrics; tag values and days; newest events), and a fourth time for issues with events
    older than their first_seen.  Per-issue metrics and tag counts are written once, as several parts read them.
    """
    metrics = _metrics_since(issues, events, now)
    frm30 = now - _dt.timedelta(days=30)
    day = F.struct(F.lit(DAY).alias("key"), F.date_format("created_at", "yyyy-MM-dd").alias("value"))
    rows = Q.live_between(events, frm30, now, False).select(
        "gid", F.inline(F.concat(F.coalesce("tags", F.array().cast("array<struct<key:string,value:string>>")), F.array(day))).alias("tag", "value"))
    counts = L.written(rows.groupBy("gid", "tag", "value").agg(F.count(F.lit(1)).alias("event_count")), "tag-counts")
    totals = Q.issue_totals(counts.where(F.col("tag") == DAY).select("gid", F.to_date("value").alias("day"), "event_count"))
    tags = Q.tag_percents(counts.where(F.col("tag") != DAY)).groupBy("gid").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(
            "=", "tag", "value", F.col("percent_floor").cast("string")))), ",").alias("top_tags"))
    newest = _newest(events, now)
    messages = R.message_counts(issues, comments).withColumnRenamed("issue_id", "gid")
    a = assignees.select(F.col("issue_id").alias("gid"), F.col("username").alias("assignee"))
    base = issues.select(F.col("id").alias("gid"), "project_id", "first_seen", "priority")
    out = (base.join(metrics, "gid")  # metrics missing -> no row (the original errors)
           .join(totals, "gid", "left").join(tags, "gid", "left").join(newest, "gid", "left")
           .join(messages, "gid", "left").join(a, "gid", "left"))
    return out.select(
        "gid", "project_id", "times_seen", "user_count", F.col("m_first").alias("first_seen"),
        F.col("m_last").alias("last_seen"),
        F.coalesce("total_30d", F.lit(0)).cast("bigint").alias("total_30d"),
        F.coalesce("total_24h", F.lit(0)).cast("bigint").alias("total_24h"),
        F.coalesce("top_tags", F.lit("")).alias("top_tags"), "latest_event_id",
        F.col("next_id").alias("previous_event_id"), F.col("first_id").alias("newest_other_id"),
        F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"),
        F.coalesce("assignee", F.lit("")).alias("assignee"),
        (F.col("first_seen") > X.ts_lit(now - NEW_ISSUE_AGE)).alias("is_new"),
        X.platform_name(F.col("platform")).alias("platform_name"),
        X.priority_name(F.col("priority")).alias("priority_name"),
    )


# P7 ------------------------------------------------------------------------------
def event_page(events: DataFrame, query: str, frm, to, limit: int = 50, offset: int = 0, gids=None) -> DataFrame:
    """The event page of an issue from its search text: per issue the events that match (P7), newest first, page
    ``offset .. offset+limit``, and ``total``, how many match."""
    match = P.event_list_predicate(P.parse_query(query), F.col("message"), F.col("tags"))
    page = Q.event_list(events, frm, to, limit=limit, offset=offset, gids=gids, where=match)
    total = Q.event_count(events, frm, to, gids=gids, where=match).withColumnRenamed("event_count", "total")
    return page.join(total, "gid")
