"""Event analytics (Q1-Q13) as DataFrame jobs over the event table.

Every operator takes the event table (schema ``faultline.schema.EVENT``) and
returns a DataFrame; the reference's single-issue form of each query is a
``where`` on the batch form.  Conventions:

* live rows only (``deleted = 0``, P3) - the tombstone filter is applied here;
* time bounds follow the original query: half-open ``[frm, to)`` unless the
  operator documents a closed upper bound;
* ranked outputs get a deterministic tie-breaker (the group key ascending);
* aggregations are plain ``groupBy().agg()`` so Spark does a map-side partial
  aggregate before the shuffle - a hot issue (one gid with a third of all
  events) is pre-aggregated in every task and never lands whole in one task;
* per-key top-k is ``row_number() <= k``, which Catalyst turns into a
  WindowGroupLimit applied before and after the shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import columns as X
from faultline.functions import predicates as P
from faultline.operators.heavy import top_counts
from faultline.operators.ranges import group_neighbors


def _window(events: DataFrame, frm, to, closed_upper: bool, pids=None, gids=None) -> DataFrame:
    c = (F.col("deleted") == 0) & P.in_range(F.col("created_at"), X.ts_lit(frm), X.ts_lit(to), closed_upper)
    if "week" in events.columns:  # stored table: the same bounds prune whole week partitions
        monday = (frm - _dt.timedelta(days=frm.weekday())).date()
        c = c & (F.col("week") >= F.lit(monday)) & (F.col("week") <= F.lit(to.date()))
    df = events.where(c)
    return _restrict(df, pids, gids)


def live_between(events: DataFrame, frm, to, closed_upper: bool) -> DataFrame:
    """Live events of a time range, with the week bounds of the stored table."""
    return _window(events, frm, to, closed_upper)


def _restrict(df: DataFrame, pids=None, gids=None) -> DataFrame:
    """Id lists.  A Python list becomes ``IN``; a DataFrame becomes a left-semi join
    (AQE broadcasts it when its runtime size is under the broadcast threshold)."""
    for name, ids in (("pid", pids), ("gid", gids)):
        if ids is None:
            continue
        if isinstance(ids, DataFrame):
            df = df.join(ids.select(F.col(ids.columns[0]).alias(name)).distinct(), name, "left_semi")
        else:
            ids = list(ids)
            df = df.where(F.col(name).isin(ids)) if ids else df.limit(0)
    return df


def _top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k).drop(rank_col)


# Q1 -------------------------------------------------------------------------
def events_per_hour(events: DataFrame, frm, to, pids=None, limit: int | None = None) -> DataFrame:
    """Q1: events per (UTC hour, project) in [frm, to); with ``limit`` (a page size) the oldest so many rows."""
    df = (
        _window(events, frm, to, False, pids)
        .groupBy(X.trunc_ntz("hour", F.col("created_at")).alias("ts"), "pid")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )
    if limit is not None:
        df = df.orderBy("ts", "pid").limit(limit)
    return df


# Q2 -------------------------------------------------------------------------
def issue_metrics(events: DataFrame, frm, to, pids=None, gids=None, approx: bool = False) -> DataFrame:
    """Q2: per issue in [frm, to]: times_seen, first/last seen, distinct non-empty users.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``) like the
    store's ``uniq``; the default is exact.  Issues without events are absent.
    """
    user = F.nullif(F.col("user_ref"), F.lit(""))
    distinct = F.approx_count_distinct(user) if approx else F.count_distinct(user)
    return _window(events, frm, to, True, pids, gids).groupBy("gid").agg(
        F.count(F.lit(1)).alias("times_seen"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.coalesce(distinct, F.lit(0)).cast("bigint").alias("user_count"),
    )


# Q3 / Q3b -------------------------------------------------------------------
def events_per_day(events: DataFrame, frm, to, gids=None) -> DataFrame:
    """Q3: events per (issue, UTC day) in [frm, to)."""
    return (
        _window(events, frm, to, False, None, gids)
        .groupBy("gid", F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("event_count"))
    )


def issue_totals(per_day: DataFrame) -> DataFrame:
    """Total over the days, and the count of the newest day that has events
    (the original takes the first row of a day-descending list, not the last 24 h)."""
    return per_day.groupBy("gid").agg(
        F.sum("event_count").cast("bigint").alias("total_30d"),
        F.max_by("event_count", "day").cast("bigint").alias("total_24h"),
    )


# Q4 / Q5 / Q4b --------------------------------------------------------------
def _tag_rows(events: DataFrame) -> DataFrame:
    # inline drops events with no tags, like the store's ARRAY JOIN
    return events.select("gid", "created_at", F.inline("tags").alias("tag", "value"))


def _tag_value_agg(events: DataFrame, frm, to, gids=None) -> DataFrame:
    return _tag_rows(_window(events, frm, to, False, None, gids)).groupBy("gid", "tag", "value").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


def tag_value_counts(events: DataFrame, frm, to, per_tag: int = 4, limit: int = 1000, gids=None) -> DataFrame:
    """Q4: per issue, the ``per_tag`` most frequent values of each tag, then the
    ``limit`` most frequent (tag, value) rows of the issue."""
    agg = _tag_value_agg(events, frm, to, gids)
    top = _top_per_key(agg, ["gid", "tag"], [F.desc("event_count"), F.asc("value")], per_tag)
    return _top_per_key(top, ["gid"], [F.desc("event_count"), F.asc("tag"), F.asc("value")], limit)


def tag_key_counts(events: DataFrame, frm, to, limit: int = 1000, gids=None) -> DataFrame:
    """Q5: per issue, occurrences of each tag key (a key present twice in one event counts twice)."""
    agg = (
        _window(events, frm, to, False, None, gids)
        .select("gid", F.explode(F.transform("tags", lambda t: t["key"])).alias("tag"))
        .groupBy("gid", "tag")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )
    return _top_per_key(agg, ["gid"], [F.desc("event_count"), F.asc("tag")], limit)


def tag_value_percent(events: DataFrame, frm, to, per_tag: int = 4, limit: int = 1000, gids=None) -> DataFrame:
    """Q4 rows with percent = count(tag, value) / count(tag) * 100.

    The tag totals (Q5) come from the same (tag, value) aggregate summed per
    (gid, tag) - a few rows per issue - and join the top-k rows on (gid, tag);
    no window ever spans all values of a hot issue.  A tag outside the issue's
    top ``limit`` keys (absent from Q5) keeps percent 0, as in the original.
    """
    return tag_percents(_tag_value_agg(events, frm, to, gids), per_tag, limit)


def tag_percents(agg: DataFrame, per_tag: int = 4, limit: int = 1000) -> DataFrame:
    """Q4b from the counts (gid, tag, value, event_count, ...) of a window; further columns are kept."""
    more = [c for c in agg.columns if c not in ("gid", "tag", "value", "event_count")]
    top = _top_per_key(agg, ["gid", "tag"], [F.desc("event_count"), F.asc("value")], per_tag)
    top = _top_per_key(top, ["gid"], [F.desc("event_count"), F.asc("tag"), F.asc("value")], limit)
    totals = agg.groupBy("gid", "tag").agg(F.sum("event_count").cast("bigint").alias("tag_count"))
    within = _top_per_key(totals, ["gid"], [F.desc("tag_count"), F.asc("tag")], limit)  # a group limit
    within = within.select("gid", "tag", F.lit(True).alias("within"))
    joined = top.join(totals, ["gid", "tag"], "left").join(within, ["gid", "tag"], "left")
    pct = F.when(F.col("within"), F.col("event_count") / F.col("tag_count") * 100).otherwise(F.lit(0.0))
    return joined.select(
        "gid", "tag", "value", "event_count", *more, "tag_count",
        F.round(pct, 6).alias("percent"),
        X.percents_floor(pct).alias("percent_floor"),
    )


# Q6 -------------------------------------------------------------------------
def issue_event_detail(events: DataFrame, frm, to, gids=None) -> DataFrame:
    """Q6 (batch form): the newest event of each issue in [frm, to).

    ``max_by`` over (created_at, event_id) is a partial aggregate, so a hot
    issue is reduced per task before the shuffle.  The single-event form is a
    ``where(event_id = ...)`` on the table.
    """
    df = _window(events, frm, to, False, None, gids)
    cols = [c for c in df.columns if c != "gid"]
    picked = df.groupBy("gid").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "event_id")).alias("e"))
    return picked.select("gid", "e.*").withColumn("event_id", X.id_no_dashes(F.col("event_id")))


# Q7 / Q8 --------------------------------------------------------------------
def _event_filter(df: DataFrame, message: str | None, tags: dict | None) -> DataFrame:
    if message:
        df = df.where(P.contains_ci(F.col("message"), message))
    for k, (v, negate) in (tags or {}).items():
        df = df.where(P.tag_filter(F.col("tags"), k, v, negate))
    return df


def event_list(events: DataFrame, frm, to, message: str | None = None, tags: dict | None = None,
               limit: int = 50, offset: int = 0, gids=None, pids=None, where: Column | None = None) -> DataFrame:
    """Q7 (batch form): per issue, page ``offset .. offset+limit`` of its events, newest first.

    ``tags`` maps key -> (value, negate); ``where`` is a further condition.  Output adds ``os`` (tag value or '')
    and ``display_user`` (X6).
    """
    df = _event_filter(_window(events, frm, to, False, pids, gids), message, tags)
    df = df if where is None else df.where(where)
    w = Window.partitionBy("gid").orderBy(F.desc("created_at"), F.desc("event_id"))
    ranked = df.withColumn("rn", F.row_number().over(w)).where(
        (F.col("rn") > offset) & (F.col("rn") <= offset + limit))
    return ranked.select(
        "gid", X.id_no_dashes(F.col("event_id")).alias("event_id"), "created_at", "title", "message", "release",
        "env", "user_ref", "user_email", "user_username", "user_name",
        X.tag_value(F.col("tags"), "os").alias("os"),
        X.display_user(F.col("user_email"), F.col("user_username"), F.col("user_ref"), F.col("user_name"))
        .alias("display_user"),
        F.col("rn").cast("bigint").alias("rn"),
    )


def event_count(events: DataFrame, frm, to, message: str | None = None, tags: dict | None = None,
                gids=None, pids=None, where: Column | None = None) -> DataFrame:
    """Q8: events per issue under the Q7 filters."""
    df = _event_filter(_window(events, frm, to, False, pids, gids), message, tags)
    df = df if where is None else df.where(where)
    return df.groupBy("gid").agg(F.count(F.lit(1)).alias("event_count"))


# Q9 -------------------------------------------------------------------------
def event_neighbors(events: DataFrame, frm, to, **split) -> DataFrame:
    """Q9 (batch form): for every event of an issue in [frm, to], ordered by (created_at, event_id):
    ``first_id`` = newest, ``last_id`` = oldest, ``next_id`` = next older,
    ``prev_id`` = next newer; each is NULL when it is the event itself.

    No window is partitioned by the issue alone: a hot issue is cut into pieces along its order
    (``ranges.group_neighbors``), and one row per piece carries neighbours across the cuts.
    """
    df = _window(events, frm, to, True).select("pid", "gid", "created_at", "event_id")
    out = group_neighbors(df, "gid", ["created_at", "event_id"], "event_id", **split)
    me = F.col("event_id")
    return out.select(
        "pid", "gid", "created_at", X.id_no_dashes(me).alias("event_id"),
        X.id_no_dashes(F.nullif(F.col("newest"), me)).alias("first_id"),
        X.id_no_dashes(F.nullif(F.col("oldest"), me)).alias("last_id"),
        X.id_no_dashes(F.nullif(F.col("older"), me)).alias("next_id"),
        X.id_no_dashes(F.nullif(F.col("newer"), me)).alias("prev_id"),
    )


# Q10-Q13 --------------------------------------------------------------------
def field_filters(events: DataFrame, frm, to, pids=None, limit: int = 1000) -> DataFrame:
    """Q10: (tag, value) pairs over projects by frequency, top ``limit``; frequency is dropped."""
    rows = _tag_rows(_window(events, frm, to, False, pids))
    return top_counts(rows, ["tag", "value"], limit, out="freq").orderBy(F.desc("freq"), "tag", "value").select("tag", "value")


def popular_tags(events: DataFrame, frm, to, pids=None, limit: int = 1000) -> DataFrame:
    """Q11: tag keys over projects by count in [frm, to], top ``limit``."""
    rows = _window(events, frm, to, True, pids).select(F.explode(F.transform("tags", lambda t: t["key"])).alias("tag"))
    return top_counts(rows, ["tag"], limit).orderBy(F.desc("event_count"), "tag")


def tag_values(events: DataFrame, frm, to, tag: str | None = None, pids=None, limit: int = 100) -> DataFrame:
    """Q12: values of a tag by count in [frm, to], top ``limit``; with ``tag=None``
    the batch form gives the top ``limit`` values of every tag key."""
    df = _tag_rows(_window(events, frm, to, True, pids))
    if tag is not None:
        df = df.where(F.col("tag") == tag)
    return top_counts(df, ["value"], limit, by=["tag"])


def filtered_groups(events: DataFrame, tokens: list, frm, to, pids=None) -> DataFrame:
    """Q13: distinct issues with an event in [frm, to] matching every token."""
    df = _window(events, frm, to, True, pids)
    cond = P.group_search_predicate(tokens, F.col("message"), F.col("title"), F.col("tags"))
    return df.where(cond).select("gid").distinct()
