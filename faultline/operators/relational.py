"""Relational operators (J*, U*): issue/team/project/alert tables joined and ranked.

Dimension tables (teams, projects, channels) are small and bounded by the
number of teams or projects; the event-sized sides (issues, comments,
assignments) are joined on keys so AQE can pick broadcast vs shuffle at
runtime from the measured sizes.  No operator here uses a cross join, and
ranked outputs are windows partitioned by their natural group key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.access import same_team
from faultline.operators.ranges import group_rank


# J2 --------------------------------------------------------------------------
def message_counts(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issue -> number of comments (0 for none).  Comments are pre-aggregated per
    issue before the join, so a hot issue never ships its comments."""
    per_issue = comments.groupBy("issue_id").agg(F.count(F.lit(1)).alias("message_count"))
    return issues.select(F.col("id").alias("issue_id")).join(per_issue, "issue_id", "left").select(
        "issue_id", F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"))


# J3 --------------------------------------------------------------------------
def issue_discussion(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Comments with their authors (inner join), newest first per issue (``rn``).  An issue with a third of all
    comments is ranked in pieces (``ranges.group_rank``)."""
    u = users.select(F.col("id").alias("user_id"), "username", "email", F.col("name").alias("user_name"))
    return group_rank(comments.join(u, "user_id"), "issue_id", ["created_at", "id"])


# J4 --------------------------------------------------------------------------
def teammates(members: DataFrame, users: DataFrame, team_ids=None) -> DataFrame:
    """Members of the given teams (all teams when None) with their user row; a user in
    several of the teams appears once per team (no distinct, as in the original)."""
    m = members if team_ids is None else members.where(F.col("team_id").isin(list(team_ids)))
    u = users.select(F.col("id").alias("user_id"), "username", "email", "name")
    return m.join(u, "user_id")


# J5 --------------------------------------------------------------------------
def user_teams(members: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams of each user (equi join on team id)."""
    t = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return members.join(t, "team_id")


# J6 / U8 -----------------------------------------------------------------------
def alert_list(alerts: DataFrame, projects: DataFrame, team_ids=None, project_name: str | None = None,
               offset: int = 0, limit: int = 50) -> DataFrame:
    """Alerts with their project (inner join), filtered by team ids (None = all teams,
    [] = nothing) and project name; newest first; per team the page
    ``offset .. offset+limit`` and the team's total count."""
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    j = alerts.join(p, "project_id")
    if team_ids is not None:
        j = j.where(F.col("team_id").isin(list(team_ids))) if team_ids else j.limit(0)
    if project_name:
        j = j.where(F.col("project_name") == project_name)
    # the page alone plans as a group limit before the shuffle; the totals are a combinable aggregate joined to it
    w = Window.partitionBy("team_id").orderBy(F.desc("created_at"), F.desc("id"))
    page = j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= offset + limit).where(F.col("rn") > offset)
    total = j.groupBy("team_id").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("team_id", "_team")
    return page.join(total, F.col("team_id").eqNullSafe(F.col("_team"))).drop("_team")


def alerts_by_project(alerts: DataFrame) -> DataFrame:
    """U8: alerts of each project, newest first (``rn`` per project), ranked in pieces of a project."""
    return group_rank(alerts, "project_id", ["created_at", "id"])


# J7 / J12 ----------------------------------------------------------------------
def assignment_current(feed: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current assignee per issue from a feed of assign / delete requests.

    A request whose assignee shares no team with the requesting user is
    rejected (an AND of the two users' team sets; one row per user is joined).  The last accepted
    request per issue wins; a delete clears
    the assignment.
    """
    checked = same_team(feed, members, "assigned_by", "user_id", "_ok")
    accept = (F.col("action") == "delete") | F.col("_ok")
    accepted, rejects = checked.where(accept).drop("_ok"), checked.where(~accept).drop("_ok")
    w = Window.partitionBy("issue_id").orderBy(F.desc("created_at"), F.desc("request_id"))
    last = accepted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")  # a group limit, before the shuffle too
    current = last.where(F.col("action") != "delete").select(
        "issue_id", "user_id", "assigned_by", F.col("created_at").alias("assigned_at"))
    return current, rejects


def issue_assignees(issues: DataFrame, projects: DataFrame, assignments: DataFrame, members: DataFrame,
                    users: DataFrame) -> DataFrame:
    """Issue -> assignee, shown only when the assignee is a member of the issue's team."""
    ip = issues.select(F.col("id").alias("issue_id"), "project_id").join(
        projects.select(F.col("id").alias("project_id"), "team_id"), "project_id")
    a = assignments.join(ip, "issue_id").join(members, ["user_id", "team_id"], "left_semi")
    u = users.select(F.col("id").alias("user_id"), "username", "email")
    return ip.join(a.select("issue_id", "user_id"), "issue_id", "left").join(u, "user_id", "left").select(
        "issue_id", "project_id", "team_id", "user_id", "username", "email")


# J9 / J10 ----------------------------------------------------------------------
BLOCK = 1024  # users, and projects, of a block of pairs
_RUN = 256  # users that follow one another with one project; a multiple of 8, so that packed bits repeat at whole bytes
_PAIRS_OF_TASK = 1 << 23


def _blocks(items: DataFrame, key: list[str], block: str, out: str) -> DataFrame:
    """The rows of each ``_team`` in blocks of about ``BLOCK`` (by a hash of ``key``): (_team, block, out: array of structs)."""
    counts = items.groupBy("_team").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    placed = items.join(counts, "_team").withColumn(block, F.pmod(F.xxhash64(*key), F.col("_n")))
    return placed.groupBy("_team", block).agg(F.collect_list(F.struct(*key, "_more")).alias(out))


def visible_projects(members: DataFrame, projects: DataFrame, viewers=None) -> DataFrame:
    """(user, project) pairs where the project's team is one of the user's teams; with ``viewers`` the projects that one
    of them may see.

    A pair that several teams give is kept for the smallest of them, known from the team lists of both sides, so the
    pairs are never shuffled or held for a distinct.  Blocks of a team's users meet blocks of its projects, are dealt to
    tasks by the number of pairs, and opened there: the same run of users follows with each project of the block, which
    columnar files hold in a fraction of a byte a pair.

    viewers: user ids, or a DataFrame of them in its first column.  Two semi joins; no pairs are built.
    """
    if viewers is None:
        teams = lambda df, *key: df.where(F.col("team_id").isNotNull()).groupBy(*key).agg(
            F.collect_set("team_id").alias("_teams")).select(
            *key, F.explode("_teams").alias("_team"), F.when(F.size("_teams") > 1, F.col("_teams")).alias("_more"))
        u = teams(members, "user_id")
        p = teams(projects.select(F.col("id").alias("project_id"), "name", "team_id"), "project_id", "name")
        sizes = u.groupBy("_team").agg(F.count(F.lit(1)).alias("_u")).join(
            p.groupBy("_team").agg(F.count(F.lit(1)).alias("_p")), "_team")
        pairs = sizes.agg(F.sum(F.col("_u") * F.col("_p"))).first()[0] or 0  # one number: an upper bound of the result's rows
        met = _blocks(u, ["user_id"], "_ub", "_users").join(_blocks(p, ["project_id", "name"], "_pb", "_projects"), "_team")
        dealt = met.repartition(1 + pairs // _PAIRS_OF_TASK, "_team", "_ub", "_pb")
        runs = F.transform(F.sequence(F.lit(1), F.size("_users"), F.lit(_RUN)), lambda i: F.slice("_users", i, _RUN))
        j = dealt.select("_team", "_projects", F.explode(runs).alias("_run")).select("_team", "_run", F.explode("_projects").alias("_p"))
        j = j.select("_team", "_p", F.explode("_run").alias("_u"))
        mine, theirs = F.col("_u._more"), F.col("_p._more")  # null: this team alone
        once = mine.isNull() | theirs.isNull() | (F.col("_team") == F.array_min(F.array_intersect(mine, theirs)))
        return j.where(once).select("_u.user_id", "_p.project_id", "_p.name")
    if isinstance(viewers, DataFrame):
        mine = members.join(viewers.select(F.col(viewers.columns[0]).alias("user_id")), "user_id", "left_semi")
    else:
        mine = members.where(F.col("user_id").isin(list(viewers)))
    return projects.join(mine.select("team_id"), "team_id", "left_semi").select(
        F.col("id").alias("project_id"), "name", "team_id")


def project_list(projects: DataFrame, team_ids=None, name: str | None = None) -> DataFrame:
    """Projects of the teams with a case-insensitive LIKE '%name%' (``%``/``_`` in
    the name act as wildcards, as in the original)."""
    p = projects if team_ids is None else projects.where(F.col("team_id").isin(list(team_ids)))
    if name:
        p = p.where(F.lower(F.col("name")).like("%" + name.lower() + "%"))
    return p


# J11 / J13 ---------------------------------------------------------------------
def team_webhook(channels: DataFrame, configs: DataFrame) -> DataFrame:
    """Newest webhook channel of each team joined to its config (teams without one are absent)."""
    hooks = channels.where(F.col("channel_type") == "webhook").groupBy("team_id").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("channel_id"))
    return hooks.join(configs, "channel_id")


# U1 ----------------------------------------------------------------------------
def assigned_filters(members: DataFrame, users: DataFrame) -> DataFrame:
    """Per team: the members' usernames (distinct) UNION 'unassigned', then UNION ALL 'me'."""
    names = members.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select(
        "team_id", F.col("username").alias("assigned_value"))
    team_ids = members.select("team_id").distinct()
    fixed = team_ids.select("team_id", F.lit("unassigned").alias("assigned_value"))
    me = team_ids.select("team_id", F.lit("me").alias("assigned_value"))
    return names.unionByName(fixed).distinct().unionByName(me)


# U3 ----------------------------------------------------------------------------
def mention_dedup(comments: DataFrame) -> DataFrame:
    """One row per (message, mentioned user): sorted, de-duplicated mention lists."""
    return comments.select(F.col("id").alias("message_id"),
                           F.explode(F.array_distinct(F.array_sort("mentions"))).alias("user_id"))


# U7 ----------------------------------------------------------------------------
def pending_notifications(outbox: DataFrame, limit: int = 100) -> DataFrame:
    """Oldest pending notifications first, ``limit`` rows (a TakeOrdered, no global sort)."""
    return outbox.where(F.col("status") == "pending").orderBy("created_at", "id").limit(limit)
