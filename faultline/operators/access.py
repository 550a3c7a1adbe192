"""Who may see what: a user's teams as one bit set, shared access as an AND of two.

A team relation has a row per (user, team).  Joined to itself, or to a log of requests, it multiplies rows by the teams
of a user; as a map word -> 63 team bits there is one row per user, so a request meets one row for each of its users and
the test is an expression on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 63  # bits of a word: a long without its sign


def team_sets(members: DataFrame, user: str = "user_id", out: str = "teams") -> DataFrame:
    """(user, teams): one row per user; teams: map of word number -> bits.  Repeated members count once."""
    team = F.col("team_id").cast("long")
    word = F.floor(team / WORD).cast("int")
    bit = F.expr(f"shiftleft(1L, CAST(pmod(CAST(team_id AS BIGINT), {WORD}) AS INT))")
    words = members.where("user_id IS NOT NULL AND team_id IS NOT NULL").groupBy(
        F.col("user_id").alias(user), word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return words.groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias(out))


def shares_team(a: Column, b: Column) -> Column:
    """Do two team sets have a common team (false if either is null)."""
    return F.coalesce(F.exists(F.map_keys(a), lambda w: a[w].bitwiseAND(b[w]) != 0), F.lit(False))


def holds_team(teams: Column, team_id: Column) -> Column:
    """Is the team in the set."""
    word = F.floor(team_id.cast("long") / WORD).cast("int")
    at = F.pmod(team_id.cast("long"), F.lit(WORD)).cast("int")
    return F.coalesce(F.bit_get(teams[word], at) == 1, F.lit(False))


def same_team(requests: DataFrame, members: DataFrame, one: str, two: str, out: str) -> DataFrame:
    """Adds ``out``: do the users in columns ``one`` and ``two`` share a team.  Both joins meet one row per user."""
    a = team_sets(members, "_one", "_a")
    b = team_sets(members, "_two", "_b")
    j = requests.join(a, F.col(one) == F.col("_one"), "left").join(b, F.col(two) == F.col("_two"), "left")
    return j.withColumn(out, shares_team(F.col("_a"), F.col("_b"))).drop("_one", "_two", "_a", "_b")


def project_access(requests: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (user_id, project_id, ...) with ``allowed``: is the project's team one of the user's teams.  An unknown
    user or project is not allowed."""
    p = projects.select(F.col("id").alias("_pid"), F.col("team_id").alias("_team"))
    s = team_sets(members, "_user", "_teams")
    j = requests.join(p, F.col("project_id") == F.col("_pid"), "left").join(s, F.col("user_id") == F.col("_user"), "left")
    return j.withColumn("allowed", holds_team(F.col("_teams"), F.col("_team"))).drop("_pid", "_team", "_user", "_teams")
