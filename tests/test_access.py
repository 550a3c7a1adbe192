"""Team sets: words beyond the first, unknown users, null ids; the semi join of a viewer."""

import random

from pyspark.sql import functions as F

from faultline.operators import access as C
from faultline.operators import relational as R


def test_sets_equal_a_join(spark):
    rng = random.Random(2)
    pairs = {(u, rng.choice([rng.randrange(5), rng.randrange(60, 70), rng.randrange(100_000)])) for u in range(60) for _ in range(3)}
    members = spark.createDataFrame([*pairs, *pairs, (None, 1), (3, None)], "user_id long, team_id int")
    asked = [(i, rng.randrange(70), rng.randrange(70)) for i in range(900)] + [(901, None, 1), (902, 1, None)]
    teams = {}
    for u, t in pairs:
        teams.setdefault(u, set()).add(t)
    req = spark.createDataFrame(asked, "i int, a long, b long")
    got = {r["i"]: r["ok"] for r in C.same_team(req, members, "a", "b", "ok").collect()}
    assert got == {i: bool(teams.get(a, set()) & teams.get(b, set())) for i, a, b in asked}
    assert any(got.values()) and not all(got.values())
    owned = sorted({t for _, t in pairs})
    projects = spark.createDataFrame([(p, owned[p % len(owned)]) for p in range(200)], "id int, team_id int")
    wanted = [(i, rng.randrange(70), rng.randrange(220)) for i in range(900)]
    out = C.project_access(spark.createDataFrame(wanted, "i int, user_id long, project_id int"), projects, members).collect()
    assert {r["i"]: r["allowed"] for r in out} == {i: p < 200 and owned[p % len(owned)] in teams.get(u, set()) for i, u, p in wanted}


def test_viewer_is_a_semi_join(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "user_id long, team_id int")
    projects = spark.createDataFrame([(100, "a", 10), (101, "b", 11), (102, "c", 12)], "id int, name string, team_id int")
    see = lambda v: sorted(r["project_id"] for r in R.visible_projects(members, projects, v).collect())
    assert see([1]) == [100, 101] and see([2, 3]) == [100, 102] and see([9]) == []
    some = members.where("user_id < 3").select("user_id")
    assert see(some) == [100, 101]
    plan = R.visible_projects(members, projects, some)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "Inner" not in plan


def test_one_row_per_user_is_joined(spark):
    members = spark.createDataFrame([(1, t) for t in range(500)], "user_id long, team_id int")
    assert C.team_sets(members).count() == 1
    feed = spark.createDataFrame([(i, 1, 1) for i in range(50)], "request_id int, assigned_by long, user_id long")
    assert C.same_team(feed, members, "assigned_by", "user_id", "ok").where(F.col("ok")).count() == 50


def test_every_pair_of_user_and_project_once(spark):
    """Pairs given by several teams, repeated rows and null ids come once each; pairs are not shuffled for it."""
    rows = [(1, 10), (1, 11), (1, 11), (2, 10), (3, 12), (None, 10), (4, None)]
    owned = [(100, "a", 10), (100, "a", 11), (101, "b", 11), (101, "b", 11), (102, None, 12), (None, "d", 10), (103, "e", None)]
    members = spark.createDataFrame(rows, "user_id long, team_id int")
    projects = spark.createDataFrame(owned, "id int, name string, team_id int")
    got = [tuple(r) for r in R.visible_projects(members, projects).collect()]
    want = {(u, p, n) for u, t in rows for p, n, o in owned if t is not None and t == o}
    assert len(got) == len(want) and set(got) == want
    plan = R.visible_projects(members, projects)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")


def test_pairs_come_in_runs_of_a_project(spark):
    """Users follow one another with the same project, so a written result holds a project once a run; several teams,
    blocks of more than one run, and users and projects of two teams."""
    teams = {10: (range(700), range(300)), 11: (range(690, 900), range(295, 320)), 12: (range(5), range(299, 301))}
    members = spark.createDataFrame([(u, t) for t, (us, _) in teams.items() for u in us], "user_id long, team_id int")
    projects = spark.createDataFrame([(p, f"p{p}", t) for t, (_, ps) in teams.items() for p in ps], "id int, name string, team_id int")
    got = [tuple(r) for r in R.visible_projects(members, projects).collect()]
    want = {(u, p, f"p{p}") for us, ps in teams.values() for u in us for p in ps}
    assert len(got) == len(want) and set(got) == want
    assert sum(a[1] != b[1] for a, b in zip(got, got[1:], strict=False)) < len(got) / 50


def test_pairs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "_PAIRS_OF_TASK", 1 << 16)
    monkeypatch.setattr(R, "BLOCK", 128)
    members = spark.range(2000).selectExpr("id AS user_id", "1 AS team_id")
    projects = spark.range(500).selectExpr("CAST(id AS INT) AS id", "'n' AS name", "1 AS team_id")
    pairs = R.visible_projects(members, projects)
    assert pairs.count() == 1_000_000 and pairs.groupBy(F.spark_partition_id()).count().count() > 8
