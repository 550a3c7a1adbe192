"""Ranks and neighbours in pieces equal plain windows, with hot groups, ties, null groups and tiny samples."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import ranges as G


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(7 if i % 3 else i % 11, rng.randrange(400), i) for i in range(4000)] + [(None, 5, 9000 + i) for i in range(40)]
    return spark.createDataFrame(data, "g int, t int, id long").repartition(6)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("sample,step", [(65_536, 16), (300, 4), (50, 2), (4040, 1)])
def test_rank(rows, descending, sample, step):
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("t", "id")]
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order))).select("id", "rn")
    got = G.group_rank(rows, "g", ["t", "id"], descending=descending, sample=sample, step=step)
    assert got.columns == ["g", "t", "id", "rn"]
    assert sorted(map(tuple, got.select("id", "rn").collect())) == sorted(map(tuple, want.collect()))


def test_a_hot_group_is_many_pieces(rows):
    n = {r["g"]: r["n"] for r in G.with_pieces(rows, "g", ["t", "id"], sample=400, step=4).groupBy("g").agg(F.count_distinct("piece").alias("n")).collect()}
    assert n[7] > 30 and n[3] <= n[7]
    largest = G.with_pieces(rows, "g", ["t", "id"], sample=400, step=4).groupBy("g", "piece").count().agg(F.max("count")).first()[0]
    assert largest < 400


def test_pieces_are_a_function_of_the_data(rows):
    a, b = (G.with_pieces(rows.repartition(k), "g", ["t", "id"], 300, 4).select("id", "piece") for k in (2, 9))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_neighbors(rows):
    w = Window.partitionBy("g").orderBy("t", "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = rows.select("id", F.lag("id").over(w), F.lead("id").over(w), F.first("id").over(whole), F.last("id").over(whole))
    got = G.group_neighbors(rows, "g", ["t", "id"], "id", 300, 4).select("id", "older", "newer", "oldest", "newest")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g int, t int, id long")
    assert G.group_rank(empty, "g", ["t", "id"]).count() == 0
    assert G.group_neighbors(empty, "g", ["t", "id"], "id").count() == 0
