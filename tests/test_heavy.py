"""Exact top-k on skewed, flat and tied counts, with null values and few slots."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import heavy as H


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("a", f"v{int(rng.paretovariate(0.7)) % 3000}") for _ in range(6000)]  # heavy head, long tail
    data += [("b", f"u{i % 900}") for i in range(1800)]  # flat: all tied
    data += [("c", None), ("c", "x"), ("c", None), (None, "y")]
    return spark.createDataFrame(data, "tag string, value string").repartition(5)


@pytest.mark.parametrize("k", [1, 7, 40])
@pytest.mark.parametrize("slots", [1 << 16, 300, 4])
def test_per_group(rows, k, slots):
    w = Window.partitionBy("tag").orderBy(F.desc("event_count"), "value")
    want = rows.groupBy("tag", "value").agg(F.count("*").alias("event_count")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    got = H.top_counts(rows, ["value"], k, by=["tag"], slots=slots)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_overall(rows):
    want = rows.groupBy("tag", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag", "value").limit(25)
    got = H.top_counts(rows, ["tag", "value"], 25, out="n", slots=500)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert H.top_counts(rows.limit(0), ["value"], 5).count() == 0


def test_few_values_are_counted_when_the_head_is_heavy(spark):
    """A long tail of single values stays out of the second and third count."""
    df = spark.range(40_000).select(F.when(F.col("id") < 20_000, F.concat(F.lit("h"), (F.col("id") % 10).cast("string"))).otherwise(F.col("id").cast("string")).alias("value"))
    totals = df.groupBy(H._slot(["value"], 4096).alias("s")).count()
    assert totals.where("count >= 2000").count() == 10  # the slots that have to be counted after the bound is known
    assert {r["value"]: r["event_count"] for r in H.top_counts(df, ["value"], 10, slots=4096).collect()} == {f"h{i}": 2000 for i in range(10)}
