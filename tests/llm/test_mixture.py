import pytest

from faultline.llm import mixture as M


def test_targets_fill_up(spark):
    sized = spark.createDataFrame([("b", 10), ("a", 100), (None, 1000), ("c", 30), ("c", 30), ("z", 0)], "source string, size long")
    got = {r["source"]: r for r in M.source_targets(sized).collect()}
    # a 5, b 2, c 1, z 5, null 2; 150 % of 1170 = 1755: a, b, c, z stop at twice their size, null gets the rest.
    assert {k: r["target"] for k, r in got.items()} == {"a": 200.0, "b": 20.0, "c": 120.0, "z": 0.0, None: 1415.0}
    assert sum(r["target"] for r in got.values()) == pytest.approx(1755)


def test_weights_left_are_no_frame_of_their_own(spark):
    """A frame from the current row on is summed again for each row: quadratic in the number of sources."""
    sized = spark.createDataFrame([("a", 1)], "source string, size long")
    plan = M.source_targets(sized)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), -1" in plan
    assert "currentrow$(), unboundedfollowing$()" not in plan and "0, unboundedfollowing$()" not in plan


def test_copies_follow_rates(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(6000)], "doc_id long, text string, source string")
    rows = M.mixture(docs).collect()
    for s in "abc":
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.05)
        assert {r["copies"] for r in mine} <= {int(mine[0]["target"] / mine[0]["source_size"]), int(mine[0]["target"] / mine[0]["source_size"]) + 1}
    assert rows == M.mixture(docs.repartition(7)).orderBy("doc_id").collect() or sorted(rows) == sorted(M.mixture(docs.repartition(7)).collect())


def test_stage_emits_copies(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = M.mix(spark, docs, edge_dir)
    assert out.columns == [*docs.columns, "copy"]
    plan = M.mixture(docs).collect()
    assert out.count() == sum(r["copies"] for r in plan)
    assert max(r["copy"] for r in out.collect()) <= 2


def test_documents_without_ids_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None if s == "a" else 7, f"w{i} " * (i % 9 + 1), s) for s in "abc" for i in range(20_000)], "doc_id long, text string, source string")
    rows = M.mixture(docs).groupBy("source").agg({"target": "max", "source_size": "max"}).collect()
    taken = {r["source"]: r["t"] for r in M.mixture(docs).selectExpr("source", "size * copies AS x").groupBy("source").agg({"x": "sum"}).toDF("source", "t").collect()}
    for r in rows:
        assert taken[r["source"]] == pytest.approx(r["max(target)"], rel=0.02)
