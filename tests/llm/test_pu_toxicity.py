import random

import numpy as np

from faultline.llm import pu_toxicity as T


def test_learns_planted_words(spark):
    rng = random.Random(1)
    vocab = ["v%d" % i for i in range(500)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "foul", "nasty"]) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(w), "x"))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
        rows[-1] = (*rows[-1], toxic)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for part in (True, False):
        hit = [got[i]["predicted"] == t for i, _, _, t in rows if got[i]["held_out"] == part]
        assert np.mean(hit) > 0.97
    assert not any(got[i]["predicted"] for i, _, _, t in rows if not t)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_no_labels_and_no_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["score"], r["predicted"]) for r in T.toxicity(docs, none).collect()} == {(1, 0.5, 0), (2, 0.5, 0), (3, 0.5, 0)}


def test_risk_stays_non_negative():
    """With every word in one positive text alone, plain PU risk is unbounded below; the corrected one is not."""
    x_p = [np.array([i]) for i in range(30)]
    x_u = [np.array([30 + i]) for i in range(60)]
    w = T.fit_one(x_p, x_u, 90, 0.2)
    z_u = np.array([w[x].sum() + w[-1] for x in x_u])
    z_p = np.array([w[x].sum() + w[-1] for x in x_p])
    negative = np.logaddexp(0, z_u).mean() - 0.2 * np.logaddexp(0, z_p).mean()
    assert negative > -0.2


def test_stage_drops_only_flagged(spark, edge_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = T.drop_toxic(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    insults = {"trash", "idiot", "pathetic", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}
    import re
    gone = [r for r in docs.collect() if r["doc_id"] not in left]
    assert gone and np.mean([bool(insults & set(re.findall("[a-z]+", r["text"].lower()))) for r in gone]) > 0.7
    edge = spark.read.parquet(f"{edge_dir}/documents.parquet")
    assert T.drop_toxic(spark, edge, edge_dir).schema == edge.schema


def test_risk_equals_brute_force():
    """Both terms from the definition, text by text, and the gradient by differences, on either side of zero."""
    import numpy as np

    rng = np.random.default_rng(4)
    x_p = [np.unique(rng.integers(0, 6, rng.integers(0, 5))) for _ in range(80)]
    x_u = [np.unique(rng.integers(0, 12, rng.integers(0, 6))) for _ in range(120)]
    pos, unl = T.packed(x_p), T.packed(x_u)
    loss = lambda z: np.log1p(np.exp(-z))
    signs = set()
    for prior in (0.1, 0.9):
        for w in (rng.normal(0, 0.1, 13), rng.normal(0, 3.0, 13), np.array([3.0] * 6 + [-3.0] * 6 + [-2.0])):

            def terms(w):
                f = lambda x: sum(w[i] for i in x) + w[-1]
                first = prior * np.mean([loss(f(x)) for x in x_p])
                return first, np.mean([loss(-f(x)) for x in x_u]) - prior * np.mean([loss(-f(x)) for x in x_p])

            first, second, g = T.risk(w, pos, unl, prior)
            assert np.allclose((first, second), terms(w))
            signs.add(second >= 0)
            followed = lambda w: sum(terms(w)) if second >= 0 else -terms(w)[1]  # noqa: B023,E731
            for i in range(13):
                d = np.zeros(13)
                d[i] = 1e-5
                assert abs((followed(w + d) - followed(w - d)) / 2e-5 - g[i]) < 1e-6
    assert signs == {True, False}


def test_sample_is_bounded_in_rows(spark):
    """One id with very many texts, and one row that repeats very often."""
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "concat('text ', id) AS text")
    docs = docs.unionByName(spark.range(5000).selectExpr("2L AS doc_id", "'same' AS text")).unionByName(spark.range(50).selectExpr("id + 10 AS doc_id", "concat('t', id) AS text"))
    assert T.sample(docs, 100, "u").count() <= 100
    assert T.sample(docs, 40, "u", docs.where("doc_id > 5")).count() == 40
    assert T.sample(docs.where("doc_id <> 1"), 100, "u").where("text = 'same'").count() == 1


def test_no_text_is_shuffled_to_choose_the_sample(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    plan = T.sample(docs, 50, "u", docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("BroadcastExchange"):]
    assert "text#" not in "".join(line for line in below.splitlines() if "Exchange hashpartitioning" in line or "HashAggregate(keys" in line)


def test_score_columns_in_the_input(spark, edge_dir):
    import numpy as np

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").selectExpr("*", "1 AS toxic_score")
    out = T.score(docs, (np.zeros(0, np.uint64), np.zeros((1, 1))), keep_text=True)
    assert out.columns == [*docs.columns, "toxic_toxic_score"] and out.count() == docs.count()
    assert T.drop_toxic(spark, docs, edge_dir).columns == docs.columns
