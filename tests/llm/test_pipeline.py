import random

import corpus_pipeline as C


def test_stages(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = docs
    for name, stage in C.STAGES:
        out = stage(spark, out, edge_dir)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        if name != C.STAGES[-1][0]:
            assert out.schema == docs.schema, name
    assert C.run(spark, edge_dir).count()


def test_empty(spark, empty_dir):
    assert C.run(spark, empty_dir).count() == 0


def test_decisions_take_effect(spark, tmp_path):
    """Planted rows: toxic ones, near copies and leaks go, secrets are masked, clean rows stay until the mixture."""
    from tests.llm.conftest import documents, edge_tables, write_tables
    import pyarrow as pa

    rng = random.Random(11)
    vocab = ["v%d" % i for i in range(800)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(30)
    rows, toxic, copies, leaks, secret = [], set(), set(), set(), set()
    for i in range(900):
        kind = i % 9
        t = text(rng.randrange(60, 90))
        if kind == 1:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "foul"]))
            t = " ".join(w)
            toxic.add(i)
        if kind == 2 and i > 9:
            t = rows[i - 9][1] + " tail"
            copies.add(i)
        if kind == 3:
            w = item.split()
            t = t + " " + " ".join(w[5:20]) + " " + text(5)
            leaks.add(i)
        if kind == 4:
            t = t + " token=abcdef0%d " % i + text(5)
            secret.add(i)
        rows.append((i, t, "en", "s%d" % (i % 3)))
    tables = edge_tables() | {
        "documents": documents(rows),
        "benchmark": pa.table({"item_id": [1], "text": [item]}),
        "labels": pa.table({"doc_id": list(range(0, 900, 2)), "quality": [1] * 450, "toxic": [int(i in toxic) for i in range(0, 900, 2)]}),
    }
    path = write_tables(tmp_path / "t", tables)
    out = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, out, path)
        kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
    everyone = set(range(900))
    assert set(kept["toxicity"]) == everyone - toxic
    assert set(kept["near_duplicates"]) == everyone - toxic - copies
    clean = everyone - toxic - copies - leaks
    assert set(kept["decontamination"]) == clean
    assert set(kept["secrets"]) == clean
    assert all(("[assign]" in t) == (i in secret) for i, t in kept["secrets"].items())
    assert set(kept["mixture"]) <= clean and kept["mixture"]


def test_columns_that_clash_with_outputs(spark, edge_dir):
    from pyspark.sql import functions as F

    from faultline.llm import langid, lm_trie, mixture, url_filter

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    names = ["size", "source_size", "target", "copies", "copy", "lang_pred", "spans", "n_tokens", "base_score", "rate", "shard", "node", "sig"]
    wide = docs.select("*", *[F.lit("x").alias(c) for c in names])
    n = docs.count()
    model = langid.fit(docs)
    assert langid.identify(wide, model).count() == n
    assert lm_trie.score_texts(wide, lm_trie.train_model(docs)).count() == n
    plan = mixture.mixture(wide)
    assert plan.count() == n and plan.schema["size"].dataType.simpleString() == "bigint"
    out = wide
    for name, stage in C.STAGES:
        out = stage(spark, out, edge_dir)
        assert [c for c in out.columns if c != "copy"] == [c for c in wide.columns if c != "copy"], name
    pages = spark.read.parquet(f"{edge_dir}/pages.parquet").withColumn("host", F.lit(1)).withColumn("listed", F.lit(2))
    assert url_filter.url_filter(pages, pages.limit(0), []).count() == pages.count()
