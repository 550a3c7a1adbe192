import random
import re

from faultline.llm import winnowing as N


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            x = words(x)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids)))
    return sorted(out, key=str)


def test_brute_force(spark):
    rng = random.Random(8)
    vocab = "a b c d e f g h".split()  # repeats and ties everywhere
    text = lambda n, v=vocab: " ".join(rng.choice(v) for _ in range(n))
    wide = ["u%d" % i for i in range(60)]
    items = [(i, text(rng.choice([1, 3, 6, 9, 10, 11, 14, 25]), wide)) for i in range(40)] + [(90, "a " * 14), (91, "a b " * 6)]
    docs = []
    for i in range(120):
        w = text(rng.randrange(0, 80), rng.choice([vocab, wide])).split()
        for _ in range(rng.randrange(3)):
            x = words(rng.choice(items)[1])
            a = rng.randrange(len(x))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [y.upper() for y in x[a : a + rng.randrange(1, 20)]]
        docs.append((i, rng.choice([" ", ", ", "-"]).join(w)))
    docs += [(500, None), (500, None), (501, "a " * 40), (None, "a " * 12)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = N.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()], key=str) == brute(docs, items)


def test_stage(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = N.decontaminate(spark, docs, edge_dir)
    assert out.schema == docs.schema
    left = [r["doc_id"] for r in out.collect()]
    assert not {8, 9, 10, 11, 12, 14} & set(left) and {1, 5, 6, 13, 15, 100} <= set(left)
