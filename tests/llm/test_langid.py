import itertools

import numpy as np
import pyarrow as pa

from faultline.llm import langid as G
from faultline.llm import queries as Q
from faultline.llm import words as W


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in Q.SPARK["op1_language_id"](spark, path).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def model(spark):
    return G.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang"))


def test_mixed_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 400").collect()
    first = lambda k: next(r["text"] for r in rows if r["lang"] == k and r["text"].count(" ") > 60 and "#" not in r["text"] and "|" not in r["text"])
    en, de = (" ".join(first(k).split()[5:45]) for k in ("en", "de"))
    docs = spark.createDataFrame([(1, en + " " + de), (2, en), (3, None), (4, "12 34 !"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in G.identify(docs, model(spark)).collect()}
    kinds = [s["lang"] for s in got[1]["spans"]]
    assert {"en", "de"} <= set(kinds)
    cut = len(en) + 1
    right = sum(min(s["end"], cut) - s["start"] for s in got[1]["spans"] if s["lang"] == "en" and s["start"] < cut)
    right += sum(s["end"] - max(s["start"], cut) for s in got[1]["spans"] if s["lang"] == "de" and s["end"] > cut)
    assert right > 0.85 * (len(en) + len(de))
    assert got[2]["lang_pred"] == "en" and got[2]["spans"][0]["start"] == 0
    for k in (3, 4, 5):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["spans"]) == ("und", 0.0, [])


def test_scripts_narrow(spark):
    train = spark.createDataFrame([("мир привет дом " * 20, "ru"), ("house world hello " * 20, "en"), ("γεια σπίτι κόσμος " * 20, "el")], "text string, lang string")
    docs = spark.createDataFrame([(1, "кошка zebra λόγος")], "doc_id long, text string")
    row = G.identify(docs, G.fit(train)).collect()[0]
    assert [(s["start"], s["end"], s["lang"]) for s in row["spans"]] == [(0, 5, "ru"), (6, 11, "en"), (12, 17, "el")]


def test_labels_equal_brute_force():
    """The short cut for texts of one language and the batched recurrence give a best path."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh")) + " " for _ in range(rng.integers(1, 9))) for _ in range(200)]
    buf, off = W.utf8(pa.array(texts))
    w = G.Words(buf, off)
    logp = (rng.normal(size=(3, G.BUCKETS)) * 9).astype(np.float32)
    can = np.ones((len(G.SCRIPTS) + 1, 3), dtype=bool)
    label, score = G.label_words(w, logp, can)
    value = lambda path, a: sum(score[k, a + i] for i, k in enumerate(path)) - G.SWITCH_PENALTY * sum(x != y for x, y in zip(path, path[1:]))
    mixed = 0
    for a, b in zip(w.of[:-1], w.of[1:]):
        best = max(value(p, a) for p in itertools.product(range(3), repeat=b - a))
        assert abs(value(label[a:b].tolist(), a) - best) < 1e-6
        mixed += len(set(label[a:b].tolist())) > 1
    assert mixed


def test_code_points():
    texts = ["aé中😀z", "", "😀"]
    cp, text = G.code_points(*W.utf8(pa.array(texts)))
    assert cp.tolist() == [ord(c) for t in texts for c in t] and text.tolist() == [0, 5, 5, 6]
