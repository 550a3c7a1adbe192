import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.llm import lm_trie as L
from faultline.llm import queries as Q


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Brute:
    def __init__(self, texts):
        self.uni, self.pair = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.pair.update(zip(["</s>"] + w, w))
        self.kept = {k: n for k, n in self.pair.items() if n >= L.MIN_PAIR}
        self.free = dict.fromkeys(self.uni, 1.0)
        for (h, _), n in self.kept.items():
            self.free[h] -= (n - L.DISCOUNT) / self.uni[h]
        self.total = sum(self.uni.values())
        self.down = self.total + 0.5 * (len(self.uni) + 1)

    def word(self, w):
        return (self.uni[w] + 0.5) / self.down

    def next(self, h, w):
        n = self.kept.get((h, w), 0)
        return (max(n - L.DISCOUNT, 0) / self.uni[h] if n else 0.0) + (self.free[h] if h in self.uni else 1.0) * self.word(w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.next(h, x)) for h, x in zip(["</s>"] + w, w))


@pytest.mark.parametrize("where", ["small", "edge"])
def test_scores(spark, edge_dir, where):
    path = edge_dir if where == "edge" else "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    brute = Brute([r["text"] for r in docs if not held(r["doc_id"])])
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"], r["base_score"], r["score"]) for r in Q.SPARK["op10_lm_scores"](spark, path).collect())
    want = sorted(
        (str(r["doc_id"]), len(tokens(r["text"])), sum(brute.uni[w] > 0 for w in tokens(r["text"])), held(r["doc_id"]), brute.total,
         sum(math.log10(brute.word(w)) for w in tokens(r["text"])), brute.score(r["text"])) for r in docs)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-4, abs=1e-4 * w[1])  # quantised


def test_brute_model_sums_to_one():
    b = Brute(["a b a b a c", "a b", "c a b"])
    for h in ["a", "b", "</s>", "unknown"]:
        assert sum(b.next(h, w) for w in [*b.uni, "<unk>"]) == pytest.approx(1.0)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = L.train_model(docs.where("false"))
    got = {r["doc_id"]: r for r in L.score_texts(docs, model).collect()}
    assert got[1]["n_tokens"] == 3 and got[2]["n_tokens"] == 1 and got[1]["n_known"] == 0
    assert got[1]["score"] == got[1]["base_score"] == 0.0


def test_pairs_seen_once_are_stored(spark):
    """A copy of exactly one training text is scored by that text's pairs."""
    texts = ["a b c d e", "f g a h", "b d f g"]
    brute = Brute(texts)
    brute.kept = dict(brute.pair)
    brute.free = {h: 1.0 - sum((n - L.DISCOUNT) / brute.uni[h] for (g, _), n in brute.pair.items() if g == h) for h in brute.uni}
    model = L.train_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = [*texts, "e d c b a"]
    got = {r["doc_id"]: r["score"] for r in L.score_texts(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(docs):
        assert got[i] == pytest.approx(brute.score(t), rel=1e-4)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_WORDS", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    wide = L.train_model(docs)
    assert wide.shards > 16
    monkeypatch.undo()
    one = L.score_texts(docs, L.train_model(docs)).select("doc_id", F.col("score").alias("x"))
    for r in L.score_texts(docs, wide).join(one, "doc_id").collect():
        assert r["score"] == pytest.approx(r["x"], rel=1e-3)


def test_folder_has_to_be_mounted():
    with pytest.raises(ValueError):
        L.local_folder("hdfs://nn/x")
    assert L.local_folder("file:///a%20b") == "/a b"
