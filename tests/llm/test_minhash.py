import random

import numpy as np
import pytest

from faultline.llm import minhash as M
from tests.llm.test_partenum import brute, family, shingles


def check(spark, rows, n=2, num=80, den=100, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = M.near_duplicates(docs, n, num, den).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, n, num, den)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components(spark, edge_rows):
    rng = random.Random(3)
    vocab = ["v%d" % i for i in range(300)]
    texts = [t for size, copies, edits in [(8, 12, 1), (30, 20, 2), (120, 30, 9), (400, 25, 30), (60, 40, 5)] for t in family(rng, vocab, size, copies, edits)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    rows = list(enumerate(texts, 1000)) + [(r["doc_id"], r["text"]) for r in edge_rows if r["doc_id"] != 15] + [(7000, texts[3].upper())] * 2
    check(spark, rows)


@pytest.mark.parametrize("block", [8, 1024])
def test_sets_that_stay_apart_in_one_bucket(spark, monkeypatch, block):
    """Families whose members are near each other but link to some only: buckets stay open, also over several blocks."""
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(9)
    vocab = ["v%d" % i for i in range(500)]
    rows = list(enumerate(t for _ in range(5) for t in family(rng, vocab, 60, 24, 9)))
    check(spark, rows)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(2)
    for size in (40, 300, 5000):
        for part in (0.0, 0.3, 0.8, 1.0):
            common = rng.integers(1, 1 << 54, int(size * part), dtype=np.uint64)
            a, b = (np.concatenate((common, rng.integers(1, 1 << 54, size - len(common), dtype=np.uint64))) for _ in "ab")
            j = len(common) / (2 * size - len(common))
            mins = M.minima(np.concatenate((a, b)), np.array([0, size]))
            x, y = M.as_planes([r.tobytes() for r in M.packed_bits(mins)])
            assert abs(M.estimate(x, y) - j) < 0.14
            shared = (M.band_keys(mins)[0] == M.band_keys(mins)[1]).mean()
            assert abs(shared - j**M.ROWS) < 0.25 and (part or not shared)
    assert 0.6 < M.least_estimate(80, 100) < 0.7


def test_minima_do_not_depend_on_strips(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 900, 3, 2000, 40])
    x = rng.integers(1, 1 << 54, sizes.sum(), dtype=np.uint64)
    whole = M.minima(x, np.cumsum(sizes) - sizes)
    monkeypatch.setattr(M, "STRIP", 50)
    assert (M.minima(x, np.cumsum(sizes) - sizes) == whole).all()


def test_other_columns_and_empty(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").selectExpr("*", "1 AS node", "2 AS bands", "3 AS size", "4 AS root")
    assert M.near_duplicates(docs).count() == docs.count()
    assert M.near_duplicates(docs.limit(0)).count() == 0
    assert shingles("a", 2)
