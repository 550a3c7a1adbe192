import random
import re

import numpy as np
import pytest

from faultline.llm import partenum as P


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for j, (x, _) in enumerate(rows) if find(j) == find(i) and x is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def family(rng, vocab, size, copies, edits):
    base = [rng.choice(vocab) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(vocab)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_components(spark, edge_rows, n, num, den):
    rng = random.Random(3)
    vocab = ["v%d" % i for i in range(300)]
    texts = [t for size, copies, edits in [(8, 12, 1), (30, 20, 2), (120, 30, 6), (400, 25, 20), (60, 40, 5)] for t in family(rng, vocab, size, copies, edits)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    rows = list(enumerate(texts, 1000)) + [(r["doc_id"], r["text"]) for r in edge_rows if r["doc_id"] != 15]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in P.jaccard_components(docs, n, num, den).collect()]
    assert sorted(got, key=str) == brute(rows, n, num, den)


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    for num, den in [(85, 100), (80, 100), (50, 100)]:
        for size in [1, 2, 3, 5, 6, 7, 8, 12, 13, 20, 50, 137, 400]:
            for _ in range(12):
                a = rng.integers(1, 1 << 54, size, dtype=np.uint64)
                drop = rng.integers(0, size + 1)
                b = np.concatenate((a[drop:], rng.integers(1, 1 << 54, rng.integers(0, size + 1), dtype=np.uint64)))
                common = len(a) - drop
                if not len(b) or den * common < num * (len(a) + len(b) - common):
                    continue
                doc = np.concatenate((np.zeros(len(a), np.int64), np.ones(len(b), np.int64)))
                row, sig = P.signatures(np.array([len(a), len(b)]), doc, np.concatenate((a, b)), num, den)
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_sketches_never_overstate():
    rng = np.random.default_rng(2)
    for size in [3, 100, 880, 1500, 4000, 15_000]:
        a = rng.integers(1, 1 << 54, size, dtype=np.uint64)
        b = np.concatenate((a[size // 5 :], rng.integers(1, 1 << 54, size // 7, dtype=np.uint64)))
        sizes = np.array([len(a), len(b)])
        doc = np.repeat([0, 1], sizes)
        x, y = P.sketches(sizes, doc, np.concatenate((a, b))).to_pylist()
        assert P.differing([x], [y])[0] <= size // 5 + size // 7
        assert P.differing([x], [x])[0] == 0


def test_allowed_is_exact():
    for num, den in [(85, 100), (80, 100)]:
        for s in range(1, 40):
            for t in range(1, 40):
                best = [s + t - 2 * c for c in range(min(s, t) + 1) if den * c >= num * (s + t - c)]
                assert P.allowed(np.array([s]), np.array([t]), num, den)[0] == (max(best) if best else -1)


def test_blocks(spark, monkeypatch):
    """A bucket larger than one block is compared whole."""
    rng = random.Random(9)
    monkeypatch.setattr(P, "BLOCK", 8)
    vocab = ["v%d" % i for i in range(50)]
    rows = list(enumerate(t for _ in range(6) for t in family(rng, vocab, 9, 14, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in P.jaccard_components(docs, 4, 60, 100).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 60, 100)


def test_families_that_recur_in_every_partition(spark):
    """Rows of a set and its local hub come from each partition; they count once when buckets are told apart."""
    rng = random.Random(9)
    vocab = ["v%d" % i for i in range(50)]
    rows = list(enumerate(t for _ in range(6) for t in family(rng, vocab, 9, 14, 2)))
    docs = lambda copies: spark.createDataFrame(spark.sparkContext.parallelize(rows * copies, copies), "doc_id long, text string")
    alone = spark.createDataFrame([], "node long, root long")

    def groups(docs):
        bucket = P.members(docs.select("text"), 4, 60, 100, 4)
        nodes = P.shingle_table(docs, 4).select("node", "size", "sketch").dropDuplicates(["node"])
        held = {}
        for r in P.open_members(bucket, alone, nodes).select("sig", "node").collect():
            held.setdefault(r["sig"], set()).add(r["node"])
        return {frozenset(x) for x in held.values()}

    want = groups(docs(1))
    assert len(want) > 20
    assert groups(docs(2)) == want
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in P.jaccard_components(docs(4), 4, 60, 100).collect()]
    assert sorted(got, key=str) == brute(rows * 4, 4, 60, 100)


def test_stage_keeps_one_of_each_group(spark, edge_dir, edge_rows):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = P.near_duplicates(spark, docs, edge_dir)
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in edge_rows]
    keep = {}
    for (d, _, c), (d2, t) in zip(brute_ordered(rows), rows):
        if shingles(t, 5):
            keep.setdefault(c, set()).add((d, t))
        else:
            keep.setdefault(("empty", d, t), set()).add((d, t))
    want = sorted(str(min(v, key=lambda x: (x[0] is None, x[0] or 0))) for v in keep.values())
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == want


def brute_ordered(rows):
    tagged = {}
    out = brute(rows, 5, 80, 100)
    for d, n, c in out:
        tagged.setdefault((d, n), []).append(c)
    return [(d, len(shingles(t, 5)), tagged[(d, len(shingles(t, 5)))].pop()) for d, t in rows]


def test_signatures_leave_a_map_task_in_bounded_pieces(spark, monkeypatch):
    """Long texts in one Arrow batch: signatures are sent on as they come, and links between pieces are not lost."""
    from unittest.mock import MagicMock

    import pyarrow as pa

    rng = random.Random(21)
    vocab = ["v%d" % i for i in range(5000)]
    rows = list(enumerate(t for _ in range(5) for t in family(rng, vocab, 20_000, 1, 300)))
    monkeypatch.setattr(P, "FLUSH", 4000)
    monkeypatch.setattr(P.W, "groups", lambda off, rows, size: [(i, i + 1) for i in range(len(off) - 1)])
    with monkeypatch.context() as m:
        sizes, taken = [], []
        real = P.by_signature
        m.setattr(P, "by_signature", lambda sig, node: (sizes.append(len(sig)), real(sig, node))[1])
        m.setattr(P, "map_arrow", lambda df, run, schema: (taken.append(run), MagicMock())[1])
        P.members(MagicMock(), 4, 85, 100, 200)
        out = list(taken[0](iter([pa.record_batch([pa.array([t for _, t in rows])], names=["text"])])))
        one_text = 14_000  # the bound is FLUSH and the signatures of one piece of text
        assert len(sizes) == len(rows) and max(sizes) < P.FLUSH + one_text
        assert len(out) > len(rows) and all(b.num_rows <= 64 for b in out)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in P.jaccard_components(docs, 4, 85, 100).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85, 100)


def test_shingling_holds_little_beside_its_texts():
    """Features and signatures of some megabytes of texts are made a small piece at a time."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(22)
    vocab = ["v%d" % i for i in range(5000)]
    buf, off = P.W.utf8(pa.array([" ".join(rng.choices(vocab, k=700)) for _ in range(1000)]))
    assert len(buf) > 3 << 20
    tracemalloc.start()
    try:
        got = 0
        for _, rows, doc, feature in P.shingle_sets(buf, off, 5):
            size, _ = P.set_ids(rows, doc, feature)
            P.signatures(size, doc, feature, 80, 100)
            got += rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 1000 and peak < 20 << 20


def test_a_worker_gives_memory_back_after_each_task(spark, monkeypatch):
    from unittest.mock import MagicMock

    from faultline.llm import shared as S

    steps = []
    monkeypatch.setattr(S, "give_back", lambda: steps.append("given back"))
    monkeypatch.setattr(S, "ship_package", lambda spark: None)
    docs = MagicMock()
    S.map_arrow(docs, lambda batches: (steps.append(b) or b for b in batches), "x long")
    run = docs.mapInArrow.call_args.args[0]
    assert list(run(iter([1, 2]))) == [1, 2] and steps == [1, 2, "given back"]
    left = run(iter([3, 4]))
    assert next(left) == 3
    left.close()  # a task that ends early
    assert steps[3:] == [3, "given back"]
    monkeypatch.undo()
    S.give_back()  # whatever the C library has
    out = S.map_arrow(spark.range(10), lambda batches: batches, "id long")
    assert sorted(r["id"] for r in out.collect()) == list(range(10))
