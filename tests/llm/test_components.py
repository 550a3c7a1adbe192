import random
from itertools import combinations

from faultline.llm import minhash as M
from faultline.llm import partenum as P
from faultline.llm.components import united
from tests.llm.test_partenum import brute, family

ROWS = "key long, n long, node long, root long"


def table(spark, buckets):
    rows = [(k, len(x), v, v % 7) for k, x in buckets.items() for v in x]
    return spark.createDataFrame(rows, ROWS)


def pairs(rows):
    held = {}
    for r in rows:
        held.setdefault(r["key"], []).append(r["node"])
    return [p for x in held.values() for p in combinations(sorted(x), 2)]


def test_alike_buckets_are_one_and_others_stay(spark):
    rng = random.Random(4)
    near = {k: [v for v in range(1000, 1060) if rng.random() < 0.95] for k in range(40)}
    far = {k: rng.sample(range(5000), 6) for k in range(100, 160)}
    chain = {k: [k, k + 1] for k in range(9000, 9020)}
    given = table(spark, {**near, **far, **chain})
    got = united(given).collect()
    before, after = pairs(given.collect()), pairs(got)
    assert set(before) <= set(after)
    assert len(after) < len(before) / 5 and sum(1 for p in after if p[0] >= 1000 and p[1] < 1060) < 6 * 60 * 59 / 2
    assert len(pairs([r for r in got if r["node"] >= 9000])) <= 25  # a chain is not drawn together
    assert all(r["root"] == r["node"] % 7 for r in got)
    size = {}
    for r in got:
        size.setdefault(r["key"], []).append(r["n"])
    assert all(set(x) == {len(x)} for x in size.values())
    assert united(given.limit(0)).count() == 0


def apart(size, count, edits):
    """A family near each other, of which few are linked."""
    rng = random.Random(9)
    vocab = ["v%d" % i for i in range(500)]
    return list(enumerate(family(rng, vocab, size, count, edits)))


def test_near_sets_meet_in_few_buckets(spark, monkeypatch):
    """Rows dealt to blocks follow the number of sets, not the number of buckets that they share."""
    rows = apart(100, 120, 16)
    dealt = []
    real = M.block_pairs
    monkeypatch.setattr(M, "block_pairs", lambda rows, *a: (dealt.append((rows.count(), rows.select("node").distinct().count())), real(rows, *a))[1])
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 2, 80, 100)
    assert dealt[0][1] > 50 and all(n <= 12 * sets for n, sets in dealt), dealt


def test_pairs_of_near_sets_leave_few_buckets(spark, monkeypatch):
    rows = apart(800, 50, 110)
    made = []
    real = P.map_arrow

    def counting(df, run, schema):
        out = real(df, run, schema)
        if schema == "a long, b long" and "sig" in df.columns:
            made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(P, "map_arrow", counting)
    got = P.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 2, 80, 100)
    assert made[1][1] > 100 and all(n <= 6 * different for n, different in made), made
