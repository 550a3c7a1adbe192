import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import align as L

MODELS = tuple((Path(L.TOKENIZERS) / f).read_bytes() for f in (L.A_FILE, L.B_FILE))
HARD = ["", "a", "▁", "a▁b", "<|endoftext|> <s> </s>", "日本語のテキスト \U0001f600 é", " two  spaces\n\n", "\x00\x01", "x" * 3000, "的" * 50, "it's we'LL 1234567 ９", " " * 2500 + "x\n\n\ny"]


@pytest.fixture(scope="module")
def vocab():
    return L.vocabulary(*MODELS)


@pytest.fixture(scope="module")
def reference():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(MODELS[0].decode())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=MODELS[1])


def brute(reference, vocab, text):
    """Groups as ((a ids), (b ids)) by walking both sides."""
    if not text:
        return []
    x, y = reference[0].encode(" " + text, add_special_tokens=False).ids, reference[1].encode(text)
    if any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in zip(vocab.tokens, (x, y))):
        return []
    out, group, at = [], ([], []), [0, 0]
    x, y = list(x), list(y)
    while x or y:
        side = 0 if at[0] <= at[1] else 1
        t = (x, y)[side].pop(0)
        group[side].append(t)
        at[side] += len(vocab.tokens[side][t])
        if at[0] == at[1]:
            out.append(group)
            group = ([], [])
    return out


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def texts():
    rng = random.Random(2)
    pool = ["the", "Über", "日本", " ", "  ", "\n", "'s", "12", "-", "é", "\U0001f600", "antidisestablishmentarianism", "<s>"]
    return HARD + ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 80))) for _ in range(150)]


def test_groups(vocab, reference):
    got = L.align(vocab, texts())
    for i, t in enumerate(texts()):
        want = brute(reference, vocab, t)
        assert got["groups"][i] == shown(want)
        assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i]) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_both_encoders_of_a_agree(text):
    from tokenizers import Tokenizer

    global _slow
    try:
        _slow
    except NameError:
        _slow = Tokenizer.from_str(MODELS[0].decode())
        _slow.encode_special_tokens = True
    assert L.vocabulary(*MODELS).encode_a(text) == _slow.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 60)), max_size=5))
def test_cuts_are_the_common_ends(sides):
    base, a, b, a_text, b_text = 0, [], [], [0], [0]
    for x, y, n in sides:
        a += [base + e for e in sorted({e for e in x if e < n} | {n})]
        b += [base + e for e in sorted({e for e in y if e < n} | {n})]
        base += n
        a_text.append(len(a))
        b_text.append(len(b))
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    i, j = L.cuts(a, b, np.array(a_text), np.array(b_text))
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_a_long_stretch_without_cuts():
    a, b = np.arange(1, 40_001) * 2, np.arange(0, 40_000) * 2 + 1
    a, b = np.append(a, 90_001), np.append(b, 90_001)
    i, j = L.cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert i.tolist() == [len(a) - 1] and j.tolist() == [len(b) - 1]


def test_link_scores(spark, vocab, reference):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "the the"), (3, "the the"), (None, None), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "2 AS links").repartition(4)
    got = L.link_scores(docs).collect()
    groups = [brute(reference, vocab, t) for _, t in rows]
    links = [[(a[-1], b[-1]) for a, b in g] for g in groups]
    count = Counter(p for x in links for p in x)
    top = {}
    for (_, b), c in count.items():
        top[b] = max(top.get(b, 0), c)
    want = []
    for (doc_id, _), g, x in zip(rows, groups, links):
        sha = hashlib.sha256(shown(g).encode()).hexdigest() if g else ""
        want.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(count) <= L.pair_bound(*vocab.tokens)
    assert L.link_scores(docs.limit(0)).count() == 0


def test_groups_as_text(spark, vocab, reference):
    docs = spark.createDataFrame([(1, "Hello world, it's"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in L.aligned(docs).collect()}
    assert got == {1: shown(brute(reference, vocab, "Hello world, it's")), 2: ""}
