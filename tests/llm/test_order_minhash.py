import hashlib
import re

import pytest
import xxhash

from faultline.llm import order_minhash as O

M64 = (1 << 64) - 1
LOW = (1 << O.POS) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(*xs):
    seed = 42
    for x in xs:
        if x is None:
            continue
        if isinstance(x, str):
            seed = xxhash.xxh64_intdigest(x.encode(), seed=seed)
        else:
            seed = xxhash.xxh64_intdigest((x & M64).to_bytes(8, "little"), seed=seed)
    return signed(seed)


def h_int(x, i):
    """xxhash64(long, int): an int is hashed as 4 bytes."""
    seed = xxhash.xxh64_intdigest((x & M64).to_bytes(8, "little"), seed=42)
    return signed(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=seed))


def fingerprint(text):
    w = [h(x) for x in re.split("[\x20\x09-\x0D]+", text) if x]
    if not w:
        return []
    grams = [h(*w) & ~LOW] if len(w) <= O.K else [h(*w[i : i + O.K]) & ~LOW for i in range(len(w) - O.K + 1)]
    seen, rows = {}, []
    for pos, g in enumerate(grams):
        seen[g] = seen.get(g, -1) + 1
        rows.append(((h_int(g, seen[g]) & ~LOW), pos))
    pool = sorted(((x | p, x, p) for x, p in rows))[: O.POOL]
    out = []
    for b in range(O.BINS):
        mine = [(p, rank, x) for rank, (_, x, p) in enumerate(pool) if ((x & M64) >> O.POS) % O.BINS == b][: O.L]
        if mine:
            out.append((b << 32) | (h(*[x for _, _, x in sorted(mine)]) & 0xFFFFFFFF))
    return out


def text_of(f):
    return ",".join(f"{x >> 32:x}.{x & 0xFFFFFFFF:x}" for x in f)


def like(a, b):
    bins = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        f, g = fingerprint(t), fingerprint(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(f), text_of(g), like(f, g), like(f, fingerprint(nxt))))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_a_bucket", [4096, 5])
def test_brute_force(spark, edge_rows, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(O, "BUCKET_ROWS", rows_a_bucket)
    rows = [(r["doc_id"], r["text"]) for r in edge_rows if r["doc_id"] != 1 << 40 or rows_a_bucket > 5]
    rows.append((200, "again and again and again and again " * 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in O.fingerprints(docs).collect()), key=str)
    want = expected(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:])


def test_one_row(spark):
    docs = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    assert tuple(O.fingerprints(docs).collect()[0])[5:] != ()


def test_order_matters(spark):
    w = [f"w{i}" for i in range(300)]
    moved = w[150:] + w[:150]
    rows = spark.createDataFrame([(" ".join(w), " ".join(moved), " ".join(w[:150] + w[151:]))], "a string, b string, c string")
    for c in "abc":
        rows = O.fingerprint(rows, c, "f" + c)
    got = rows.select(O.likeness("fa", "fb").alias("moved"), O.likeness("fa", "fc").alias("cut")).collect()[0]
    assert got["cut"] > 0.85 and got["moved"] < got["cut"] - 0.2


def test_every_bin_of_a_long_text_selects(spark):
    """All k-mers are looked at: each bin of a long text has its L smallest."""
    text = " ".join(f"w{i}" for i in range(20_000))
    grams = [h(*(h(f"w{j}") for j in range(i, i + O.K))) & ~LOW for i in range(20_000 - O.K + 1)]
    bins = {}
    for pos, g in enumerate(grams):
        x = h_int(g, 0) & ~LOW
        bins.setdefault(((x & M64) >> O.POS) % O.BINS, []).append((x, pos))
    want = []
    for b, held in sorted(bins.items()):
        least = sorted(held)[: O.L]
        want.append((b << 32) | (h(*[x for x, _ in sorted(least, key=lambda r: r[1])]) & 0xFFFFFFFF))
    got = O.fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "f").collect()[0]["f"]
    assert len(want) == O.BINS and got == want
