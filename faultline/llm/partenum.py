"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles (lower-cased A-Z; with fewer words the whole sequence as one).
Equal sets are one node, identified by a 64-bit hash of the set, so copies cost one node whatever their number.

Two sets of sizes s <= t with Jaccard similarity >= num / den have t <= s * den / num and differ in at most
(den - num) * (s + t) / (den + num) elements.  Sizes fall into bands whose ends grow by den / num; a set
emits signatures for its own band and, if a partner may lie there, for the next one.  In a band with at most K
differences the feature domain is hashed into ceil((K + 1) / 2) + m groups of 3 parts: at least m + 1 groups hold at
most one difference each, so two of their three parts agree.  Each (group, subset of two parts) gives one signature:
hash of the features in it.  So every pair of similar sets shares signatures in m + 1 groups; no candidate is capped.
A signature of no features says nothing and would bring unrelated sets together.  A set with such signatures in m
groups or fewer leaves them out: of the m + 1 shared groups one has features, for both sets alike.

Candidates are then confirmed exactly:

1. In every bucket (sets with one signature) each set is compared with one hub.  A map task sends only one set a
   signature on (the smallest; the others meet it there), so a signature that a third of all rows share reaches
   its bucket as often as there are map batches.
2. Links that hold give components.  A bucket with one component needs no more work, which covers groups of near
   copies of any size.
3. Of the other buckets one for each distinct group of sets remains, and alike ones are made one where that means no more
   pairs (``united``); in it all sets of different components are compared inside blocks of ``BLOCK`` x ``BLOCK`` sets.  First only the closest pair of every two components leaves a
   task and is counted, which joins nearly all that belong together; then every pair that still lies between components
   does, so the result has every link's effect on the components.

Comparisons first use the parity sketch: 512 bits, four times as many for each further factor 4 of the size over
``SMALL``, each the parity of the features hashed to it; a long sketch folds into a short one.  The number of bits in which two sketches differ never exceeds
the number of features in which the sets differ, so a pair with more different bits than allowed is no link.  The
rest is counted exactly on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words as W
from faultline.llm.components import extend_components, united
from faultline.llm.shared import bitmap, in_bitmap, map_arrow, materialize

U64 = np.uint64
SHORT_BITS = 512
SMALL = 900
BLOCK = 1024
#: Signatures of one shard, which one task sorts in memory.  Inside a shard 32 bits of a signature are kept: two
#: different ones meet with a chance of some 10^-4, which costs a comparison and loses nothing.
SHARD_ROWS = 500_000
#: Signatures that a map task holds before it sorts and sends them on, whatever the size of an Arrow batch; one text
#: may add its own.
FLUSH = 500_000
#: Bytes of text that are shingled at a time: every byte needs some dozens of bytes of features and signatures.
CHUNK = 1 << 18
HASH_BITS = 54  # features keep 54 bits, so that (row in chunk, feature) sorts as one key


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, features sorted by row and value), in chunks of rows."""
    for a, b in W.groups(off, 1 << (64 - HASH_BITS), CHUNK):
        h, words = W.word_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a], W.NOT_SPACE)
        at, doc = W.gram_starts(words, n)
        hashes, docs = [W.sequence_hash(h, at, n)], [doc]
        count = np.diff(words)
        for k in range(1, n):
            few = np.flatnonzero(count == k)
            hashes.append(W.sequence_hash(h, words[few], k, salt=1))
            docs.append(few)
        key = (np.concatenate(docs).astype(U64) << U64(HASH_BITS)) | (np.concatenate(hashes) >> U64(64 - HASH_BITS))
        key.sort()
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        yield a, b - a, (key >> U64(HASH_BITS)).astype(np.int64), key & U64((1 << HASH_BITS) - 1)


def set_ids(rows: int, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and identity hash of each set."""
    size = np.bincount(doc, minlength=rows)
    total = np.zeros(rows, dtype=U64)
    np.add.at(total, doc, W.mix(feature))
    return size, W.mix(total + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def sketch_level(size: np.ndarray) -> np.ndarray:
    """Sketches of level k have SHORT_BITS * 4 ** k bits."""
    return np.ceil(np.log2(np.maximum(size, SMALL) / SMALL) / 2).astype(np.int64)


def sketches(size: np.ndarray, doc: np.ndarray, feature: np.ndarray) -> pa.Array:
    """Packed parity sketch of each set; null for an empty one."""
    out = np.empty(len(size), dtype=object)
    level = np.where(size > 0, sketch_level(size), -1)
    h = W.mix(feature + U64(77))
    for k in np.unique(level[level >= 0]):
        rows = np.flatnonzero(level == k)
        bits = SHORT_BITS << (2 * int(k))
        place = np.full(len(size), -1, dtype=np.int64)
        place[rows] = np.arange(len(rows))
        mine = level[doc] == k
        slot = place[doc[mine]] * bits + (h[mine] & U64(bits - 1)).astype(np.int64)
        odd = (np.bincount(slot, minlength=len(rows) * bits) & 1).astype(np.uint8)
        for r, x in zip(rows, np.packbits(odd.reshape(len(rows), bits), axis=1)):
            out[r] = x.tobytes()
    return pa.array(out, pa.binary())


def folded(data: list[bytes], level: int) -> np.ndarray:
    """Sketches of this level or higher as words of this level's length."""
    size = (SHORT_BITS << (2 * level)) // 8
    fold = [x if len(x) == size else np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint8).reshape(-1, size)).tobytes() for x in data]
    return np.frombuffer(b"".join(fold), dtype=U64).reshape(len(data), -1)


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which the sketches of each pair differ, at the lower level of the two."""
    out = np.empty(len(x), dtype=np.int64)
    short = np.array([min(len(a), len(b)) for a, b in zip(x, y)], dtype=np.int64)
    for size in np.unique(short):
        idx = np.flatnonzero(short == size)
        level = (int(size * 8) // SHORT_BITS).bit_length() // 2
        for a in range(0, len(idx), 4096):
            i = idx[a : a + 4096]
            u, v = (folded([col[j] for j in i], level) for col in (x, y))
            out[i] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
    return out


def bands(num: int, den: int, upto: int) -> np.ndarray:
    """First size of each band, up to the band after the one that holds ``upto``."""
    first = [1]
    while len(first) < 3 or first[-3] <= upto:
        first.append(max(first[-1] + 1, first[-1] * den // num + 1))
    return np.array(first)


def signatures(size: np.ndarray, doc: np.ndarray, feature: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all PartEnum signatures of the sets."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first = bands(num, den, int(size.max()))
    rows = np.flatnonzero(size)
    own = np.searchsorted(first, size[rows], "right") - 1
    also = size[rows] * den // num >= first[own + 1]
    row = np.concatenate((rows, rows[also]))
    band = np.concatenate((own, own[also] + 1))
    most = first[band + 1] - 1
    differ = 2 * most * (den - num) // (den + num)
    spare = np.minimum(differ // 8, 3)
    group = np.maximum((differ + 2) // 2, 1) + spare  # K = 0 has one group, whose subsets all agree
    cell = np.cumsum(group * 3) - group * 3
    sums = np.zeros(int((group * 3).sum()), dtype=U64)
    begin = np.searchsorted(doc, row)
    count = size[row]
    total = int(count.sum())
    src = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    f = feature[src]
    seed = W.mix(band.astype(U64) + U64(1000))
    part = W.mix(f + np.repeat(seed, count)) >> U64(32)
    part = ((part * np.repeat((group * 3).astype(U64), count)) >> U64(32)).astype(np.int64)
    part += np.repeat(cell, count)
    np.add.at(sums, part, W.mix(f + U64(1)))
    parts = sums.reshape(-1, 3)
    held = np.bincount(part, minlength=len(sums)).reshape(-1, 3)
    who = np.repeat(np.arange(len(row)), group)
    number = np.arange(len(parts)) - np.repeat(np.cumsum(group) - group, group)
    base = W.mix(seed[who] + number.astype(U64) * U64(3))
    out = np.stack([
        W.mix(base + U64(i) + parts[:, (i + 1) % 3] * W.ORDER[1] + parts[:, (i + 2) % 3] * W.ORDER[2]) for i in range(3)
    ], axis=1)
    whole = differ[who] == 0  # one signature is enough there: that of the whole set
    out[whole] = W.mix(base[whole] + parts[whole].sum(axis=1, dtype=U64))[:, None]
    bare = np.stack([held[:, (i + 1) % 3] + held[:, (i + 2) % 3] == 0 for i in range(3)], axis=1)
    several = np.bincount(who, weights=bare.any(axis=1), minlength=len(row)) > spare
    keep = ~bare | several[who][:, None]
    keep[whole, 0], keep[whole, 1:] = True, False
    return np.repeat(row[who], 3)[keep.ravel()], out.ravel()[keep.ravel()]


def by_signature(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (signature, node) without repetition; whether a row is a signature's first."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    if not len(sig):
        return sig, node, np.zeros(0, dtype=bool)
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
    sig, node = sig[new], node[new]
    return sig, node, np.concatenate(([True], sig[1:] != sig[:-1]))


MEMBER = "sig long, node long, hub long"


def shingle_table(docs: DataFrame, n: int) -> DataFrame:
    """One row per row of docs: doc_id, text_key, size, node (null for an empty set), sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, off = W.utf8(batch.column(2))
            for a, rows, doc, feature in shingle_sets(buf, off, n):
                size, node = set_ids(rows, doc, feature)
                empty = size == 0
                sk = sketches(size, doc, feature)
                ids = pa.array(node.view(np.int64), mask=empty)
                yield pa.record_batch([batch.column(0).slice(a, rows), batch.column(1).slice(a, rows), pa.array(size), ids, sk], schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_arrow(rows, run, "doc_id long, text_key long, size long, node long, sketch binary")


def members(docs: DataFrame, n: int, num: int, den: int, shards: int) -> DataFrame:
    """Sets that share a signature with another: distinct (sig, node, hub); hub: a smaller node of the bucket.

    A set that recurs in several batches meets its local hub in each, so rows are made distinct after the shards: what
    identifies a bucket by its rows counts each once.
    """
    schema = pa.schema([("shard", pa.int32()), ("linked", pa.bool_()), ("data", pa.binary())])

    def emit(sig, node):
        # A signature is its shard and 32 bits inside it.
        shard = (sig >> U64(40)).astype(np.int64) % shards
        s, m, begin = by_signature((shard.astype(U64) << U64(32)) | (sig & U64(0xFFFFFFFF)), node)
        if not len(s):
            return
        at = np.flatnonzero(begin)
        hub = m[at[np.cumsum(begin) - 1]]
        for linked, sel in ((False, begin), (True, ~begin)):
            idx = np.flatnonzero(sel)
            of = (s[idx] >> U64(32)).astype(np.int64)
            cut = np.concatenate((np.flatnonzero(np.diff(of, prepend=-1)), [len(of)]))
            for a, b in zip(cut[:-1], cut[1:]):
                i = idx[a:b]
                low = s[i].astype(np.uint32).tobytes()
                yield int(of[a]), linked, (m[i].tobytes() + hub[i].tobytes() if linked else m[i].tobytes()) + low

    def packed(got):
        """Record batches of some blobs each, built one after the other."""
        rows = emit(*(np.concatenate(x) for x in zip(*got)))
        while some := list(islice(rows, 64)):
            yield pa.record_batch([pa.array(x) for x in zip(*some)], schema=schema)

    def signed(batches):
        got, held = [], 0
        for batch in batches:
            buf, off = W.utf8(batch.column(0))
            for _, rows, doc, feature in shingle_sets(buf, off, n):
                size, node = set_ids(rows, doc, feature)
                if rows > 1:  # copies inside a chunk
                    _, one = np.unique(node, return_index=True)
                    lone = np.zeros(rows, dtype=bool)
                    lone[one] = True
                    keep = lone[doc]
                    doc, feature = doc[keep], feature[keep]
                row, sig = signatures(np.bincount(doc, minlength=rows), doc, feature, num, den)
                got.append((sig, node[row]))
                held += len(sig)
                if held >= FLUSH:
                    yield from packed(got)
                    got, held = [], 0
        if got:
            yield from packed(got)

    def table(k, low, node, hub):
        sig = (np.int64(k) << np.int64(32)) | low.astype(np.int64)
        cols = [sig, node.view(np.int64), hub.view(np.int64)]
        for a in range(0, len(sig), 100_000):
            yield pa.record_batch([pa.array(c[a : a + 100_000]) for c in cols], names=["sig", "node", "hub"])

    def bucket(k, parts):
        if not parts:
            return
        s, m, begin = by_signature(*(np.concatenate(x) for x in zip(*parts)))
        at = np.flatnonzero(begin)
        hub = m[at[np.cumsum(begin) - 1]]
        i = np.flatnonzero(~begin)
        yield from table(k, s[i], m[i], hub[i])

    def shard(batches):
        """Rows come sorted by shard."""
        now, parts = None, []
        for batch in batches:
            for k, linked, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != now:
                    yield from bucket(now, parts)
                    now, parts = k, []
                data = data.as_buffer()  # of the batch, not a copy
                rows = data.size // (20 if linked else 12)
                node = np.frombuffer(data, dtype=U64, count=rows)
                low = np.frombuffer(data, dtype=np.uint32, offset=data.size - 4 * rows)
                if linked:
                    yield from table(k, low, node, np.frombuffer(data, dtype=U64, count=rows, offset=8 * rows))
                else:
                    parts.append((low, node))
        yield from bucket(now, parts)

    blobs = map_arrow(docs.select("text"), signed, "shard int, linked boolean, data binary")
    return map_arrow(blobs.repartition(shards, "shard").sortWithinPartitions("shard"), shard, MEMBER).distinct()


def allowed(s: np.ndarray, t: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most differing features of two sets of these sizes with similarity >= num / den; negative: none."""
    both = s + t
    least = (num * both + den + num - 1) // (den + num)  # of common features
    return np.where(least > np.minimum(s, t), -1, both - 2 * least)


def confirm(pairs: DataFrame, comp: DataFrame | None, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Adds the links among the distinct pairs (a, b) to the components(node, root).

    Sizes and sketches leave few pairs.  Of these each b is first counted against its closest a; after that only pairs
    that still lie between components are, so sets travel a few times each however many pairs a group has.
    """
    def sketch(batches):
        for batch in batches:
            s, t = (batch.column(i).to_numpy() for i in (2, 3))
            apart = differing(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ok = pa.array(apart <= allowed(s, t, num, den))
            yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(apart).filter(ok)], names=["a", "b", "d"])

    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("s"), F.col("sketch").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("t"), F.col("sketch").alias("y"))
    near = pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t", "x", "y")
    near = materialize(map_arrow(near, sketch, "a long, b long, d long"), "near")
    sets = materialize(sets_of(near.select(F.explode(F.array("a", "b")).alias("node")), docs, n), "sets")

    def count(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * common >= num * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([c.filter(ok) for c in batch.columns[:2]], names=["a", "b"])

    def counted(some: DataFrame) -> DataFrame:
        both = some.join(sets.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
        both = both.join(sets.select(F.col("node").alias("a"), F.col("data").alias("x")), "a").select("a", "b", "x", "y")
        return materialize(map_arrow(both, count, "a long, b long"), "links")

    first = near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("c")).select("c.a", "b")
    comp = extend_components(comp, counted(first))
    left = near.join(first, ["a", "b"], "left_anti")
    left = left.join(comp.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left")
    left = left.join(comp.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    left = materialize(left.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b"), "left")
    return comp if left.isEmpty() else extend_components(comp, counted(left))


def sets_of(want: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, data): the features of the wanted nodes, packed."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(want, "node"))

    def sets(batches):
        mask = np.frombuffer(wanted.value, dtype=U64)
        for batch in batches:
            buf, off = W.utf8(batch.column(0))
            for _, rows, doc, feature in shingle_sets(buf, off, n):
                size, node = set_ids(rows, doc, feature)
                node = node.view(np.int64)
                _, one = np.unique(node, return_index=True)
                hit = one[(size[one] > 0) & in_bitmap(mask, node[one])]
                begin = np.searchsorted(doc, np.arange(rows + 1))
                for a in range(0, len(hit), 256):
                    i = hit[a : a + 256]
                    data = pa.array([feature[begin[r] : begin[r + 1]].tobytes() for r in i], pa.binary())
                    yield pa.record_batch([pa.array(node[i]), data], names=["node", "data"])

    whole = map_arrow(docs.select("text"), sets, "node long, data binary")
    return whole.join(want.distinct(), "node", "left_semi").dropDuplicates(["node"])


def compare_blocks(open_members: DataFrame, num: int, den: int, closest: bool) -> DataFrame:
    """Pairs of different components inside one bucket that sizes and sketches allow; with ``closest`` only the pair
    with the least different sketches for every two components.

    open_members(sig, n, node, root, size, sketch).  Buckets over BLOCK sets are cut into blocks; each pair of
    blocks is one group of at most 2 * BLOCK rows.
    """
    cut = open_members.withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    cut = cut.select("sig", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "root", "size", "sketch")

    def pairs(tab: pa.Table):
        """All rows of some groups, sorted by group."""
        sig, p, q, mine, node, root, size = (tab.column(i).to_numpy() for i in range(7))
        data = tab.column(7).to_pylist()
        level = sketch_level(size)
        words, place = [], []
        for k in range(int(level.max()) + 1):  # sketches of this level or higher
            has = level >= k
            words.append(folded([data[r] for r in np.flatnonzero(has)], k))
            place.append(np.cumsum(has) - 1)

        def apart_at(u, v):
            """Differing bits of pairs, at the lower level of the two."""
            out = np.empty(len(u), dtype=np.int64)
            low = np.minimum(level[u], level[v])
            for k in np.unique(low):
                idx = np.flatnonzero(low == k)
                step = max(1, (1 << 21) // words[k].shape[1])
                for c in range(0, len(idx), step):
                    i = idx[c : c + step]
                    out[i] = np.bitwise_count(words[k][place[k][u[i]]] ^ words[k][place[k][v[i]]]).sum(axis=1, dtype=np.int64)
            return out

        rows = len(sig)
        ends = np.flatnonzero(np.concatenate(((sig[1:] != sig[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True]))) + 1
        count = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(rows) - 1
        total = np.concatenate(([0], np.cumsum(count)))
        a = 0
        while a < rows:  # rows whose pairs with later rows of the group are some 2 ** 17 at a time
            b = max(a + 1, int(np.searchsorted(total, total[a] + (1 << 17), "right")) - 1)
            u = np.repeat(np.arange(a, b), count[a:b])
            v = u + 1 + np.arange(len(u)) - np.repeat(total[a:b] - total[a], count[a:b])
            a = b
            most = allowed(size[u], size[v], num, den)
            ok = (most >= 0) & (root[u] != root[v]) & ((p[u] == q[u]) | (mine[u] != mine[v]))
            u, v, most = u[ok], v[ok], most[ok]
            apart = apart_at(u, v)
            ok = apart <= most
            u, v, apart = u[ok], v[ok], apart[ok]
            if closest and len(u):
                x, y = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
                order = np.lexsort((node[v], node[u], apart, y, x))
                new = np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])))
                u, v = u[order[new]], v[order[new]]
            x, y = node[u], node[v]
            if len(x):
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(new):  # the group goes on
                held.append(batch)
                continue
            held.append(batch.slice(0, new[-1]))
            yield from pairs(pa.Table.from_batches(held))
            held = [batch.slice(new[-1])]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    keys = ["sig", "p", "q"]
    return map_arrow(cut.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long").distinct()


def open_buckets(bucket: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components and a pair that no hub was part of, one bucket for each
    distinct group: (key, n, node, root)."""
    of = comp.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    seen = bucket.join(comp, "node", "left").join(of, "hub", "left")
    seen = seen.select("sig", "node", "hub", F.coalesce("root", "node").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root"))
    seen = materialize(seen, "seen")
    state = seen.groupBy("sig").agg(
        (F.count(F.lit(1)) + 1).alias("n"), F.max(F.col("root") != F.col("hub_root")).alias("apart"),
        F.bit_xor(F.xxhash64("node", "hub")).alias("who"), F.bit_xor(F.xxhash64("hub", "node")).alias("whom"),
    ).where("apart AND n > 2")
    state = state.groupBy("n", "who", "whom").agg(F.min("sig").alias("sig")).select("sig", "n")
    still = seen.join(state, "sig")
    rows = still.select("sig", "n", "node", "root").unionByName(still.select("sig", "n", F.col("hub").alias("node"), F.col("hub_root").alias("root")))
    return materialize(rows.distinct().withColumnRenamed("sig", "key"), "open")


def open_members(bucket: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """The open buckets as (sig, n, node, root, size, sketch)."""
    return open_buckets(bucket, comp).withColumnRenamed("key", "sig").join(nodes, "node")


def jaccard_components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_key, n_shingles, root, component_id, one row per input row.

    component_id: smallest doc_id reachable over pairs with den * |A & B| >= num * |A | B|; a document without
    words is alone; null ids are never smallest unless the component has no other.  Other columns are ignored.
    """
    nodes_all = materialize(shingle_table(docs, n), "shingles")
    total = nodes_all.agg(F.sum("size")).first()[0] or 0
    shards = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // SHARD_ROWS)
    known = nodes_all.where("node IS NOT NULL")
    bucket = materialize(members(docs, n, num, den, shards), "members")

    stars = bucket.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    touched = bitmap(bucket.select(F.explode(F.array("node", "hub")).alias("node")), "node")
    mask = docs.sparkSession.sparkContext.broadcast(touched)

    def some(batches):
        m = np.frombuffer(mask.value, dtype=U64)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(m, batch.column(0).to_numpy())))

    nodes = map_arrow(known.select("node", "size", "sketch"), some, "node long, size long, sketch binary")
    nodes = materialize(nodes.dropDuplicates(["node"]), "nodes")
    comp = confirm(stars, None, nodes, docs, n, num, den)
    for closest in (True, False):
        rows = united(open_buckets(bucket, comp)).withColumnRenamed("key", "sig").join(nodes, "node")
        pairs = compare_blocks(rows, num, den, closest).join(stars, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.isEmpty():
            comp = confirm(pairs, comp, nodes, docs, n, num, den)

    root = nodes_all.select("doc_id", "text_key", F.col("size").alias("n_shingles"), "node").join(comp, "node", "left")
    root = root.withColumn("root", F.coalesce("root", "node"))
    least = root.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = root.join(least, "root", "left")
    alone = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "text_key", "n_shingles", "root", alone.alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component (5-word shingles, similarity >= 0.8) stays, that with the
    smallest doc_id (null last), then text key.  Rows with one doc_id and equal text are one document; the row
    whose other columns sort first stays.  Documents without words stay.
    """
    cols = docs.columns
    found = materialize(jaccard_components(docs.select("doc_id", "text"), 5, 80, 100), "classes")
    each = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"), F.first("root").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("first")
    best = found.where("root IS NOT NULL").groupBy("root").agg(first)
    mine = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")
    # Only ids that go or that repeat are listed, so that texts of other rows stay in the tasks that read them.
    each = each.join(best, "root", "left").withColumn("drop", F.coalesce(mine != F.col("first"), F.lit(False)))
    each = each.where("drop OR rows > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("drop").alias("__drop"))
    each = materialize(each, "listed")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__key"))
    kept = docs.join(each, same, "left_anti").select(*cols)
    order = [x for c in cols for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    again = docs.join(each.where("NOT __drop"), same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("__key"))
    again = again.agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__row")).select("__row.*")
    return kept.unionByName(again)
