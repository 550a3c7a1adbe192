"""b-bit MinHash near-duplicates.

A document's set is its distinct word shingles (lower-cased A-Z; with fewer words the whole sequence as one).  Equal
sets are one node, a 64-bit hash of the set, so exact copies cost one node.

1. *Signatures.*  ``BANDS`` x ``ROWS`` minima over random permutations of the features.  Of each minimum ``BITS`` bits
   (of a hash of it) stay, packed as one plane of bits after the other; a band's full minima become one 64-bit key.
2. *Candidates.*  Sets with one band key form a bucket.  Every set is first paired with one hub, the smallest set in any
   of its buckets.
3. *Estimate.*  Minima of two sets agree with probability J; their low bits also agree by chance, with probability
   C = 2^-BITS.  So J is estimated as (m / K - C) / (1 - C), m being the K minima less the bits set in
   (x0 ^ y0) | (x1 ^ y1).  Pairs more than ``SIGMAS`` standard deviations under the threshold are dropped, and of the rest
   those whose parity sketches differ in more bits than similar sets have differing features (a bound that never errs).
4. *Confirmation* on the full sets; links give components.
5. *Open buckets.*  A bucket whose sets are in one component needs no more.  Of the others, one for each distinct group
   of sets remains; near sets share dozens of them, so alike buckets are made one where that means no more pairs
   (``united``).  Each is compared whole, in blocks of ``BLOCK`` x ``BLOCK`` sets inside a task: twice only the closest partner of
   each set in another component, over all its buckets, which joins nearly all that belongs together, then every pair
   between components.  So no candidate is capped, and a set is counted against three others unless near sets stay apart.

A pair at the threshold of 0.8 shares no band with a chance of (1 - 0.8^7)^64 = 3e-7, and its estimate falls short with
1e-9; nearer pairs are missed less.  That is the method's only loss.  The 64-bit ids make two of n different sets one
with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words as W
from faultline.llm.components import extend_components, united
from faultline.llm.partenum import allowed, folded, set_ids, shingle_sets, sketch_level, sketches
from faultline.llm.shared import bitmap, in_bitmap, map_arrow, materialize

U32, U64 = np.uint32, np.uint64
BANDS, ROWS, BITS = 64, 7, 2
K = BANDS * ROWS
SIGMAS = 6
BLOCK = 1024
SALTS = 16
#: Features whose minima are taken at once; they stay in the processor's cache.  One set may be larger.
STRIP = 1 << 16
#: The wanted-sets bitmap grows with their number up to 2^28 bits (32 MB); beyond it only lets more rows to the join.
MOST_BITS = 28

_SEED = W.mix(np.arange(1, 3 * K + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
XOR = _SEED[:K].astype(U32)
MUL = (_SEED[K : 2 * K] >> U64(32)).astype(U32) | U32(1)
LOW = (_SEED[2 * K :] >> U64(16)).astype(U32) | U32(1)


def minima(feature: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """K x sets minima; ``begin``: where each (non-empty) set starts among the features."""
    x = (W.mix(feature) >> U64(32)).astype(U32)
    out = np.empty((K, len(begin)), dtype=U32)
    ends = np.concatenate((begin, [len(x)]))
    for a, b in W.groups(ends, len(begin), STRIP):
        part = x[ends[a] : ends[b]]
        at = ends[a:b] - ends[a]
        h = np.empty_like(part)
        for k in range(K):
            np.bitwise_xor(part, XOR[k], out=h)
            np.multiply(h, MUL[k], out=h)
            out[k, a:b] = np.minimum.reduceat(h, at)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """sets x BANDS keys of the full minima."""
    m = mins.reshape(BANDS, ROWS, -1).astype(U64)
    total = np.arange(BANDS, dtype=U64)[:, None] * U64(0xA24BAED4963EE407)
    for r in range(ROWS):
        total = total + W.mix(m[:, r] + U64(1)) * W.ORDER[r]
    return np.ascontiguousarray(W.mix(total).T)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    """sets x (BITS * K / 8) bytes: plane after plane, one bit of each minimum's hash in every plane."""
    low = ((mins ^ XOR[:, None]) * LOW[:, None]) >> U32(32 - BITS)
    planes = [np.packbits(((low >> U32(b)) & U32(1)).astype(np.uint8).T, axis=1) for b in range(BITS)]
    return np.concatenate(planes, axis=1)


def as_planes(data: list[bytes]) -> np.ndarray:
    """rows x BITS x words."""
    return np.frombuffer(b"".join(data), dtype=U64).reshape(len(data), BITS, -1)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from two arrays of planes (broadcast against each other), corrected for chance agreement."""
    differ = np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=-2)).sum(axis=-1, dtype=np.int64)
    chance = 0.5**BITS
    return ((K - differ) / K - chance) / (1 - chance)


def least_estimate(num: int, den: int) -> float:
    """Estimates under this are taken for pairs under the threshold."""
    chance = 0.5**BITS
    p = chance + (1 - chance) * num / den
    return num / den - SIGMAS * (p * (1 - p) / K) ** 0.5 / (1 - chance)


def parity_distance(data: list[bytes], size: np.ndarray):
    """A function of two arrays of rows: in how many bits their parity sketches differ, at the shorter one's length."""
    level = sketch_level(size)
    words, place = [], []
    for k in range(int(level.max()) + 1 if len(level) else 0):  # sketches of this length or more
        has = level >= k
        words.append(folded([data[r] for r in np.flatnonzero(has)], k))
        place.append(np.cumsum(has) - 1)

    def apart(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(u), dtype=np.int64)
        low = np.minimum(level[u], level[v])
        for k in np.unique(low):
            idx = np.flatnonzero(low == k)
            step = max(1, (1 << 21) // words[k].shape[1])
            for c in range(0, len(idx), step):
                i = idx[c : c + step]
                out[i] = np.bitwise_count(words[k][place[k][u[i]]] ^ words[k][place[k][v[i]]]).sum(axis=1, dtype=np.int64)
        return out

    return apart


SIGNED = "doc_id long, size long, node long, bits binary, parity binary, bands array<bigint>"


def signed(docs: DataFrame, n: int) -> DataFrame:
    """One row per row of docs; bits and bands only for the first of equal sets in a piece of some megabytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("bits", pa.binary()), ("parity", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            buf, off = W.utf8(batch.column(1))
            for a, rows, doc, feature in shingle_sets(buf, off, n):
                size, node = set_ids(rows, doc, feature)
                _, one = np.unique(node, return_index=True)
                one = np.sort(one[size[one] > 0])
                first = np.zeros(rows, dtype=bool)
                first[one] = True
                mine = first[doc]
                bits, bands = np.empty(rows, dtype=object), [None] * rows
                parity = sketches(np.where(first, size, 0), doc[mine], feature[mine])
                if len(one):
                    begin = np.cumsum(size[one]) - size[one]
                    mins = minima(feature[mine], begin)
                    for r, x in zip(one, packed_bits(mins)):
                        bits[r] = x.tobytes()
                    keys = band_keys(mins).view(np.int64).ravel()
                    ends = np.concatenate(([0], np.cumsum(first))) * BANDS
                    bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~first, False)), pa.array(keys))
                yield pa.record_batch([
                    batch.column(0).slice(a, rows), pa.array(size), pa.array(node.view(np.int64), mask=size == 0),
                    pa.array(bits, pa.binary()), parity, bands if len(one) else pa.array(bands, pa.list_(pa.int64())),
                ], schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SIGNED)


def similar_sizes(s, t, num: int, den: int):
    """The smaller set has to hold num / den of the larger one."""
    return den * np.minimum(s, t) >= num * np.maximum(s, t)


def estimated(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs (a, b) those that sizes, packed bits and parity sketches allow: (a, b, est)."""
    least = least_estimate(num, den)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s, t = (batch.column(i).to_numpy() for i in (2, 3))
                est = estimate(*(as_planes(batch.column(i).to_pylist()) for i in (4, 5)))
                apart = parity_distance(batch.column(6).to_pylist() + batch.column(7).to_pylist(), np.concatenate((s, t)))
                row = np.arange(len(s))
                ok = pa.array(similar_sizes(s, t, num, den) & (est >= least) & (apart(row, row + len(s)) <= allowed(s, t, num, den)))
                yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(est).filter(ok)], names=["a", "b", "est"])

    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("s"), F.col("bits").alias("x"), F.col("parity").alias("u"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("t"), F.col("bits").alias("y"), F.col("parity").alias("v"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t", "x", "y", "u", "v")
    return map_arrow(rows, run, "a long, b long, est double")


def full_sets(docs: DataFrame, n: int, want: DataFrame) -> DataFrame:
    """(node, data): packed features of the wanted nodes, one row each."""
    count = want.count()
    bits = min(max(24, (16 * count).bit_length()), MOST_BITS)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(want, "node", bits))

    def run(batches):
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
                    data = [feature[begin[r] : begin[r + 1]].tobytes() for r in i]
                    yield pa.record_batch([pa.array(node[i]), pa.array(data, pa.binary())], names=["node", "data"])

    sets = map_arrow(docs.select("text"), run, "node long, data binary")
    return sets.join(want, "node", "left_semi").dropDuplicates(["node"])


def counted(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those with den * |A & B| >= num * |A | B|."""
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * common >= num * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([c.filter(ok) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("data").alias("x")), "a").select("a", "b", "x", "y")
    return materialize(map_arrow(both, run, "a long, b long"), "links")


def open_buckets(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, n, node, root) of buckets with sets in several components, one bucket for each distinct group of sets."""
    seen = materialize(members.join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "seen")
    state = seen.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.bit_xor(F.xxhash64("node")).alias("u"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("v"),
    ).where("lo < hi")
    state = state.groupBy("n", "u", "v").agg(F.min("key").alias("key")).select("key", "n")
    return materialize(seen.join(state, "key"), "open")


def nearest(x: np.ndarray, y: np.ndarray, est: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows (x, y), both ways round: the partner with the greatest estimate for each row."""
    x, y, est = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((est, est))
    order = np.lexsort((node[y], -est, x))
    first = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
    return x[first], y[first], est[first]


def best_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Of rows (x, y, est) the one with the greatest estimate for each x."""
    x, y, est = (pa.Table.from_batches(batches).column(i).to_numpy() for i in range(3))
    order = np.lexsort((y, -est, x))
    first = order[np.flatnonzero(np.concatenate(([True], x[order][1:] != x[order][:-1])))]
    return pa.record_batch([pa.array(x[first]), pa.array(y[first]), pa.array(est[first])], names=["x", "y", "est"])


def block_pairs(rows: DataFrame, num: int, den: int, closest: bool) -> DataFrame:
    """Distinct pairs (a, b) of different components inside one bucket that sizes, packed bits and parity sketches
    allow; with ``closest`` only each set's nearest one, over all its buckets."""
    least = least_estimate(num, den)
    cut = rows.withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    cut = cut.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "root", "size", "bits", "parity")

    def groups(tab: pa.Table):
        """Whole groups, sorted; some 2^17 pairs at a time."""
        key, p, q, mine, node, root, size = (tab.column(i).to_numpy() for i in range(7))
        planes = as_planes(tab.column(7).to_pylist())
        apart = parity_distance(tab.column(8).to_pylist(), size)
        total = len(key)
        ends = np.flatnonzero(np.concatenate(((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True]))) + 1
        later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(total) - 1  # rows of the group behind each
        upto = np.concatenate(([0], np.cumsum(later)))
        a = 0
        while a < total:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 17), "right")) - 1)
            x = np.repeat(np.arange(a, b), later[a:b])
            y = x + 1 + np.arange(len(x)) - np.repeat(upto[a:b] - upto[a], later[a:b])
            a = b
            ok = (root[x] != root[y]) & similar_sizes(size[x], size[y], num, den) & ((p[x] == q[x]) | (mine[x] != mine[y]))
            x, y = x[ok], y[ok]
            est = estimate(planes[x], planes[y])
            ok = est >= least
            x, y, est = x[ok], y[ok], est[ok]
            ok = apart(x, y) <= allowed(size[x], size[y], num, den)
            x, y, est = x[ok], y[ok], est[ok]
            if len(x):
                x, y, est = nearest(x, y, est, node) if closest else (x, y, est)
                yield pa.record_batch([pa.array(node[x]), pa.array(node[y]), pa.array(est)], names=["x", "y", "est"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if held and (key[0] != [held[-1].column(i)[-1].as_py() for i in range(3)]).any():
                new = np.concatenate(([0], new))
            if not len(new):  # the group goes on
                held.append(batch)
                continue
            yield from groups(pa.Table.from_batches([*held, batch.slice(0, new[-1])]))
            held = [batch.slice(new[-1])]
        if held:
            yield from groups(pa.Table.from_batches(held))

    def one_each(batches):
        """Of all pairs of a task the nearest for each set, so a set leaves it once however many buckets it has there."""
        got, rows = [], 0
        for batch in run(batches):
            got.append(batch)
            rows += batch.num_rows
            if rows >= 400_000:
                got = [best_of(got)]
                rows = got[0].num_rows
                if rows >= 200_000:
                    yield got[0]
                    got, rows = [], 0
        if got:
            yield best_of(got)

    keys = ["key", "p", "q"]
    dealt = cut.repartition(*keys).sortWithinPartitions(*keys)
    pairs = map_arrow(dealt, one_each if closest else run, "x long, y long, est double")
    if closest:
        pairs = pairs.groupBy("x").agg(F.max_by("y", F.struct("est", "y")).alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 2, num: int = 80, den: int = 100) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per row.

    component_id: smallest doc_id reachable over pairs with den * |A & B| >= num * |A | B|.  Null and empty texts, and
    those without words, are linked with nothing.  A null id is never the smallest unless its component has no other;
    its row is kept then only.  Repeated rows are copies of each other and get equal results.  An empty table gives an
    empty result; other columns are ignored.
    """
    rows = materialize(signed(docs, n), "signed")
    one = rows.where("bands IS NOT NULL")
    keyed = one.select(F.explode("bands").alias("key"), "node")
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    members = materialize(keyed.join(buckets.select("key", "hub"), "key").distinct(), "members")
    touched = materialize(members.select("node").distinct(), "touched")  # hubs are members, too
    nodes = materialize(one.select("node", "size", "bits", "parity").join(touched, "node", "left_semi").dropDuplicates(["node"]), "nodes")

    first = members.where("hub < node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    near = materialize(estimated(first, nodes, num, den), "near").select("a", "b")
    sets = materialize(full_sets(docs, n, touched), "sets")
    comp, done = extend_components(None, counted(near, sets, num, den)), near
    for closest in (True, True, False):
        still = united(open_buckets(members.select("key", "node"), comp))
        pairs = block_pairs(still.join(nodes, "node"), num, den, closest)
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            comp = extend_components(comp, counted(pairs, sets, num, den))
            done = done.unionByName(pairs)

    each = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = materialize(each.join(comp, "node", "left"), "rooted")
    best = materialize(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("best")), "best")
    # A component may hold a third of all sets: its row is met by SALTS groups of them.
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    named = rooted.withColumn("salt", salt).join(best, ["root", "salt"], "left")
    named = materialize(named.select("node", F.coalesce("best", "least").alias("component")), "named")
    out = rows.select("doc_id", F.col("size").alias("n_shingles"), "node").join(named, "node", "left")
    comp_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.col("doc_id").eqNullSafe(comp_id).alias("kept"))
