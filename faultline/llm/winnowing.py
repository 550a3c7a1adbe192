"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.  A window is ``WINDOW`` consecutive
words of a benchmark item (an item with fewer is one window).  Of the hashes of all K-word grams, each sliding
window of ``WINDOW - K + 1`` grams keeps the smallest (the rightmost of equals).  The choice depends on the window's
words alone, so a window that occurs in a document has the same gram kept at the same place in both: joining the
kept grams finds every shared span of ``WINDOW`` words or more.  A joined gram is extended word by word on both
sides as far as one window reaches; if the run is ``WINDOW`` words or longer, its words are hit.  Items with fewer
words join with every gram of their length.

Documents send only grams that pass a bit set of the benchmark's kept grams (2 MB whatever the benchmark's size) to
the exact join, so nothing is broadcast that grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words as W
from faultline.llm.shared import bitmap, in_bitmap, map_arrow, materialize, table

U64 = np.uint64
WINDOW = 10
K = 5
SIDE = WINDOW - K


def kept_grams(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, text) of the grams that winnowing keeps."""
    start, doc = W.gram_starts(words, WINDOW)
    if not len(start):
        return np.zeros(0, U64), start, doc
    gram = W.sequence_hash(h, np.arange(len(h) - K + 1), K)
    at = start + SIDE
    best = gram[at]
    for j in range(SIDE - 1, -1, -1):
        other = gram[start + j]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, start + j, at)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    return best[new], at[new], doc[new]


def context(h: np.ndarray, words: np.ndarray, at: np.ndarray, doc: np.ndarray, outside: int) -> np.ndarray:
    """Word hashes from SIDE before to SIDE behind each gram; ``outside`` stands for places beyond the text."""
    place = at[:, None] + np.arange(-SIDE, K + SIDE)[None, :]
    inside = (place >= words[doc][:, None]) & (place < words[doc + 1][:, None])
    return np.where(inside, h[np.clip(place, 0, len(h) - 1)], U64(outside))


def _grams(buf, off, outside, lengths, mask):
    """Per chunk of rows: first row, word counts, and columns (fp, size, pos, row, ctx) of the kept grams."""
    for a, b in W.groups(off, 4096, 1 << 22):
        h, words = W.word_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a], W.ALNUM)
        fp, at, doc = kept_grams(h, words)
        if mask is not None:
            ok = in_bitmap(mask, fp)
            fp, at, doc = fp[ok], at[ok], doc[ok]
        rows = [(fp, np.full(len(fp), WINDOW), at - words[doc], doc, [x.tobytes() for x in context(h, words, at, doc, outside)] if len(fp) else [])]
        for n in lengths:
            if n is None:  # every item as a whole, if it has fewer words than a window
                few = np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < WINDOW))
                for k in np.unique(np.diff(words)[few]):
                    d = few[np.diff(words)[few] == k]
                    rows.append((W.sequence_hash(h, words[d], int(k), salt=2), np.full(len(d), k), np.zeros(len(d), np.int64), d, [b""] * len(d)))
                continue
            at, doc = W.gram_starts(words, n)
            fp = W.sequence_hash(h, at, n, salt=2)
            if mask is not None:
                ok = in_bitmap(mask, fp)
                fp, at, doc = fp[ok], at[ok], doc[ok]
            rows.append((fp, np.full(len(fp), n), at - words[doc], doc, [b""] * len(fp)))
        yield a, np.diff(words), rows


def benchmark_grams(items: DataFrame) -> DataFrame:
    """(fp, size, item, ctx) of the items; size: WINDOW for a kept gram, else the item's number of words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            buf, off = W.utf8(batch.column(1))
            for a, _, rows in _grams(buf, off, 2, [None], None):
                for fp, size, _, doc, ctx in rows:
                    yield pa.record_batch([pa.array(fp.view(np.int64)), pa.array(size.astype(np.int32)), ids.take(pa.array(doc + a)), pa.array(ctx, pa.binary())], names=["fp", "size", "item", "ctx"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return map_arrow(rows, run, "fp long, size int, item string, ctx binary").distinct()


def document_grams(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """One row per document (pos -1, n_words) and one per gram that may occur in the benchmark (fp, size, pos, ctx)."""
    mask = docs.sparkSession.sparkContext.broadcast(bitmap(grams, "fp"))
    lengths = sorted(r["size"] for r in grams.select("size").where(f"size < {WINDOW}").distinct().collect())  # 9 at most

    def run(batches):
        bits = np.frombuffer(mask.value, dtype=U64)
        names = ["doc_id", "text_key", "n_words", "fp", "size", "pos", "ctx"]
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            buf, off = W.utf8(batch.column(2))
            for a, count, rows in _grams(buf, off, 1, lengths, bits):
                n = len(count)
                none = pa.nulls(n, pa.int64())
                yield pa.record_batch([ids.slice(a, n), keys.slice(a, n), pa.array(count), none, pa.nulls(n, pa.int32()), pa.array(np.full(n, -1)), pa.nulls(n, pa.binary())], names=names)
                for fp, size, pos, doc, ctx in rows:
                    for s in range(0, len(fp), 20_000):
                        e = slice(s, s + 20_000)
                        d = pa.array(doc[e] + a)
                        yield pa.record_batch([ids.take(d), keys.take(d), pa.nulls(len(d), pa.int64()), pa.array(fp[e].view(np.int64)), pa.array(size[e].astype(np.int32)), pa.array(pos[e]), pa.array(ctx[e], pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_arrow(rows, run, "doc_id long, text_key long, n_words long, fp long, size int, pos long, ctx binary")


def _extend(batches):
    """Joined grams -> runs of matching words that hold a window."""
    for batch in batches:
        size = batch.column(2).to_numpy().astype(np.int64)
        pos = batch.column(3).to_numpy()
        first, last, ok = pos.copy(), pos + size, np.ones(len(pos), dtype=bool)
        full = np.flatnonzero(size == WINDOW)
        if len(full):
            take = pa.array(full)
            x, y = (np.frombuffer(b"".join(batch.column(i).take(take).to_pylist()), dtype=U64).reshape(len(full), -1) for i in (4, 5))
            same = x == y
            left = np.cumprod(same[:, SIDE - 1 :: -1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, SIDE + K :], axis=1).sum(axis=1)
            ok[full] = same[:, SIDE : SIDE + K].all(axis=1) & (left + K + right >= WINDOW)
            first[full], last[full] = pos[full] - left, pos[full] + K + right
        keep = pa.array(ok)
        cols = [batch.column(0), batch.column(1), batch.column(6), pa.array(first), pa.array(last)]
        yield pa.record_batch([c.filter(keep) for c in cols], names=["doc_id", "text_key", "item", "first", "last"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> one row per document: doc_id, text_key, n_words, n_hit, n_items,
    items_sha256, contaminated.

    Null texts have no words; a null item_id counts as ''; repeated items count once; repeated documents keep a
    row each.  Both sides of the join may hold hot grams (a passage in many documents): the join is left to AQE's
    broadcast by measured size and its split of skewed partitions.
    """
    grams = materialize(benchmark_grams(items), "grams")
    found = materialize(document_grams(docs, grams), "hits")
    hits = found.where("pos >= 0").select("doc_id", "text_key", "fp", "size", "pos", F.col("ctx").alias("x"))
    joined = hits.join(grams.withColumnRenamed("ctx", "y"), ["fp", "size"])
    runs = joined.select("doc_id", "text_key", "size", "pos", "x", "y", "item")
    runs = materialize(map_arrow(runs, _extend, "doc_id long, text_key long, item string, first long, last long"), "runs")
    keys = ["doc_id", "text_key"]
    spans = runs.select(*keys, "first", "last").distinct()
    hit = spans.select(*keys, F.explode(F.sequence("first", F.col("last") - 1)).alias("pos")).distinct()
    hit = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"))
    of = runs.select(*keys, "item").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = hit.join(of.toDF("i", "k", "items"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))
    both = both.select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "n_hit", "items")
    head = found.where("pos < 0").select(*keys, "n_words")
    out = head.join(both, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    return out.select(
        *keys, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a window of a benchmark item go; all others stay."""
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select("doc_id", "text_key").distinct().toDF("__id", "__key")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(bad, same, "left_anti")
