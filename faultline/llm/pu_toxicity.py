"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; the unlabelled sample is drawn from all texts, whatever their label.  With class
prior p and logistic loss l, a linear classifier f on word presence minimises

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])

When the second term falls below zero its gradient is reversed, so flexible features cannot drive it down.  ``MEMBERS``
classifiers, each fitted on a different ``(MEMBERS - 1) / MEMBERS`` of both samples, are averaged.

Bounds (documented parameters, the same at every size): ``POSITIVES`` and ``UNLABELLED`` sampled rows, those with the
smallest hash of the id (repeated rows count once), and ``FEATURES`` words.  Words are runs of letters and digits (A-Z lower-cased), known by
their 64-bit hash.  A word is a candidate if at least ``MIN_POSITIVES`` sampled positives hold it and the lower bound
(``Z`` standard errors) of the ratio of its rates in positives and unlabelled texts is over ``MIN_RATIO``; those with the
largest bounds stay.
Scoring covers every word of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words as W
from faultline.llm.shared import crc_mod, map_arrow, materialize, table

U64 = np.uint64
POSITIVES = 6_000
UNLABELLED = 24_000
FEATURES = 1_024
MIN_POSITIVES = 5
Z = 2.5
MIN_RATIO = 2.0
MEMBERS = 3
STEPS = 800
RATE = 0.1
L2 = 1e-5
THRESHOLD = 0.7


def _distinct_words(col: pa.Array, size: int = 1 << 22):
    """(first row, rows, row of each distinct word of a text, hash)."""
    buf, off = W.utf8(col)
    for a, b in W.groups(off, 4096, size):
        h, words = W.word_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a], W.ALNUM)
        row = np.repeat(np.arange(b - a), np.diff(words))
        yield a, b - a, row, h


def sample(docs: DataFrame, rows: int, salt: str, among: DataFrame | None = None) -> DataFrame:
    """Of docs(doc_id, text) the ``rows`` distinct (id, text) with the smallest hashes of the id: (text, fold); with
    ``among`` (doc_id) only of these ids.  They are chosen on ids and text hashes; texts stay in their tasks but for the
    chosen ones, which a bounded broadcast names."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("__h")).distinct()
    if among is not None:
        narrow = narrow.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = narrow.orderBy(F.xxhash64(F.col("doc_id"), F.lit(salt)), "doc_id", "__h").limit(rows)
    picked = picked.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__key"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    text = docs.where("text IS NOT NULL").join(F.broadcast(picked), same, "left_semi").dropDuplicates(["text"])
    return text.select("text", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(MEMBERS)).cast("int").alias("fold"))


def sampled_words(texts: DataFrame) -> DataFrame:
    """One row per sampled text and distinct word: kind, fold, text id, word."""

    def run(batches):
        for batch in batches:
            for a, rows, row, h in _distinct_words(batch.column(3)):
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
                d = pa.array(row[new] + a)
                yield pa.record_batch([batch.column(i).take(d) for i in range(3)] + [pa.array(h[new].view(np.int64))], names=["kind", "fold", "text_id", "word"])

    rows = texts.select("kind", "fold", F.xxhash64("text").alias("text_id"), "text")
    return map_arrow(rows, run, "kind int, fold int, text_id long, word long")


def _loss_gradient(z: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """l(sign * z) and its derivative by z."""
    m = sign * z
    return np.logaddexp(0, -m), -sign / (1 + np.exp(np.clip(m, -500, 500)))


def packed(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers of all texts, the text of each, how many texts."""
    row = np.repeat(np.arange(len(x)), [len(i) for i in x])
    return (np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64)), row, len(x)


def risk(w: np.ndarray, pos, unl, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk's two terms, p E_P[l(f)] and E_U[l(-f)] - p E_P[l(-f)], for packed samples, and the gradient to follow:
    of their sum, or, where the second is negative, of its opposite."""
    (ip, rp, np_), (iu, ru, nu) = pos, unl
    features = len(w) - 1
    zp = np.bincount(rp, weights=w[ip], minlength=np_) + w[-1]
    zu = np.bincount(ru, weights=w[iu], minlength=nu) + w[-1]
    lp, gp = _loss_gradient(zp, 1)
    ln, gn = _loss_gradient(zp, -1)
    lu, gu = _loss_gradient(zu, -1)
    negative = lu.mean() - prior * ln.mean()
    dp, du = (prior * (gp - gn), gu) if negative >= 0 else (prior * gn, -gu)
    g = np.zeros_like(w)
    g[:-1] = np.bincount(ip, weights=dp[rp], minlength=features) / np_ + np.bincount(iu, weights=du[ru], minlength=features) / nu
    g[-1] = dp.mean() + du.mean()
    return prior * lp.mean(), negative, g


def fit_one(x_p: list[np.ndarray], x_u: list[np.ndarray], features: int, prior: float) -> np.ndarray:
    """x: feature numbers of each text.  Returns the weights, the intercept last."""
    pos, unl = packed(x_p), packed(x_u)
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        _, _, g = risk(w, pos, unl, prior)
        g[:-1] += L2 * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(train: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """train(doc_id, text), labels(doc_id, toxic) -> sorted word hashes and weights [member, word + intercept].

    The class prior is the share of toxic rows among the labelled training rows.  Without positives the model is the
    prior alone (0.5 without labels).
    """
    known = train.select("doc_id").join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic").distinct(), "doc_id")
    share = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(max((share[1] or 0) / share[0], 1e-4), 1 - 1e-4) if share[0] else 0.5
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    pos = sample(train, POSITIVES, "p", toxic).withColumn("kind", F.lit(1))
    unl = sample(train, UNLABELLED, "u").withColumn("kind", F.lit(0))
    both = materialize(pos.unionByName(unl), "sample")
    sizes = {r["kind"]: r["n"] for r in both.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return np.zeros(0, U64), np.full((1, 1), np.log(prior / (1 - prior)))
    words = sampled_words(both)
    count = words.groupBy("word").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u"))
    p, u = (F.col("p") + 0.5) / n_p, (F.col("u") + 0.5) / n_u
    low = F.log(p / u) - Z * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    best = count.where((F.col("p") >= MIN_POSITIVES) & (low > F.log(F.lit(MIN_RATIO)))).orderBy(low.desc(), "word").select("word").limit(FEATURES)
    rows = words.join(F.broadcast(best), "word").groupBy("kind", "fold", "text_id").agg(F.sort_array(F.collect_list("word")).alias("words"))
    # All texts of the samples count, also those without a chosen word.
    rows = both.select("kind", "fold", F.xxhash64("text").alias("text_id")).join(rows, ["kind", "fold", "text_id"], "left").toArrow()
    hashes = np.sort(np.array([r["word"] for r in best.collect()], dtype=np.int64).view(U64))
    kind, fold = rows["kind"].to_numpy(), rows["fold"].to_numpy()
    found = [np.searchsorted(hashes, np.array(x or [], dtype=np.int64).view(U64)) for x in rows["words"].to_pylist()]
    members = []
    for k in range(MEMBERS):
        pick = [[found[i] for i in np.flatnonzero((kind == c) & (fold != k))] for c in (1, 0)]
        if pick[0] and pick[1]:
            members.append(fit_one(pick[0], pick[1], len(hashes), prior))
    return hashes, np.stack(members) if members else np.pad(np.full((1, 1), np.log(prior / (1 - prior))), ((0, 0), (len(hashes), 0)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep_text: bool = False) -> DataFrame:
    """docs(..., text) -> its other columns (with ``keep_text`` all) and, last, score (0 to 1; ``toxic_score`` and so on
    if docs has that column).  Null texts score as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES * (MEMBERS + 1) numbers at most
    cols = [c for c in docs.columns if keep_text or c != "text"]
    name = "score"
    while name in cols:
        name = f"toxic_{name}"

    def run(batches):
        hashes, weights = shared.value
        for batch in batches:
            rest = batch.select(cols)
            for a, rows, row, h in _distinct_words(batch.column(batch.schema.get_field_index("text"))):
                out = np.zeros(rows)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = hashes[at] == h
                    key = np.unique(row[hit] * len(hashes) + at[hit])
                    row, at = key // len(hashes), key % len(hashes)
                for w in weights:
                    z = (np.bincount(row, weights=w[at], minlength=rows) if len(hashes) else out) + w[-1]
                    out = out + 1 / (1 + np.exp(-np.clip(z, -500, 500))) / len(weights) if len(hashes) else 1 / (1 + np.exp(-z))
                yield pa.record_batch(rest.slice(a, rows).columns + [pa.array(out)], names=cols + [name])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    return map_arrow(docs, run, f"{kinds}{name} double")


def held_out(col: str = "doc_id"):
    return crc_mod(col, 3) == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_key, held_out, score, predicted; other columns are ignored, repeated rows and
    ids are scored each, an empty table gives an empty result.  Rows with crc32(doc_id) mod 3 = 1 are held
    out: neither their labels nor their texts reach the fit."""
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out())
    model = fit(rows.where("NOT held_out").select("doc_id", "text"), labels.where(~held_out()))
    out = score(rows.select("doc_id", F.xxhash64("text").alias("text_key"), "held_out", "text"), model)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier calls toxic go; all others stay."""
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out())
    model = fit(rows.where("NOT held_out").select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, model, keep_text=True)
    return out.where(F.col(out.columns[-1]) < THRESHOLD).select(*docs.columns)
