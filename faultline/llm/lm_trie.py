"""Bigram language model in sharded Elias-Fano tries, built and queried by Spark tasks.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end token per text, which is also the context of
the first token.  Training counts every token and every pair of all training texts, and every pair is stored, so a
passage of one training text is known, too.

* ``P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))``; an unknown word has c = 0.
* ``P(w | h) = max(c(h, w) - D, 0) / c(h) + b(h) P(w)`` for a stored pair, ``b(h) P(w)`` for another pair of a known
  context, ``P(w)`` after an unknown word; ``b(h) = 1 - sum over stored w of (c(h, w) - D) / c(h)``.

A shard holds the words whose hash falls into its range, in hash order, so a word's id is the shard's first id plus
its rank.  Levels of a shard, all plain arrays in one file that tasks map into memory (pages load as they are read):

1. ``words``: Elias-Fano sequence of the word hashes; codes of the exact counts and of the backoff weights.
2. ``pointers``: Elias-Fano sequence of where each word's successors begin.
3. ``pairs``: Elias-Fano sequence of the successors, made monotone by their context: ``rank(h) * V + id(w)``, found
   by successor search; codes of the discounted probabilities.

Probabilities and weights are quantised to ``CODES`` equal steps of their log10 in one shard's range.

The files lie in the shared checkpoint folder, which has to be a mounted path (``file:``) so that it can be mapped.
A retried task writes the same file again under a temporary name and renames it.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words as W
from faultline.llm.elias_fano import EliasFano, encode
from faultline.llm.shared import map_arrow, materialize, shared_path

U64 = np.uint64
#: Least count of a stored pair: all.
MIN_PAIR = 1
DISCOUNT = 0.75
CODES = 65535
#: Hash of the end token.
END = U64(0x6C62272E07BB0142)
#: Distinct words (and stored pairs, about) of one shard, and pairs counted by one task.
SHARD_WORDS = 2_000_000
TASK_PAIRS = 2_000_000


def local_folder(path: str) -> str:
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder to map the model into memory, not {path}")
    return unquote(u.path) if u.scheme else path


# --- files ---------------------------------------------------------------------------------------------
def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: length of the header, header (name, dtype, length, offset), arrays at multiples of 64 bytes."""
    at, index = 0, {}
    for name, x in arrays.items():
        index[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(index).encode()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{os.getpid()}.{id(arrays)}.tmp"
    with open(tmp, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.write(b"\0" * (-f.tell() % 64))
        base = f.tell()
        for name, x in arrays.items():
            f.seek(base + index[name][2])
            f.write(x.tobytes())
        f.truncate(base + at)
    os.replace(tmp, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, dtype=np.uint8, mode="r")
    n = int.from_bytes(data[:8].tobytes(), "little")
    index = json.loads(data[8 : 8 + n].tobytes())
    base = -(-(8 + n) // 64) * 64
    return {k: data[base + at : base + at + np.dtype(t).itemsize * size].view(t) for k, (t, size, at) in index.items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(name + ".")})


def named(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in parts.items()}


@lru_cache(maxsize=256)
def open_words(folder: str, shard: int):
    a = map_arrays(f"{folder}/words-{shard}")
    return sequence(a, "words"), a["counts"], a["count_of"]


@lru_cache(maxsize=256)
def open_pairs(folder: str, shard: int):
    a = map_arrays(f"{folder}/pairs-{shard}")
    return sequence(a, "pairs"), sequence(a, "pointers"), a["prob"], a["backoff"], a["range"]


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Codes of log10 values in equal steps of their range."""
    lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (hi - lo) / CODES if hi > lo else 1.0
    return np.round((x - lo) / step).astype(np.uint16), lo, step


# --- counting --------------------------------------------------------------------------------------------
def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the end token behind each text, and n + 1 offsets."""
    h, words = W.word_hashes(buf, off, W.NOT_SPACE)
    count = np.diff(words)
    ends = np.cumsum(count + 1) - 1
    out = np.empty(len(h) + len(count), dtype=U64)
    here = np.ones(len(out), dtype=bool)
    here[ends] = False
    out[here] = h
    out[ends] = END
    return out, np.concatenate(([0], ends + 1))


def _chunks(col: pa.Array):
    buf, off = W.utf8(col)
    for a, b in W.groups(off, 4096, 1 << 22):
        yield a, tokens(buf[off[a] : off[b]], off[a : b + 1] - off[a])


def add_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by key, sorted by key."""
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def pack(key: np.ndarray, n: np.ndarray) -> bytes:
    """Keys and counts: most counts are 1, so only the others are written out."""
    more = n > 1
    head = np.array([len(key), int(more.sum())], dtype=U64)
    return b"".join(x.tobytes() for x in (head, key[~more], key[more], n[more].astype(U64)))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, dtype=U64)
    total, more = int(x[0]), int(x[1])
    key, n = x[2 : 2 + total], np.ones(total, dtype=np.int64)
    n[total - more :] = x[2 + total :].astype(np.int64)
    return key, n


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hash."""
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def first_hash(shard: int, shards: int) -> int:
    return -(-(shard << 32) // shards) << 32


def _blobs(key, n, part, parts):
    order = np.argsort(part, kind="stable")
    key, n = key[order], n[order]
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for k in range(parts):
        if cut[k] < cut[k + 1]:
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack(key[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]])], pa.binary())], names=["part", "data"])


def _by_part(batches):
    """Rows sorted by part -> (part, list of (key, count))."""
    now, held = None, []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(unpack(data))
    if held:
        yield now, held


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part")


def count_words(train: DataFrame, parts: int) -> DataFrame:
    """part, n, total, data: the words of a hash range and their counts over all training texts."""

    def count(batches):
        for batch in batches:
            got = [add_counts([(t, np.ones(len(t), np.int64))]) for _, (t, _) in _chunks(batch.column(0))]
            key, n = add_counts(got)
            yield from _blobs(key, n, shard_of(key, parts), parts)

    def merge(batches):
        for k, held in _by_part(batches):
            key, n = add_counts(held)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([len(key)]), pa.array([int(n.sum())]), pa.array([pack_plain(key, n)], pa.binary())], names=["part", "n", "total", "data"])

    return map_arrow(_dealt(map_arrow(train.select("text"), count, "part int, data binary"), parts), merge, "part int, n long, total long, data binary")


def pack_plain(key: np.ndarray, n: np.ndarray) -> bytes:
    return key.tobytes() + n.astype(U64).tobytes()


class Model:
    """Where the levels are, and the totals.  Small: one number a shard."""

    def __init__(self, folder: str, firsts: list[int], total: int):
        self.folder, self.firsts, self.total = folder, np.array(firsts, dtype=np.int64), total
        self.shards, self.words = len(firsts) - 1, int(firsts[-1])

    def denominator(self) -> float:
        return self.total + 0.5 * (self.words + 1)

    def find_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """h sorted -> ids (-1: unknown) and counts."""
        ids, n = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        shard = shard_of(h, self.shards)
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for k in range(self.shards):
            a, b = cut[k], cut[k + 1]
            if a < b and self.firsts[k] < self.firsts[k + 1]:
                seq, codes, count_of = open_words(self.folder, k)
                at = seq.find(h[a:b] - U64(first_hash(k, self.shards)))
                ok = np.flatnonzero(at >= 0)
                ids[a + ok] = at[ok] + self.firsts[k]
                n[a + ok] = count_of[codes[at[ok]]]
        return ids, n

    def find_pairs(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids sorted by context -> discounted probability (0: not stored) and backoff weight (1: unknown)."""
        prob, back = np.zeros(len(ctx)), np.ones(len(ctx))
        cut = np.searchsorted(ctx, self.firsts)
        for k in range(self.shards):
            a, b = cut[k], cut[k + 1]
            if a < b:
                seq, pointers, codes, backoff, rng = open_pairs(self.folder, k)
                rank = ctx[a:b] - self.firsts[k]
                back[a:b] = 10.0 ** (rng[2] + rng[3] * backoff[rank])
                some = np.flatnonzero((word[a:b] >= 0))
                some = some[pointers.access(rank[some] + 1) > pointers.access(rank[some])]
                at = seq.find(rank[some].astype(U64) * U64(self.words) + word[a:b][some].astype(U64))
                ok = at >= 0
                prob[a + some[ok]] = 10.0 ** (rng[0] + rng[1] * codes[at[ok]])
        return prob, back


def write_words(vocab: DataFrame, folder: str, firsts: list[int]) -> int:
    shards = len(firsts) - 1

    def write(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data, dtype=U64).reshape(2, -1)
                count_of, codes = np.unique(x[1].astype(np.int64), return_inverse=True)
                base = first_hash(k, shards)
                codes = codes.astype(np.uint16 if len(count_of) < 65536 else np.uint32)
                seq = encode(x[0] - U64(base), first_hash(k + 1, shards) - base)
                write_arrays(f"{folder}/words-{k}", named("words", seq) | {"counts": codes, "count_of": count_of})
                yield pa.record_batch([pa.array([k], pa.int32())], names=["part"])

    return map_arrow(vocab.select("part", "data"), write, "part int").count()


def pair_ids(model: Model, t: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the tokens and of their contexts, and counts of the tokens."""
    distinct, back = np.unique(t, return_inverse=True)
    ids, n = model.find_words(distinct)
    ids, n = ids[back], n[back]
    end = ids[off[1] - 1] if len(off) > 1 else -1  # the id of the end token
    ctx = np.concatenate((ids[:1], ids[:-1]))
    ctx[off[:-1]] = end
    return ids, ctx, n


def write_pairs(train: DataFrame, vocab: DataFrame, model: Model, tasks: int) -> int:
    """Counts all pairs and writes the pair levels.  Keys: context id << 32 | word id,
    so a model holds less than 2 ** 32 distinct words."""
    if model.words >= 1 << 32:
        raise ValueError("more than 2 ** 32 distinct words")
    folder, shards, firsts = model.folder, model.shards, model.firsts

    def count(batches):
        for batch in batches:
            got = []
            for _, (t, off) in _chunks(batch.column(0)):
                ids, ctx, _ = pair_ids(model, t, off)
                got.append(add_counts([((ctx.astype(U64) << U64(32)) | ids.astype(U64), np.ones(len(t), np.int64))]))
            key, n = add_counts(got)
            yield from _blobs(key, n, (W.mix(key) >> U64(20)).astype(np.int64) % tasks, tasks)

    def keep(batches):
        for _, held in _by_part(batches):
            key, n = add_counts(held)
            shard = np.searchsorted(firsts, (key >> U64(32)).astype(np.int64), "right") - 1
            yield from _blobs(key, n, shard, shards)

    kept = map_arrow(_dealt(map_arrow(train.select("text"), count, "part int, data binary"), tasks), keep, "part int, data binary")
    # The shard's own words come first in it.
    own = vocab.select("part", F.lit(0).alias("no"), "data")
    rows = kept.select("part", F.lit(1).alias("no"), "data").unionByName(own)
    rows = rows.repartition(shards, "part").sortWithinPartitions("part", "no")

    def level(k, counts, held):
        key, n = add_counts(held)
        rank = ((key >> U64(32)).astype(np.int64) - firsts[k])
        ratio = (n - DISCOUNT) / counts[rank]
        weight = 1.0 - np.bincount(rank, weights=ratio, minlength=len(counts))
        many = np.bincount(rank, minlength=len(counts))
        prob, p0, p1 = quantise(np.log10(ratio))
        backoff, b0, b1 = quantise(np.log10(np.maximum(weight, 1e-12)))
        value = rank.astype(U64) * U64(model.words) + (key & U64(0xFFFFFFFF))
        ends = np.concatenate(([0], np.cumsum(many)))
        write_arrays(
            f"{folder}/pairs-{k}",
            named("pairs", encode(value, len(counts) * model.words)) | named("pointers", encode(ends, len(key) + 1))
            | {"prob": prob, "backoff": backoff, "range": np.array([p0, p1, b0, b1])},
        )
        return pa.record_batch([pa.array([k], pa.int32())], names=["part"])

    def build(batches):
        now, counts, held = None, None, []
        for batch in batches:
            for k, no, data in zip(*(c.to_pylist() for c in batch.columns)):
                if no == 0:
                    if now is not None:
                        yield level(now, counts, held)
                    now, counts, held = k, np.frombuffer(data, dtype=U64).reshape(2, -1)[1].astype(np.int64), []
                else:
                    held.append(unpack(data))
        if now is not None:
            yield level(now, counts, held)

    return map_arrow(rows, build, "part int").count()


def train_model(train: DataFrame) -> Model:
    """train(text) -> the model, its levels in a new shared folder.  Null texts are empty."""
    spark = train.sparkSession
    folder = local_folder(shared_path(spark, "trie"))
    plain = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = materialize(count_words(train, plain), "vocab")
    sizes = fine.agg(F.sum("n"), F.sum("total")).first()
    words, total = int(sizes[0] or 0), int(sizes[1] or 0)
    # One shard per hash range; a corpus with more words counts in more ranges first.
    shards = plain
    if words > plain * SHARD_WORDS:
        shards = -(-words // SHARD_WORDS)
        fine = materialize(count_words(train, shards), "vocab")
    have = {r["part"]: r["n"] for r in fine.select("part", "n").collect()}  # one number a shard
    firsts = np.concatenate(([0], np.cumsum([have.get(k, 0) for k in range(shards)])))
    model = Model(folder, firsts.tolist(), total)
    if words:
        write_words(fine, folder, firsts.tolist())
        write_pairs(train, fine, model, max(plain, total // TASK_PAIRS))
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) -> its other columns and n_tokens, n_known, base_score, score (log10); these replace columns of the
    same names."""
    new = ["n_tokens", "n_known", "base_score", "score"]
    cols = [c for c in docs.columns if c != "text" and c not in new]
    down = model.denominator()

    def run(batches):
        for batch in batches:
            rest = batch.select(cols)
            for a, (t, off) in _chunks(batch.column(batch.schema.get_field_index("text"))):
                ids, ctx, n = pair_ids(model, t, off)
                p = (n + 0.5) / down
                key, back = np.unique((ctx.astype(U64) << U64(32)) | (ids & 0xFFFFFFFF).astype(U64), return_inverse=True)
                one = np.empty(len(key), dtype=np.int64)
                one[back] = np.arange(len(back))
                sure = ctx[one] >= 0
                prob, weight = np.zeros(len(key)), np.ones(len(key))
                prob[sure], weight[sure] = model.find_pairs(ctx[one][sure], ids[one][sure])
                full = prob[back] + weight[back] * p
                rows = len(off) - 1
                known = np.add.reduceat((n > 0).astype(np.int64), off[:-1])
                out = [np.diff(off), known, np.add.reduceat(np.log10(p), off[:-1]), np.add.reduceat(np.log10(full), off[:-1])]
                yield pa.record_batch(rest.slice(a, rows).columns + [pa.array(x) for x in out], names=cols + new)

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    return map_arrow(docs, run, f"{kinds}n_tokens long, n_known long, base_score double, score double")
