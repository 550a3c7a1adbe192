"""Cross-tokenizer alignment.

A text is encoded by two vocabularies; the byte offsets where tokens of both end cut it into groups, the smallest pieces
that are whole tokens in both.  They are found by divide and conquer: in an interval of tokens that ends together, take
the token end of A nearest to the middle that is also an end of B (each is looked for by bisection in B's ends), cut
there, and go on with both halves; an interval without a cut inside is a group.  All intervals of some texts are halved
together, one numpy step a level: an interval whose middle is no cut looks at a window around it that doubles until it
holds a cut or spans the interval.

The last tokens of a group end together: a link.  Their ids' pair is counted over the corpus.  One of two linked tokens
is a suffix of the other, so the distinct pairs are bounded by the vocabularies alone (``pair_bound``, about half a million here), and
their counts are broadcast; links themselves are written once, four bytes each.

Vocabulary A's entries and merges, whose order is that of the ids, run in the faster of two public byte-pair encoders; that
it gives the other's ids is tested.  Texts with very long white space go through the other.

Defined results: null and empty texts, and texts that a vocabulary does not give back byte by byte, have no tokens; a
null id stays null; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import map_arrow, materialize

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how a byte-level pre-tokenizer splits text.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = re.compile(r"\s{2000}")
#: Texts encoded at once, in characters (one text may be longer).
PIECE = 1 << 19


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves,
    the other bytes, in order, for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def added_ids(model: bytes) -> set[int]:
    """Special tokens, which plain text never gives."""
    return {t["id"] for t in json.loads(model)["added_tokens"]}


def a_tokens(model: bytes) -> list[bytes]:
    """Bytes of each id; an added token's are its own UTF-8."""
    spec, table = json.loads(model), byte_level()
    assert spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and spec["normalizer"] is None
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for text, i in vocab.items():
        out[i] = bytes(table[c] for c in text) if i not in added else b""
    for i, content in added.items():
        out[i] = content
    return out


def b_tokens(model: bytes) -> list[bytes]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return [piece(i) for i in range(sp.get_piece_size())]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Id pairs of which one token ends with the other, at most as many as can ever be linked."""
    count = {}
    for t in b:
        count[t] = count.get(t, 0) + 1
    own = {}
    for t in a:
        own[t] = own.get(t, 0) + 1
    shorter = sum(count.get(t[i:], 0) for t in a for i in range(len(t)))
    return shorter + sum(own.get(t[i:], 0) for t in b for i in range(1, len(t)))


class Vocabulary:
    """Encoder and token bytes; built once in a Python worker from the files' contents."""

    def __init__(self, a_model: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(a_model.decode())
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.tokens = a_tokens(a_model), b_tokens(b_model)
        added = added_ids(a_model)
        ranks = {t: i for i, t in enumerate(self.tokens[0]) if i not in added}
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in self.tokens]

    def encode_a(self, text: str) -> list[int]:
        if LONG_SPACE.search(text):  # more than the faster encoder's stack holds
            return self.slow.encode(" " + text, add_special_tokens=False).ids
        return self.a.encode_ordinary(" " + text)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of space + text in A and of text in B; both empty where either does not give the bytes back."""
        out = []
        a = map(self.encode_a, texts)
        for text, x, y in zip(texts, a, self.b.encode(texts, num_threads=1)):
            want = b" " + text.encode()
            whole = text and all(b"".join([side[i] for i in ids]) == want for side, ids in zip(self.tokens, (x, y)))
            out.append((x, y) if whole else ([], []))
        return out


@lru_cache(maxsize=2)
def vocabulary(a_model: bytes, b_model: bytes) -> Vocabulary:
    return Vocabulary(a_model, b_model)


def cuts(a_end: np.ndarray, b_end: np.ndarray, a_text: np.ndarray, b_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a_end, in b_end) of the ends that both have, ascending.

    Ends count from the start of the first text on, so they rise over all texts; a_text and b_text: how many tokens lie
    before each text (and after the last).  The last ends of a text's two sides are equal.
    """
    some = np.flatnonzero(np.diff(a_text) > 0)
    # Intervals: tokens [lo, hi) of A and [low, high) of B; the ends at hi - 1 and high - 1 are equal.
    lo, hi, low, high = a_text[some], a_text[some + 1], b_text[some], b_text[some + 1]
    found = [(hi - 1, high - 1)]
    while len(lo):
        wide = (hi - lo > 1) & (high - low > 1)
        lo, hi, low, high = lo[wide], hi[wide], low[wide], high[wide]
        cut = np.full(len(lo), -1)
        at = np.full(len(lo), -1)
        left = np.arange(len(lo))
        inner, outer = 0, 1  # the window: distances [inner, outer) from the middle
        while len(left):
            mid = (lo[left] + hi[left] - 2) // 2
            reach = np.maximum(mid - lo[left], hi[left] - 2 - mid)
            step = np.arange(inner, outer)
            step = np.unique(np.concatenate((step, -step)))
            step = step[np.argsort(np.abs(step), kind="stable")]
            for part in np.array_split(left, max(1, len(left) * len(step) >> 20)):
                m = (lo[part] + hi[part] - 2) // 2
                i = m[:, None] + step
                inside = (i >= lo[part][:, None]) & (i <= hi[part][:, None] - 2)
                i = np.where(inside, i, lo[part][:, None])
                end = a_end[i]
                j = np.searchsorted(b_end, end)
                hit = inside & (b_end[j] == end)
                nearest = hit.argmax(axis=1)
                has = hit[np.arange(len(part)), nearest]
                cut[part[has]] = i[has, nearest[has]]
                at[part[has]] = j[has, nearest[has]]
            go = (cut[left] < 0) & (reach >= outer)
            left = left[go]
            inner, outer = outer, outer * 4
        has = cut >= 0
        i, j = cut[has], at[has]
        found.append((i, j))
        lo, hi, low, high = (np.concatenate(x) for x in ((lo[has], i + 1), (i + 1, hi[has]), (low[has], j + 1), (j + 1, high[has])))
    a, b = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(a)
    return a[order], b[order]


@lru_cache(maxsize=1)
def digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every 16-bit id, left-aligned bytes, and how many."""
    text = np.arange(1 << 16).astype("S5")
    return np.frombuffer(text.tobytes(), dtype=np.uint8).reshape(-1, 5), np.char.str_len(text)


def written(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, a_text: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all texts in a row, and where each text starts (and the last ends)."""
    ga, gb = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))  # group of each token
    first_a, first_b = np.diff(ga, prepend=-1) > 0, np.diff(gb, prepend=-1) > 0
    sep_a, sep_b = np.where(first_a, ord(";"), ord(",")), np.where(first_b, ord("|"), ord(","))
    begins = a_text[:-1][np.diff(a_text) > 0]
    # Both sides in order of (group, side); stable, so ids keep their order.
    order = np.argsort(np.concatenate((ga * 2, gb * 2 + 1)), kind="stable")
    table, length = digits()
    ids = np.concatenate((a, b))[order]
    raw = np.empty((len(order), 6), dtype=np.uint8)
    raw[:, 0] = np.concatenate((sep_a, sep_b))[order]
    raw[:, 1:] = table[ids]
    keep = np.arange(6) <= length[ids][:, None]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    keep[place[begins], 0] = False  # no separator before a text
    upto = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    token_of = np.concatenate((place[: len(a)], [len(order)]))
    return raw[keep].tobytes(), upto[token_of[a_text]]


def align(vocab: Vocabulary, texts: list[str]) -> dict[str, list | np.ndarray]:
    """Tokens, groups and links of some texts."""
    coded = vocab.encode(texts)
    (a, a_text), (b, b_text) = (
        (np.concatenate([np.zeros(0, np.int64), *(np.array(c[side], dtype=np.int64) for c in coded)]),
         np.cumsum([0] + [len(c[side]) for c in coded])) for side in (0, 1))
    i, j = cuts(np.cumsum(vocab.sizes[0][a]), np.cumsum(vocab.sizes[1][b]), a_text, b_text) if len(a) else (a, b)
    group_text = np.searchsorted(i, a_text)
    if len(a):
        data, at = written(a, b, i, j, a_text)
    else:
        data, at = b"", np.zeros(len(texts) + 1, dtype=np.int64)
    return {
        "n_a": np.diff(a_text), "n_b": np.diff(b_text), "n_groups": np.diff(group_text),
        "groups": [data[x:y].decode() for x, y in zip(at[:-1], at[1:])],
        "links": (a[i] << 16 | b[j]).astype(np.uint32), "link_text": group_text,
    }


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, {groups}, links binary"


def aligned(docs: DataFrame, path: str = TOKENIZERS, hashed: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, groups (or groups_sha256 if ``hashed``: a digest is written
    instead of the text), links (uint32: A id << 16 | B id, ascending); one row per row."""
    models = tuple((Path(path) / f).read_bytes() for f in (A_FILE, B_FILE))
    models = docs.sparkSession.sparkContext.broadcast(models)
    name = "groups_sha256" if hashed else "groups"

    def pack(ids, texts):
        got = align(vocabulary(*models.value), texts)
        groups = [hashlib.sha256(g.encode()).hexdigest() if hashed and g else g for g in got["groups"]]
        at = got["link_text"]
        links = [np.sort(got["links"][x:y]).tobytes() for x, y in zip(at[:-1], at[1:])]
        cols = [pa.array(ids, pa.int64()), *(pa.array(got[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups"))]
        return pa.record_batch([*cols, pa.array(groups, pa.large_string()), pa.array(links, pa.binary())], names=["doc_id", "n_a", "n_b", "n_groups", name, "links"])

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= PIECE or len(texts) >= 2000:
                    yield pack(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield pack(ids, texts)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, ALIGNED.format(groups=f"{name} string"))


def pair_counts(links: DataFrame) -> DataFrame:
    """links(links) -> pair, count, over all rows.  A task sends each pair once for some million links."""
    def run(batches):
        held, size = [], 0

        def flush():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), 100_000):
                yield pa.record_batch([pa.array(keys[a : a + 100_000].astype(np.int64)), pa.array(count[a : a + 100_000])], names=["pair", "count"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, dtype=np.uint32))
                size += len(held[-1])
                if size >= 4_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return map_arrow(links.select("links"), run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def link_scores(docs: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is counted as often as any of its B id; count_sum: counts over all links.
    """
    rows = materialize(aligned(docs, path, hashed=True), "aligned")
    table = pair_counts(rows).orderBy("pair").toArrow()  # at most pair_bound rows, which the vocabularies fix
    pair, count = (table.column(c).to_numpy() for c in ("pair", "count"))
    b_id = pair & 0xFFFF
    top = np.zeros(1 << 16, dtype=np.int64)
    np.maximum.at(top, b_id, count)
    known = docs.sparkSession.sparkContext.broadcast((pair.astype(np.uint32), count, count == top[b_id]))

    def run(batches):
        keys, count, best = known.value
        for batch in batches:
            got = []
            for x in batch.column(4).to_pylist():
                at = np.searchsorted(keys, np.frombuffer(x, dtype=np.uint32))
                got.append((len(at), int(best[at].sum()), int(count[at].sum())))
            extra = [pa.array(c, pa.int64()) for c in (zip(*got) if got else ([], [], []))]
            yield pa.record_batch([*batch.columns[:4], *extra, batch.column(5)],
                                  names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return map_arrow(rows.select("doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"), run, out)
