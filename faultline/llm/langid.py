"""Language identification of mixed-language text.

Words are runs of letters.  Training counts, over all labelled texts, hashed letter trigrams inside words and the
letters of each script per language.  A word's script (that of its first letter) narrows the candidates to languages
that write at least ``SCRIPT_SHARE`` of their letters in it; among those a word scores its trigrams' log
probabilities.  Viterbi over the words, with a penalty for each change of language, labels spans.

A text on one language needs no search: if no other language gains more than half a penalty over the best one in any
run of words, the path without a change is optimal (k runs of others gain less than k / 2 penalties and cost k - 1
changes at least, one if k is 1).  The other texts of a batch go through the recurrence together.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words as W
from faultline.llm.shared import map_arrow

BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
SCRIPT_SHARE = 0.001
SMOOTHING = 0.5
UNKNOWN = "und"
#: A model holds at most so many languages (512 kB each in the broadcast).
MAX_LANGUAGES = 400

# First and last code point of Unicode blocks, by script.
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: lower case (0 if no letter), and script number (0: other)."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha() and unicodedata.category(x)[0] == "L":
            y = x.lower()
            lower[c] = ord(y) if len(y) == 1 else c
    script = np.zeros(0x110000, dtype=np.uint8)
    for k, spans in enumerate(SCRIPTS.values(), 1):
        for a, b in spans:
            script[a : b + 1] = k
    return lower, script


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the offsets of the texts in them."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.uint32)
    b0 = b[at]
    cp = b0.copy()
    for least, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        i = np.flatnonzero(b0 >= least)
        x = b0[i] & keep
        for j in range(1, more + 1):
            x = (x << 6) | (b[at[i] + j] & 0x3F)
        cp[i] = x
    return np.minimum(cp, 0x10FFFF), np.searchsorted(at, off)


class Words:
    """Words of a chunk of texts: trigram buckets of all letters, and per word its place."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        lower, script = letters()
        cp, text = code_points(buf, off)
        low = lower[cp]
        is_letter = low > 0
        first = np.zeros(len(cp) + 1, dtype=bool)
        first[text] = True
        begins = is_letter.copy()
        begins[1:] &= ~is_letter[:-1] | first[1:-1]
        self.at = np.flatnonzero(is_letter)
        start = begins[self.at]
        self.starts = np.flatnonzero(start)  # in the array of letters
        c = low[self.at]
        prev = np.concatenate((c[:1] * 0, c[:-1]))
        prev[start] = 0
        two = np.concatenate((prev[:1] * 0, prev[:-1]))
        two[start] = 0
        h = c * np.uint32(0x9E3779B1) + prev * np.uint32(0x85EBCA77) + two * np.uint32(0xC2B2AE3D)
        self.bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        self.begin = self.at[self.starts] if len(self.starts) else self.starts
        self.size = np.diff(np.concatenate((self.starts, [len(self.at)])))
        self.script = script[cp[self.begin]] if len(self.begin) else np.zeros(0, np.uint8)
        self.letter_script = script[cp[self.at]]
        self.of = np.searchsorted(self.begin, text)  # first word of each text
        self.text = text


def _chunks(col: pa.Array, size: int):
    buf, off = W.utf8(col)
    for a, b in W.groups(off, 1024, size):
        yield a, b - a, Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])


def count_trigrams(train: DataFrame) -> DataFrame:
    """train(text, lang) -> lang, slot, n over all rows; slots from BUCKETS on count the letters of scripts."""
    slots = BUCKETS + len(SCRIPTS) + 1

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for a, rows, w in _chunks(batch.column(0), 1 << 20):
                letters_of = np.searchsorted(w.at, w.text)
                names, code = np.unique(langs[a : a + rows].astype(str), return_inverse=True)
                code = np.repeat(code, np.diff(letters_of))
                for k, name in enumerate(names):
                    sel = code == k
                    c = counts.setdefault(str(name), np.zeros(slots, np.int64))
                    c += np.bincount(w.bucket[sel], minlength=slots)
                    c += np.bincount(w.letter_script[sel].astype(np.int64) + BUCKETS, minlength=slots)
        for name, c in counts.items():
            slot = np.flatnonzero(c)
            yield pa.record_batch([pa.array([name] * len(slot)), pa.array(slot.astype(np.int32)), pa.array(c[slot])], names=["lang", "slot", "n"])

    rows = train.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    return map_arrow(rows, run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (sorted), log probabilities [language, bucket], candidates [script, language].  What reaches the
    driver is the model: one number for each language and slot."""
    rows = count_trigrams(train).toArrow()
    lang = np.array(rows["lang"].to_pylist(), dtype=object).astype(str)
    names = sorted(set(lang.tolist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(names), BUCKETS + len(SCRIPTS) + 1))
    counts[np.searchsorted(np.array(names, dtype=str), lang) if names else [], rows["slot"].to_numpy()] = rows["n"].to_numpy()
    tri, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logp = np.log(tri + SMOOTHING) - np.log(tri.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    can = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
    can[~can.any(axis=1)] = True
    return names, logp.astype(np.float32), can


def _viterbi(score: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """score [text, word, language] (padded), words of each text -> best labels."""
    m, steps, k = score.shape
    back = np.zeros((steps, m, k), dtype=np.int16)
    best = score[:, 0].copy()
    done = best.copy()
    own = np.arange(k, dtype=np.int16)[None, :]
    for t in range(1, steps):
        top = best.argmax(axis=1)
        change = best[np.arange(m), top][:, None] - SWITCH_PENALTY
        switch = change > best
        back[t] = np.where(switch, top[:, None], own)
        best = np.where(switch, change, best) + score[:, t]
        done[size > t] = best[size > t]
    out = []
    for i in range(m):
        label = np.empty(size[i], dtype=np.int64)
        label[-1] = now = int(done[i].argmax())
        for t in range(size[i] - 1, 0, -1):
            now = int(back[t, i, now])
            label[t - 1] = now
        out.append(label)
    return out


def label_words(w: Words, logp: np.ndarray, can: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label of each word, and scores [language, word]."""
    k, n = len(logp), len(w.starts)
    score = np.empty((k, n), dtype=np.float64)
    for j in range(k):
        score[j] = np.add.reduceat(logp[j][w.bucket], w.starts) if n else 0.0
        score[j][~can[w.script, j]] = -1e4
    count = np.diff(w.of)
    rows = np.flatnonzero(count)
    label = np.zeros(n, dtype=np.int64)
    if not n:
        return label, score
    first = w.of[:-1][rows]
    total = np.stack([np.add.reduceat(s, first) for s in score])
    main = total.argmax(axis=0)
    text = np.repeat(np.arange(len(rows)), count[rows])
    label[:] = main[text]
    mixed = np.zeros(len(rows), dtype=bool)
    base = score[label, np.arange(n)]
    for j in range(k):
        d = score[j] - base
        # Largest gain of a run inside each text: running sum less its smallest value before.
        s = np.cumsum(d)
        s -= np.repeat(s[first] - d[first], count[rows])
        before = np.concatenate(([0.0], s[:-1]))
        before[first] = 0.0
        drop = 2.0 * max(np.abs(s).max(), 1.0) + 1.0
        low = np.minimum.accumulate(before - drop * text) + drop * text
        mixed |= np.maximum.reduceat(s - low, first) >= SWITCH_PENALTY / 2
    todo = np.flatnonzero(mixed)
    todo = todo[np.argsort(count[rows][todo])]
    while len(todo):
        # Texts of similar length together, within some 32 MB.
        longest = count[rows][todo[-1]]
        some = todo[-max(1, min(len(todo), (1 << 22) // int(longest * k))) :]
        todo = todo[: len(todo) - len(some)]
        size = count[rows][some]
        pad = np.zeros((len(some), int(size.max()), k))
        for i, r in enumerate(some):
            pad[i, : size[i]] = score[:, first[r] : first[r] + size[i]].T
        for r, x in zip(some, _viterbi(pad, size)):
            label[first[r] : first[r] + len(x)] = x
    return label, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs(..., text) -> its other columns, lang_pred, score, spans (these replace columns of the same names).

    spans: array of (start, end, lang), code points, end exclusive, from the first letter of a run of equally labelled
    words to the last.  lang_pred: the language with most letters in spans (ties: first by name); ``und`` without a
    letter or a model.  score: share of letters under that label times the probability of the language for these
    letters; 0 for ``und``.  Null text has no letter.
    """
    names, logp, can = model
    shared = docs.sparkSession.sparkContext.broadcast((logp, can))
    cols = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "spans")]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        logp, can = shared.value
        k = len(names)
        kinds = np.array(names + [UNKNOWN], dtype=object)
        for batch in batches:
            rest = batch.select(cols)
            for a, rows, w in _chunks(batch.column(batch.schema.get_field_index("text")), (1 << 22) // max(k, 4)):
                n = len(w.starts)
                if not k or not n:
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], span))
                    yield pa.record_batch(rest.slice(a, rows).columns + [pa.array([UNKNOWN] * rows), pa.array(np.zeros(rows)), none], names=cols + ["lang_pred", "score", "spans"])
                    continue
                label, score = label_words(w, logp, can)
                text = np.repeat(np.arange(rows), np.diff(w.of))
                weight = np.zeros((rows, k))
                np.add.at(weight, (text, label), w.size)
                total = weight.sum(axis=1)
                pred = np.where(total > 0, weight.argmax(axis=1), k)
                mine = label == pred[text]
                like = np.stack([np.bincount(text[mine], weights=score[j][mine], minlength=rows) for j in range(k)], axis=1)
                like = np.exp(np.clip(like - like.max(axis=1, keepdims=True), -700, 0))
                like /= like.sum(axis=1, keepdims=True)
                pick = np.minimum(pred, k - 1)
                value = np.where(total > 0, weight[np.arange(rows), pick] / np.maximum(total, 1) * like[np.arange(rows), pick], 0.0)
                new = np.concatenate(([True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])))
                s = np.flatnonzero(new)
                e = np.concatenate((s[1:], [n])) - 1
                shift = w.text[text[s]]
                spans = pa.StructArray.from_arrays([pa.array(w.begin[s] - shift), pa.array(w.begin[e] + w.size[e] - shift), pa.array(kinds[label[s]], pa.string())], fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[s], np.arange(rows + 1)).astype(np.int32)), spans)
                yield pa.record_batch(rest.slice(a, rows).columns + [pa.array(kinds[pred], pa.string()), pa.array(value), lists], names=cols + ["lang_pred", "score", "spans"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    return map_arrow(docs, run, f"{kinds}lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
