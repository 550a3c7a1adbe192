"""Vectorised word hashing over Arrow text columns.

Words are runs of bytes of one class, taken from the UTF-8 bytes of whole texts.  Separators are ASCII, so a
byte class equals the code-point class of the contracts.  Texts are walked in pieces of about ``PIECE`` bytes cut
at separators, so memory follows the piece and the number of words (8 bytes each), not the text length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD6E8FEB86659FD93)
_pow = np.ones(1, dtype=U64)
#: Factors that make a hash of a word sequence depend on the order.
ORDER = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        more = np.full(max(n, 64), _BASE, dtype=U64)
        more[0] = 1
        _pow = np.multiply.accumulate(more)
    return _pow


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null counts as empty."""
    col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]] if len(off) else buf[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def _cuts(buf: np.ndarray, word: np.ndarray):
    at, end = 0, len(buf)
    while at < end:
        cut = min(at + PIECE, end)
        while cut < end:
            stop = np.flatnonzero(~word[LOWER[buf[cut : cut + 65536]]])
            if len(stop):
                cut += int(stop[0])
                break
            cut = min(cut + 65536, end)
        yield at, cut
        at = cut


def word_hashes(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word in order, and n + 1 word offsets of the texts."""
    hashes, starts = [], []
    for s, e in _cuts(buf, word):
        b = LOWER[buf[s:e]]
        m = word[b]
        first = np.zeros(e - s + 1, dtype=bool)  # a text begins here
        inside = off[np.searchsorted(off, s) : np.searchsorted(off, e)]
        first[inside - s] = True
        first[-1] = True
        st = m.copy()
        st[1:] &= ~m[:-1] | first[1:-1]
        st = np.flatnonzero(st)
        if not len(st):
            continue
        en = m.copy()
        en[:-1] &= ~m[1:] | first[1:-1]
        lens = np.flatnonzero(en) + 1 - st
        at = np.cumsum(lens) - lens
        wb = b[m]
        pos = np.arange(len(wb)) - np.repeat(at, lens)
        h = np.add.reduceat(_BYTE[wb] * _powers(int(lens.max()))[pos], at)
        hashes.append(mix(h + lens.astype(U64) * U64(0x8BB84B93962EACC9)))
        starts.append(st + s)
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off).astype(np.int64)


def sequence_hash(h: np.ndarray, at: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each position of ``at`` on."""
    out = np.full(len(at), (salt * 0x2545F4914F6CDD1D + n) % (1 << 64), dtype=U64)
    for j in range(n):
        out += h[at + j] * ORDER[j]
    return mix(out)


def gram_starts(off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all n-word windows inside texts, and the text of each."""
    count = np.maximum(np.diff(off) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    return np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[:-1], count), doc


def groups(off: np.ndarray, rows: int, size: int):
    """Row ranges of at most ``rows`` rows and, unless one row is larger, ``size`` units."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, min(a + rows, int(np.searchsorted(off, off[a] + size, "right")) - 1))
        yield a, min(b, n)
        a = b
