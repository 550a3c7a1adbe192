"""Elias-Fano coded monotone sequences over numpy arrays that may be memory-mapped, with batched search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ONE = U64(1)
#: Position of the k-th set bit (from 0) of a byte.
_IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], dtype=np.uint8)


def _select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each word."""
    x = w - ((w >> _ONE) & U64(0x5555555555555555))
    x = (x & U64(0x3333333333333333)) + ((x >> U64(2)) & U64(0x3333333333333333))
    x = (x + (x >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)
    upto = x * U64(0x0101010101010101)  # set bits up to and with each byte
    k = k.astype(U64)
    high = U64(0x8080808080808080)
    past = (((k * U64(0x0101010101010101)) | high) - upto) & high  # bytes whose count does not exceed k
    byte = np.bitwise_count(past).astype(U64)
    before = np.where(byte > 0, (upto >> ((np.maximum(byte, _ONE) - _ONE) * U64(8))) & U64(255), U64(0))
    bits = (w >> (byte * U64(8))) & U64(255)
    return (byte * U64(8)).astype(np.int64) + _IN_BYTE[bits.astype(np.int64), (k - before).astype(np.int64)]


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """values: sorted, below ``universe``.  low: packed low bits; high: unary coded upper parts; zeros: count of
    zero bits before each word of ``high`` (the directory of the search)."""
    n = len(values)
    low_bits = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
    values = values.astype(U64)
    buckets = int((int(universe) - 1) >> low_bits) + 1 if universe else 1
    low = np.zeros(n * low_bits // 64 + 2, dtype=U64)
    if low_bits and n:
        part = values & U64((1 << low_bits) - 1)
        bit = np.arange(n, dtype=U64) * U64(low_bits)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        np.bitwise_or.at(low, word, part << shift)
        over = np.where(shift > 0, (part >> _ONE) >> (U64(63) - shift), U64(0))
        np.bitwise_or.at(low, word + 1, over)
    size = n + buckets + 1
    high = np.zeros(size // 64 + 2, dtype=U64)
    if n:
        at = (values >> U64(low_bits)) + np.arange(n, dtype=U64)
        np.bitwise_or.at(high, (at >> U64(6)).astype(np.int64), _ONE << (at & U64(63)))
    ones = np.bitwise_count(high).astype(np.int64)
    zeros = np.cumsum(64 - ones) - (64 - ones)
    return {"meta": np.array([n, low_bits], dtype=np.int64), "low": low, "high": high, "zeros": zeros}


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in parts["meta"])
        self.low, self.high, self.zeros = parts["low"], parts["high"], parts["zeros"]

    def _first(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose upper part is below ``bucket``."""
        k = bucket - 1  # the zero that ends bucket - 1
        word = np.searchsorted(self.zeros, k, "right") - 1
        word = np.maximum(word, 0)
        at = _select_in_word(~self.high[word], np.maximum(k - self.zeros[word], 0))
        return np.where(bucket > 0, word * 64 + at - k, 0)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=U64)
        bit = i.astype(U64) * U64(self.low_bits)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, (self.low[word + 1] << _ONE) << (U64(63) - shift), U64(0))
        return x & U64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - ones[word])
        return ((at - i).astype(U64) << U64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
        """Position of each value, by successor search: the first stored value not below it; -1 if that differs."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n:
            return out
        for a in range(0, len(x), chunk):
            v = x[a : a + chunk].astype(U64)
            bucket = (v >> U64(self.low_bits)).astype(np.int64)
            lo, end = self._first(bucket), self._first(bucket + 1)
            want = v & U64((1 << self.low_bits) - 1)
            hi = end.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):  # binary search on the low parts inside the bucket
                mid = (lo[open_] + hi[open_]) >> 1
                less = self._low(mid) < want[open_]
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            inside = np.flatnonzero(lo < end)
            inside = inside[self._low(lo[inside]) == want[inside]]
            out[a + inside] = lo[inside]
        return out
