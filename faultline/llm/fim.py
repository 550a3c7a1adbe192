"""Fill-in-middle transformation over a compressed set of token boundaries.

A text is cut into units: runs of A-Z and a-z, and single other code points.  The ends of the units (code-point
offsets) are kept as a set of containers, one for each 2^16 offsets, of the smallest of three kinds:

* array: the sorted low 16 bits;
* bitmap: 2^16 bits;
* run: first offset and length of each run of neighbouring offsets.

Next to the containers lie their cumulative cardinalities.  The k-th boundary is found by a binary search in these, then
by a select inside one container: an index (array), a search in the cumulative bit counts of its words and the place of
a bit in one word (bitmap), or a search in the cumulative run lengths (run).

Defined results: a null text counts as empty; an empty text is plain; a text that holds one of the markers is plain, so
that every output can be taken apart again; a null id counts as the empty text in the hash; repeated rows give equal
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # of a hundred texts, the rest is plain
SPM_BELOW = 20  # of a hundred transformed texts

LETTER = np.zeros(128, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True

CHUNK = 1 << 16
WORDS = CHUNK // 64


def unit_ends(text: str) -> np.ndarray:
    """Code-point offsets at which units end, ascending."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (cp < 128) & LETTER[np.minimum(cp, 127)]
    ends = np.ones(len(cp), dtype=bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    return np.flatnonzero(ends) + 1


@dataclass(frozen=True)
class ArrayContainer:
    low: np.ndarray  # uint16, sorted

    def select(self, k: int) -> int:
        return int(self.low[k])


@dataclass(frozen=True)
class BitmapContainer:
    words: np.ndarray  # uint64
    before: np.ndarray  # bits in the words up to each, exclusive

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        word, left = int(self.words[w]), k - int(self.before[w])
        for _ in range(left):  # clear the lowest bits before the wanted one
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1


@dataclass(frozen=True)
class RunContainer:
    first: np.ndarray  # uint16, sorted
    before: np.ndarray  # values in the runs up to each, exclusive

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[r]) + k - int(self.before[r])


def container(low: np.ndarray):
    """The smallest container for sorted offsets below 2^16 (bytes: array 2 a value, run 4 a run, bitmap 8192)."""
    begins = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    sizes = {"run": 4 * len(begins), "array": 2 * len(low), "bitmap": CHUNK // 8}
    kind = min(sizes, key=sizes.get)
    if kind == "run":
        return RunContainer(low[begins].astype(np.uint16), begins)
    if kind == "array":
        return ArrayContainer(low.astype(np.uint16))
    bits = np.zeros(CHUNK, dtype=np.uint8)
    bits[low] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    count = np.bitwise_count(words).astype(np.int64)
    return BitmapContainer(words, np.cumsum(count) - count)


class BoundarySet:
    """Sorted distinct offsets as containers; ``select(k)`` gives the k-th smallest (from 0)."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cut = np.flatnonzero(np.diff(high, prepend=-1))
        ends = np.concatenate((cut[1:], [len(offsets)])).astype(np.int64)
        self.high = high[cut]
        self.parts = [container(offsets[a:b] & (CHUNK - 1)) for a, b in zip(cut, ends)]
        self.upto = ends  # cumulative cardinalities, inclusive

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        c = int(np.searchsorted(self.upto, k, "right"))
        return (int(self.high[c]) << 16) + self.parts[c].select(k - (int(self.upto[c - 1]) if c else 0))


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on the id alone."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output)."""
    ends = BoundarySet(unit_ends(text))
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id)
    if n == 0 or h3 % 100 >= PLAIN_FROM or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (ends.select(k - 1) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", i, j - i, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", i, j - i, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output; one row per row, no shuffle.  Tasks
    hold one text's units at a time and send outputs on in pieces of some megabytes."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    schema = pa.schema(list(zip(names, types)))

    def pack(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append((doc_id, *transform(doc_id, text.as_py() or "")))
                held += len(rows[-1][-1])
                if held >= 1 << 21 or len(rows) >= 2000:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def restored(fim: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from form and output alone.  A text holds no marker and none can arise at a
    seam, since ``<`` only begins markers; so the first occurrence of each is the one that was put there."""
    o, m = F.col("output"), F.lit(MIDDLE)
    two = F.when(F.col("form") == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    mid = F.locate(MIDDLE, o)
    seam = F.instr(o, two)
    skip = F.lit(3)
    x = F.substring(o, skip + 1, seam - skip - 1)
    y = F.substring(o, seam + skip, mid - seam - skip)
    z = F.substring(o, mid + F.length(m), F.length(o))
    built = F.when(F.col("form") == "spm", F.concat(y, z, x)).when(F.col("form") == "psm", F.concat(x, z, y)).otherwise(o)
    return fim.withColumn("restored", built)
