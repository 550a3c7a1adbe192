import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import words as W

PATTERN = {"space": (W.NOT_SPACE, r"[^\x20\x09-\x0D]+"), "alnum": (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def check(texts, kind):
    table, pattern = PATTERN[kind]
    h, off = W.word_hashes(*W.utf8(pa.array(texts, pa.string())), table)
    want = [re.findall(pattern, lower(t or "")) for t in texts]
    assert np.diff(off).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(h) == len(flat)
    assert len(set(h.tolist())) == len(set(flat))
    by = {}
    for w, x in zip(flat, h.tolist()):
        assert by.setdefault(w, x) == x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA bB\t\n.é😀0{", max_size=40)), max_size=8), st.sampled_from(list(PATTERN)))
def test_words(texts, kind):
    check(texts, kind)


def test_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 7)
    for kind in PATTERN:
        check(["ab cd efghijklmnop q", "", None, "x", "longwordwithoutanyspace" * 9, "é é é"], kind)


def test_sliced_column():
    col = pa.array(["a b", "c d e", None, "f"]).slice(1, 2)
    _, off = W.word_hashes(*W.utf8(col), W.NOT_SPACE)
    assert off.tolist() == [0, 3, 3]


def test_grams():
    at, doc = W.gram_starts(np.array([0, 3, 4, 4, 9]), 3)
    assert at.tolist() == [0, 4, 5, 6] and doc.tolist() == [0, 3, 3, 3]
