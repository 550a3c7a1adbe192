import random
import re

import numpy as np
import pytest

from faultline.llm import fim as M


def unit_lengths(text):
    return [len(u) for u in re.findall("[A-Za-z]+|[^A-Za-z]", text)]


@pytest.mark.parametrize("text", ["", "a", " ", "ab c", "Ab1c  é\U0001f600Z\n", "ſK<P", "x" * 70_000 + "." * 70_000 + "a b" * 40_000])
def test_units(text):
    assert M.unit_ends(text).tolist() == np.cumsum([0, *unit_lengths(text)])[1:].tolist()


def test_select_in_every_kind_of_container():
    rng = np.random.default_rng(1)
    kinds = set()
    for make in (
        lambda: rng.choice(65536, 300, replace=False),
        lambda: rng.choice(65536, 30_000, replace=False),
        lambda: np.concatenate([np.arange(a, a + 40) for a in rng.choice(65, 20, replace=False) * 1000]),
        lambda: np.arange(65536), lambda: np.array([0]), lambda: np.array([65535]),
        lambda: np.concatenate((rng.choice(300_000, 9000, replace=False), 400_000 + np.arange(150_000), 700_000 + 3 * np.arange(60_000))),
    ):
        offsets = np.unique(make())
        found = M.BoundarySet(offsets)
        kinds |= {type(p).__name__ for p in found.parts}
        assert len(found) == len(offsets)
        for k in {0, len(offsets) - 1, *rng.integers(0, len(offsets), 400).tolist()}:
            assert found.select(k) == offsets[k]
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}
    assert len(M.BoundarySet(np.zeros(0, dtype=np.int64))) == 0


def test_outputs_rebuild_the_text(spark):
    rng = random.Random(4)
    pieces = ["ab", "<", "P>", "<S", ">", "M", " ", "é", "\U0001f600", "\n", "<P", "S>"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30)))) for i in range(2000)] + [(None, None), (5, ""), (7, "<M>"), (8, "a" * 200_000 + " b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS output", "'y' AS restored")
    got = M.restored(M.fill_in_middle(docs)).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    forms = {r["form"] for r in got}
    assert forms == {"plain", "psm", "spm"}
    for r in got:
        if r["form"] != "plain":
            assert len(r["output"]) == len(r["restored"]) + 9
            assert r["restored"][: r["prefix_chars"]] in r["output"]
            ends = {0, *np.cumsum(unit_lengths(r["restored"])).tolist()}
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= ends
        elif r["doc_id"] is not None and r["restored"] and not re.search("<[PSM]>", r["restored"]):
            assert M.draws(r["doc_id"])[2] % 100 >= 90
