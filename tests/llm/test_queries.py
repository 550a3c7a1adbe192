"""Every query with SQL against DuckDB on the small tables and on the edge cases; every query on empty tables."""

import pytest

from faultline.llm import queries as Q
from tests.llm.conftest import duck

SMALL = "/root/testdata/sf0.001"
OPS = [q for q in Q.SPARK if q.startswith("op")]


def rows(df, cols):
    return sorted(df[cols].astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(Q.ORACLE))
@pytest.mark.parametrize("where", ["small", "edge"])
def test_oracle(spark, edge_dir, name, where):
    path = SMALL if where == "small" else edge_dir
    got = Q.SPARK[name](spark, path).toPandas()
    want = duck(path).execute(Q.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    norm = lambda d: d.astype(object).where(d.notna(), None)
    got, want = norm(got), norm(want)
    for c in cols:
        if c in ("doc_id", "conv_id", "prefix_chars", "middle_chars"):
            got[c], want[c] = (d[c].map(lambda x: None if x is None else int(x)) for d in (got, want))
    assert rows(got, cols) == rows(want, cols)
    assert len(got)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty_dir, name):
    got = Q.SPARK[name](spark, empty_dir).collect()
    assert [r["conv_id"] for r in got] == ([-7] if name.startswith("op9") else [])


@pytest.mark.parametrize("name", [q for q in OPS if q not in Q.ORACLE])
def test_one_row_per_document(spark, edge_dir, edge_rows, name):
    got = sorted(str(r["doc_id"]) for r in Q.SPARK[name](spark, edge_dir).collect())
    assert got == sorted(str(r["doc_id"]) for r in edge_rows)
