import numpy as np
import pytest

from faultline.llm.elias_fano import EliasFano, encode


@pytest.mark.parametrize("n,u", [(0, 10), (1, 1), (5, 7), (900, 1000), (1000, 1 << 40), (20_000, 1 << 63), (30_000, 1 << 17)])
@pytest.mark.parametrize("dense", [False, True])
def test_find_and_access(n, u, dense):
    rng = np.random.default_rng(n + dense)
    v = np.unique(rng.integers(0, max(u // 1000, 1) if dense else u, n, dtype=np.uint64))
    e = EliasFano(encode(v, u))
    q = np.concatenate((v, rng.integers(0, u, 500, dtype=np.uint64)))
    at = {int(x): i for i, x in enumerate(v)}
    assert e.find(q).tolist() == [at.get(int(x), -1) for x in q]
    if len(v):
        assert (e.access(np.arange(len(v))) == v).all()


def test_repeated_values():
    v = np.array([0, 0, 3, 3, 3, 9], dtype=np.uint64)
    assert EliasFano(encode(v, 10)).access(np.arange(6)).tolist() == v.tolist()
