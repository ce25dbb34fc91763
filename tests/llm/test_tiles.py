"""Links counted in a tile: rare n-grams pair by pair, common ones by products of matrices."""

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm import ngram_join


def tile(rng, n, own):
    base = [set(rng.integers(0, 4000, 40).tolist()) for _ in range(6)]
    sets = [set([*base[k % 6], *rng.integers(0, 4000, 3).tolist()]) for k in range(n)]
    rows = [(i, f, sorted(g for g in s if g % 3 == f)) for i, s in enumerate(sets) for f in range(3)] + [(0, 0, sorted(g for g in sets[0] if g % 3 == 0))]
    s1 = np.array([r[0] for r in rows])
    return sets, pa.table({"i": [0] * len(rows), "j": [0 if own else 1] * len(rows), "s1": s1 * 7, "side": s1 % 2 if not own else s1 * 0, "size": [len(sets[k]) for k in s1], "copies": s1 % 3 + 1, "fragment": pa.array([r[1] for r in rows], pa.int32()), "grams": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("dense", [0, 20, 10**9])
def test_both_ways_count_the_same(monkeypatch, own, dense):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    sets, t = tile(np.random.default_rng(4), 60, own)
    got = dict(zip(*(c.to_pylist() for c in ngram_join._count_links(8, 10)(t).columns), strict=True))
    for i, a in enumerate(sets):
        want = sum(k % 3 + 1 for k, b in enumerate(sets) if k != i and (own or (k - i) % 2) and 10 * len(a & b) >= 8 * len(a | b))
        assert got[i * 7] == want


def test_no_product_for_rare_ngrams(monkeypatch):
    made = []
    zeros = np.zeros
    monkeypatch.setattr(ngram_join.np, "zeros", lambda shape, *a: (made.append(shape), zeros(shape, *a))[1])
    n = 400
    t = pa.table({"i": [0] * n, "j": [0] * n, "s1": range(n), "side": [0] * n, "size": [2] * n, "copies": [1] * n, "fragment": pa.array([0] * n, pa.int32()), "grams": pa.array([[k, k + 1] for k in range(n)], pa.list_(pa.int64()))})
    out = ngram_join._count_links(1, 3)(t)
    assert sum(out.column("others").to_pylist()) == 2 * (n - 1) and made == [(n, n)]
