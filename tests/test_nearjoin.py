"""The near join and the longest common substring against plain Python."""

import random
from difflib import SequenceMatcher

import pytest

from quillmill.operators import commonsub, nearjoin, overlap


def texts_of(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh日本", k=rng.randint(8, 60))) for _ in range(n)]
    out = list(base)
    for t in rng.choices(base, k=3 * n):
        s = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 7))):
            at = rng.randrange(len(s))
            if rng.random() < 0.5:
                s[at] = rng.choice("abcxyz")
            elif len(s) > 8:
                del s[at]
            else:
                s.insert(at, "q")
        out.append("".join(s))
    return [t for t in out if len(t) >= 8] + ["a" * 40, "a" * 41, "ab" * 20, "ab" * 20 + "b"]


@pytest.mark.parametrize("held,block", [(10**6, 10**6), (0, 10**6), (0, 300)])
def test_the_best_near_matches_are_found(spark, held, block):
    mine, refs = texts_of(1, 60), texts_of(1, 60)[::2] + texts_of(2, 30)
    rows = spark.createDataFrame([(t, i) for i, t in enumerate([*mine, *mine[:9], None])], "norm string, k long").repartition(4)
    ref = spark.createDataFrame([(t,) for t in [*refs, *refs[:5], None]], "norm string").repartition(3)
    found = nearjoin.near_best(rows, ref, 0.88, 8, overlap.common_subsequence, overlap.sequence_ratio, held, block).collect()
    want = {}
    for a in set(mine):
        for b in set(refs) - {a}:
            if abs(len(a) - len(b)) <= max(8, int(max(len(a), len(b)) * 0.4)) and (q := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= 0.88:
                want.setdefault(a, []).append((round(q, 9), b))
    got = {}
    for r in found:
        got.setdefault(r.k, []).append((round(r.similarity, 9), r.ref_norm))
    assert {k: sorted(x for x in v if x[0] == max(v)[0]) for k, v in got.items()} == {k: sorted(x for x in want[t] if x[0] == max(want[t])[0]) for k, t in enumerate([*mine, *mine[:9]]) if t in want}
    assert len(got) > 40


def test_a_bound_that_never_errs():
    rng = random.Random(3)
    for t in rng.sample(texts_of(4, 80), 150):
        for u in rng.sample(texts_of(4, 80), 40):
            if t != u and SequenceMatcher(None, t, u, autojunk=False).ratio() >= 0.88:
                _, h, n = nearjoin.trigrams([t, u])
                first = h[: max(n[0] - 2, 0)].tolist()
                assert len(set(first) & set(h[len(first) :].tolist())) >= max(1, nearjoin.least_shared(n.sum(), 0.88) - 1e-6)


def test_empty_sides_and_low_thresholds(spark):
    one, none = spark.createDataFrame([("abcdefghijkl",)], "norm string"), spark.createDataFrame([], "norm string")
    score = (overlap.common_subsequence, overlap.sequence_ratio)
    for a, b in ((one, none), (none, one)):
        for held in (0, 100):
            assert nearjoin.near_best(a, b, 0.88, 8, *score, held).count() == 0
    with pytest.raises(ValueError, match="common trigram"):
        nearjoin.near_best(one, one, 0.8, 8, *score)


def test_near_matches_never_reach_the_driver():
    import inspect

    source = inspect.getsource(overlap)
    assert "toLocalIterator" not in source and "createDataFrame" not in source


def brute(a, refs):
    a = "".join(a.split())
    most = 0
    for r in refs:
        r = "".join(r.split())
        while most < min(len(a), len(r)) and any(a[i : i + most + 1] in r for i in range(len(a) - most)):
            most += 1
    return most


@pytest.mark.parametrize("held,block", [(10**6, 10**6), (0, 60), (0, 10**6)])
def test_the_longest_common_substring_of_any_length(spark, held, block):
    rng = random.Random(5)
    refs = ["".join(rng.choices("abcd 日\n", k=rng.randint(0, 40))) for _ in range(25)] + ["z", "", "the longest of them all " * 4]
    rows = [(i, "".join(rng.choices("abcdx 日", k=rng.randint(0, 40)))) for i in range(150)]
    rows += [(200 + i, "xx" + r[3 : 3 + rng.randint(0, 30)] + "yy" + r) for i, r in enumerate(refs)]
    rows += [(300, None), (301, ""), (302, "QQQ"), (303, "t" * 30_000 + refs[-1]), (7, "abcdabcd"), (None, refs[0])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "k long, text string, longest int").repartition(4)
    got = {r.k: r.longest for r in commonsub.longest_common(df, spark.createDataFrame([(r,) for r in [*refs, None]], "text string"), "k", held=held, block=block).collect()}
    want = {}
    for k, t in rows:
        want[k] = max(want.get(k, 0), brute(t or "", refs))
    assert got == want and len({v for v in got.values()}) > 10


def test_no_reference_and_no_rows(spark):
    some, none = spark.createDataFrame([(1, "abc")], "k long, text string"), spark.createDataFrame([], "k long, text string")
    assert [tuple(r) for r in commonsub.longest_common(some, none, "k").collect()] == [(1, 0)]
    assert commonsub.longest_common(none, some, "k").count() == 0
