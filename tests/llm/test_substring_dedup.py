import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from quillmill.llm import common, substring_dedup as module
from quillmill.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, anchor string").repartition(3)
    assert sorted((tuple(r) for r in substring_dedup(df).collect()), key=str) == brute(rows, 35)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passages = [rng.choices(words, k=k) for k in (34, 35, 36, 60, 90)]
    rows = [(None, None), (1, ""), (2, "a " * 200), (3, "x y z " * 30), (4, " ".join(words[:34])), (5, "a\tb\n" * 16 + "c é ü"), (5, "a\tb\n" * 16 + "c é ü")]
    for i in range(150):
        w = rng.choices(words, k=rng.randint(1, 150))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages)
        rows.append((100 + i, " ".join(w)))
    rows += rows[20:26]
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).count() == 0


FULL = SimpleNamespace(value=np.full(common.BLOOM_BITS // 8, 255, np.uint8))


def batch_of(texts):
    return pa.RecordBatch.from_pydict({"t1": pa.array(range(len(texts)), pa.int64()), "t2": pa.array(range(len(texts)), pa.int64()), "text": texts})


def found_in(batches):
    """(text, window) of all that the two steps find, each batch a task's."""
    sent = [b for x in batches for b in module._segments(35, FULL)([x])]
    t = pa.Table.from_batches(sent)
    asked = t.filter(pa.compute.is_valid(t.column("anchor"))).sort_by("anchor")
    rows = [(r["t1"], r["words"]) for r in t.to_pylist() if r["anchor"] is None]
    for b in module._look_up(35)(asked.to_batches()):
        rows += [(r["t1"], r["ranges"]) for r in b.to_pylist()]
    return sorted({(i, w) for i, raw in rows for a, b in np.frombuffer(raw, np.int32).reshape(-1, 2).tolist() for w in range(a, b)})


def test_words_that_share_40_bits_are_not_equal(monkeypatch):
    hashes = lambda texts, lower: (np.concatenate([(np.arange(36, dtype=np.uint64) + np.uint64(5)) | (np.uint64(1 + int(t[1:2]) * (i == 20)) << np.uint64(40)) for t in texts for i in [20]]), np.arange(len(texts) + 1) * 36)
    monkeypatch.setattr(module, "word_hashes", hashes)
    monkeypatch.setattr(module, "anchors", lambda w, n: np.full(len(w) - n + 1, 7, np.uint64))
    texts = [" ".join([f"x{c}"] * 36) for c in (1, 2)]
    assert found_in([batch_of(texts)]) == [] and found_in([batch_of(texts[:1]), batch_of(texts[1:])]) == []
    same = [texts[0], texts[0] + " "]
    assert len(found_in([batch_of(same)])) == 4


def cases():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    passages = [rng.choices(words, k=k) for k in (35, 36, 60, 120)]
    texts = []
    for _ in range(40):
        w = rng.choices(words, k=rng.randint(1, 60))
        for p in rng.sample(passages, 2):
            cut = rng.randint(0, len(p) - 35)
            w += p[cut : cut + rng.randint(30, len(p))]
        texts.append(" ".join(w))
    return texts


def windows_of(texts):
    all_ = [(i, k, tuple(w[k : k + 35])) for i, t in enumerate(texts) for w in [t.split()] for k in range(len(w) - 34)]
    n = Counter(x[2] for x in all_)
    return [(i, k) for i, k, w in all_ if n[w] > 1]


def test_blocks_find_every_repeated_window_and_no_other(monkeypatch):
    texts = cases()
    whole = batch_of(texts)
    for size in (1 << 18, 500):
        monkeypatch.setattr(module, "BLOCK", size)
        assert found_in([whole]) == windows_of(texts)
        assert found_in([whole.slice(i, 7) for i in range(0, 40, 7)]) == windows_of(texts)


def test_without_the_parse_nothing_is_found(monkeypatch):
    texts, none = cases(), np.zeros(0, np.int64)
    assert found_in([batch_of(texts)])
    monkeypatch.setattr(module, "factorise", lambda block: (none, none, none, np.zeros(len(block.words), np.int64)))
    assert found_in([batch_of(texts)]) == [] and found_in([batch_of(texts[:20]), batch_of(texts[20:])]) == []


def test_what_straddles_a_factor_is_looked_up():
    """Every window of the first segment is repeated, in one of two others, but its greedy factors are 40 and 30 words."""
    a = list(range(70))
    segs = [a, [900, *a[:40], 901], [902, *a[20:], 903]]
    block = module.Block(np.array([x for s in segs for x in s], np.uint64), np.repeat([0, 1, 2], [len(s) for s in segs]))
    place, size, _, _ = module.factorise(block)
    assert list(zip(place.tolist(), size.tolist(), strict=True))[:2] == [(0, 40), (40, 30)]
    hit = module.repeated(block, 35).tolist()
    assert [k for k in hit if k < 70] == [*range(6), *range(20, 36)]


def test_a_hot_anchor_is_split_and_loses_nothing(spark):
    rng = random.Random(9)
    words, phrase = [f"w{i}" for i in range(500)], [f"p{i}" for i in range(20)]
    passage = rng.choices(words, k=50)
    rows = []
    for i in range(60):
        w = rng.choices(words, k=30) + phrase + rng.choices(words, k=30)
        rows.append((i, " ".join(w + passage if i % 3 == 0 else w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in substring_dedup(df, hot=2).collect()), key=str) == brute(rows, 35)


def test_factors_are_the_longest_matches_and_leave_no_repeat_uncovered():
    rng = random.Random(3)
    for _ in range(60):
        segs = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 6))]
        flat, seg = [x for s in segs for x in s], [k for k, s in enumerate(segs) for _ in s]
        place, length, source, longest = (x.tolist() for x in module.factorise(module.Block(np.array(flat, np.uint64), np.array(seg))))

        def piece(i, n):
            return tuple(flat[i : i + n]) if i + n <= len(flat) and seg[i] == seg[i + n - 1] else None

        def repeats(i, n):
            return piece(i, n) is not None and any(piece(j, n) == piece(i, n) for j in range(len(flat)) if j != i)

        held = set()
        for i, n, j in zip(place, length, source, strict=True):
            assert j != i and piece(j, n) == piece(i, n) and not repeats(i, n + 1)
            assert not held & set(range(i, i + n))
            held |= set(range(i, i + n))
        assert held == {i for i in range(len(flat)) if repeats(i, 1)}
        assert all((not m or repeats(i, m)) and not repeats(i, m + 1) for i, m in enumerate(longest))


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(50_000)]
    long = rng.choices(words, k=60_000)
    long[50_000:50_000] = long[10:300]
    rows = [(1, " ".join(long)), (2, " ".join(long[500:560])), (3, "z " * 5000)]
    check(spark, rows)
