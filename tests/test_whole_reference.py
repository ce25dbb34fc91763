"""Candidates against a whole reference: counts of grams, and the work that a sentence costs."""

import random

import pytest

from quillmill.operators import commonsub, nearjoin, overlap


@pytest.mark.parametrize("held,block", [(10**6, 10**6), (0, 400)])
def test_grams_of_all_lengths_are_counted_in_one_pass(spark, held, block):
    rng = random.Random(5)
    ref = ["".join(rng.choices("ab日", k=n)) for n in (0, 3, 4, 40, 60)]
    cand = [(i % 9, t) for i, t in enumerate([*["".join(rng.choices("ab日", k=rng.randint(0, 50))) for _ in range(40)], None, ref[3] * 2])]
    got = commonsub.gram_counts(spark.createDataFrame(cand, "k long, text string").repartition(3), spark.createDataFrame([(t,) for t in [*ref, None]], "text string"), "k", "text", (4, 7), held, block).collect()
    for r in got:
        for n in (4, 7):
            own = [t[i : i + n] for k, t in cand if k == r.k and t for i in range(len(t) - n + 1)]
            have = {t[i : i + n] for t in ref for i in range(len(t) - n + 1)}
            assert (r[f"total{n}"], r[f"matched{n}"]) == (len(own), sum(g in have for g in own))
    assert len(got) == 9


def test_pieces_whose_hashes_agree_are_compared_as_text(monkeypatch):
    monkeypatch.setattr(commonsub, "_hash", lambda sums, at, size: at.astype("uint64") * 0 + size)
    assert commonsub.longest_match(commonsub.Block(["abcdefghij"]), "klmnopqrst") <= 4
    assert commonsub.Grams(["abcdef"], (6,)).count("xyzxyzabcdef") == [1]


def test_sentences_that_repeat_are_sought_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(overlap, "near_best", lambda rows, *a: (asked.append(rows.count()), nearjoin.near_best(rows, *a))[1])
    from quillmill.operators.metrics import segmented

    near = "the quick brown fox jumps over the lazy dog tonight"
    cand = spark.createDataFrame([(i, f"{near}. something else that matches nothing at all {i % 2}.") for i in range(20)] + [(20, None)], "doc_id long, text string")
    ref = spark.createDataFrame([(1, "the quick brown fox jumped over the lazy dog tonight.")], "doc_id long, text string")
    got = {r.doc_id: r for r in overlap.contamination_whole(segmented(ref, "doc_id"), segmented(cand, "doc_id"), "doc_id").collect()}
    assert asked == [3]
    assert len(got) == 21 and all(got[i].near_count == 1 and got[i].near_ratio == 0.5 for i in range(20)) and got[20].near_count == 0


def test_counting_of_shared_trigrams_is_bounded(monkeypatch):
    rng = random.Random(6)
    refs = ["".join(rng.choices("abcd", k=30)) for _ in range(50)]
    texts = [t[:-1] + "z" for t in refs]
    index = nearjoin.Inverted(refs, 0.88, overlap.common_subsequence, overlap.sequence_ratio)
    whole = index.best(texts)
    monkeypatch.setattr(nearjoin, "CELLS", 60)
    assert index.best(texts) == whole and all(q > 0.9 for q, _ in whole)
