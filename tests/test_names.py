"""Names in texts, and segmentation by a dictionary, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import lattice, names, retrieval


def rows_of(seed, n=300):
    rng = random.Random(seed)
    some = ["".join(rng.choices("ab林é", k=rng.randint(1, 6))) for _ in range(150)]
    rows = [(i, "".join(rng.choices("ab林é ", k=rng.randint(0, 60)))) for i in range(n)]
    return [(-1, None), (-2, ""), (-3, "aaaaa"), (-3, "aaaaa"), (None, "bb" * 20_000), *rows], [*some, "aa", "aa", "", None, "zz", "😀b"]


@pytest.mark.parametrize("held,block", [(10**6, 10**6), (0, 100), (0, 10**6)])
def test_names_equal_a_search_for_each(spark, held, block):
    rows, known = rows_of(1)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "k long, t string, item string").repartition(3)
    out = names.occurring(df, "t", spark.createDataFrame([(n,) for n in known], "name string"), "name", held, block)
    got = sorted(((r.k, r.name, r.freq, r.item) for r in out.collect()), key=str)
    want = [(k, n, t.count(n), "x") for k, t in rows for n in {x for x in known if x} if t and n in t]
    assert got == sorted(want, key=str) and len(got) > 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_empty_tables(spark):
    df, none = spark.createDataFrame([(1, "a")], "k long, t string"), spark.createDataFrame([], "name string")
    for held in (0, 100):
        assert names.occurring(df, "t", none, "name", held).count() == 0
        assert names.occurring(df.limit(0), "t", spark.createDataFrame([("a",)], "name string"), "name", held).count() == 0


def test_entities_with_a_second_tier(spark):
    ctx = spark.createDataFrame([(1, "moon lake moon the the lake owl x"), (2, "none")], "k long, text string")
    cards, others = (spark.createDataFrame([(n,) for n in x], "name string") for x in (["lake", "owl"], ["moon", "the", "x", "owl"]))
    got = [(r.ord, r.name, r.freq) for r in retrieval.entities(ctx, cards, "k", others=others, stop=("the",)).orderBy("ord").collect()]
    assert got == [(1, "lake", 2), (2, "moon", 2), (3, "owl", 1)]


def best_path(text, weights, whole=True):
    """Every way to cut, by recursion."""
    total = math.log(sum(weights.values()))
    runs = {i: m.end() for m in lattice._RUN.finditer(text) if whole for i in range(*m.span())}

    def ways(i):
        if i == len(text):
            yield 0.0, []
            return
        ends = {runs.get(i, i + 1): 1.0} | {i + len(w): x for w, x in weights.items() if text.startswith(w, i)}
        for end in ends:
            for score, rest in ways(end):
                yield score + math.log(ends[end]) - total, [text[i:end], *rest]

    return max(ways(0), key=lambda x: x[0])


def test_the_best_path_equals_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        weights = {"".join(rng.choices("山水人a", k=rng.randint(1, 4))): float(rng.randint(1, 50)) for _ in range(12)}
        text = "".join(rng.choices("山水人a ", k=rng.randint(0, 9)))
        for whole in (True, False):
            cut = lattice.Lattice(weights, whole).cut(text)
            score, _ = best_path(text, weights, whole)
            total = math.log(sum(weights.values()))
            own = sum(math.log(weights.get(w, 1.0)) - total for w in cut)
            assert "".join(cut) == text and abs(own - score) < 1e-9


def test_ambiguous_strings_and_names(spark):
    words = spark.createDataFrame([("研究", 50.0), ("研究生", 40.0), ("生命", 60.0), ("命", 3.0), ("起源", 30.0), ("skip", 0.0), ("", 9.0)], "word string, weight double")
    plain = lattice.Lattice(lattice.weights_of(words, None))
    assert plain.cut("研究生命起源") == ["研究", "生命", "起源"] and plain.cut("word2 研究") == ["word2", " ", "研究"]
    named = lattice.weights_of(words, spark.createDataFrame([("生命起",)], "name string"))
    assert named["生命起"] == 10_000 and lattice.Lattice(named).cut("研究生命起源") == ["研究", "生命起", "源"]
    tokens = lattice.dictionary_tokens(named, spark.sparkContext)
    df = spark.createDataFrame([(1, "研究 生命起 X Word"), (2, None), (3, "")], "k long, text string")
    assert [r.t for r in df.orderBy("k").select(tokens(F.col("text")).alias("t")).collect()] == [["研究", "生命起", "word"], [], []]
    cards = spark.createDataFrame([(1, "研究 起源 起源"), (2, "生命起 word"), (3, "other thing"), (4, "more of it"), (5, "nothing here")], "doc_ord long, text string")
    hits = retrieval.bm25_topk(spark.createDataFrame([("q", "生命起源")], "q string, text string"), cards, "q", "doc_ord", 2, tokens=tokens).collect()
    assert [r.doc_ord for r in hits] == [2]


def test_an_oversized_dictionary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MOST", 3)
    with pytest.raises(ValueError, match="characters"):
        lattice.weights_of(spark.createDataFrame([("abcd", 1.0)], "word string, weight double"), None)


def test_grep_of_a_name_that_is_in_every_line(spark):
    raw = spark.createDataFrame([(f"p{i}", "\n".join(f"moon {i} {k}" for k in range(40))) for i in range(20)], "path string, text string")
    cards = spark.createDataFrame([(1, "moon", "moon text", 0, 0, 0, None)], "doc_ord long, source string, text string, depth_class int, revealed_in int, valid_from int, valid_to int")
    ctx = spark.createDataFrame([(str(i), "by the moon", 5) for i in range(10)], "k string, text string, at int")
    out = retrieval.retrieve(ctx, cards, raw, "k").collect()
    assert len(out) == 10 and all(r.grep == ["moon 0 0\nmoon 0 1\nmoon 0 2", "moon 0 0\nmoon 0 1\nmoon 0 2\nmoon 0 3"] for r in out)
