"""Segmentation by a dictionary that tasks don't hold."""

import random
from collections import Counter

from quillmill.operators import lattice
from quillmill.plans import registry


def test_a_dictionary_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lattice, "MOST", 5)
    rng = random.Random(3)
    words = ["ab", "abc", "b", "ca", "cab", "山", "山川", "川", "é"]
    docs = [" ".join(rng.choices(words, k=30)) for _ in range(20)]
    asked = [" ".join(rng.choices([*words, "x1"], k=rng.randint(1, 12))) for _ in range(30)] + ["", None, "1 2", "ab"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: r.cut for r in registry.QUERIES["dictionary_cuts"](spark, str(tmp_path)).collect()}
    whole = lattice.Lattice(dict(Counter(w for d in docs for w in d.split())), runs=False)
    assert got == {i: " ".join(whole.cut((t or "").replace(" ", ""))) for i, t in enumerate(asked)}


def test_names_and_sides_that_are_empty(spark):
    rows = spark.createDataFrame([(1, "annabel lee"), (2, None)], "k long, text string")
    names = spark.createDataFrame([("anna",), ("bel",)], "name string")
    cut = lambda **kw: {r.k: r.tokens for r in lattice.cut_texts(rows, "text", **kw).collect()}
    assert cut(words=None, names=names, runs=False, least=3) == {1: ["anna", "bel"], 2: []}
    assert cut(words=None) == {1: ["annabel", "lee"], 2: []}
    assert lattice.cut_texts(rows.limit(0), "text", None, names).collect() == []
