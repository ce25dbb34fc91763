import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillmill.operators import metrics, overlap
from quillmill.plans import registry


def tables(spark, root, docs, bench):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, text string").write.parquet(f"{root}/conversations.parquet")


def sentences(rng, n, words=("river", "stone", "the", "walks", "over", "quiet", "a", "lantern", "under", "seven")):
    return [" ".join(rng.choices(words, k=rng.randint(3, 14))) + "." for _ in range(n)]


def test_near_overlap_equals_brute_force_over_documents(spark, tmp_path):
    rng = random.Random(3)
    bench = [(i, " ".join(sentences(rng, 3))) for i in range(12)]
    docs = []
    for i in range(60):
        own = sentences(rng, 4)
        s = list(rng.choice(rng.choice(bench)[1].split(". ")).rstrip(".") + ".")
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s) - 1)] = rng.choice("xyz")
        docs.append((i, " ".join([*own, "".join(s)])))
    tables(spark, tmp_path, docs, bench)
    item = lambda rows: overlap.items(metrics.segmented(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id"), "doc_id").collect()
    refs, want = item(bench), set()
    exact, norm = {r.exact for r in refs}, {r.norm for r in refs}
    for c in item(docs):
        if c.visible < 12 or c.exact in exact or c.norm in norm:
            continue
        scored = [(-SequenceMatcher(None, c.norm, r.norm, autojunk=False).ratio(), r.doc_id, r.pos) for r in refs if r.visible >= 12]
        q, k, p = min(scored)
        if -q >= 0.88:
            want.add((c.doc_id, c.pos, k, p, round(-q, 9)))
    got = registry.QUERIES["near_overlap"](spark, str(tmp_path)).withColumn("similarity", F.round("similarity", 9))
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want


def test_contamination_risk_sees_a_passage_in_a_long_document(spark, tmp_path):
    rng = random.Random(4)
    filler = lambda: " ".join(sentences(rng, 40))
    passage = "Every lighthouse keeper of the northern coast writes the weather into a green book at dawn and counts the ships again."
    unbroken = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    bench = [(1, passage), (2, unbroken + " and the rest.")]
    docs = [(1, filler()), (2, f"{filler()}\n\n{passage}\n\n{filler()}"), (3, f"{filler()} {unbroken[:250]} {filler()}"), (4, f"{filler()} {unbroken[:90]} {filler()}"), (5, f"{filler()} {unbroken[:79]} {filler()}"), (6, "")]
    tables(spark, tmp_path, docs, bench)
    got = {r.doc_id: r for r in registry.QUERIES["contamination_risk_whole"](spark, str(tmp_path)).collect()}
    assert {i: r.contamination_risk for i, r in got.items()} == {1: "low", 2: "high", 3: "high", 4: "medium", 5: "low", 6: "low"}
    assert got[2].par_exact == 1 and [got[i].longest for i in (3, 4)] == [250, 90]
