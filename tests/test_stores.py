"""The stored text index and the fact store against what they replace, and against batches that fail half way."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.operators import facts, factstore, retrieval, textindex

DOC = "doc_id long, text string, doc string, block string"


def texts(seed, n, start=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    out = []
    for i in range(start, start + n):
        t = rng.choices(words, weights, k=rng.randint(0, 40))
        if i % 97 == 5:
            t += ["rare", "pearl", "rare", "pearl", "diver"]
        out.append((i, " ".join(t), "clash", "clash"))
    return out


def best(rows, asked, k):
    """Plain BM25 over all rows."""
    toks = {i: (t or "").split() for i, t, *_ in rows}
    n, avgdl = len(toks), sum(map(len, toks.values())) / sum(t is not None for _, t, *_ in rows)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in asked:
        got = []
        for i, t in toks.items():
            tf = Counter(t)
            s = sum((eps if raw[w] < 0 else raw[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in text.split() if w in tf)
            if round(s, 9) > 0:
                got.append((-round(s, 9), i))
        out[q] = [i for _, i in sorted(got)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    return texts(1, 1500) + [(5000 + i, "w1 w2 w3 rare", "", None) for i in range(200)] + [(9000, None, None, None), (9001, "", None, None), (9002, "w7 " * 20000 + "abyss", None, None)]


ASKED = [(1, "rare diver"), (2, "w0 w1 w59"), (3, "w3 w3 w3 pearl"), (4, "unknown"), (5, ""), (6, None), (7, "abyss w7"), (8, "w0")]


def test_blocks_that_are_skipped_change_nothing(spark, tmp_path, rows):
    path = f"file://{tmp_path}/ix"
    frame = spark.createDataFrame(rows, DOC)
    queries = spark.createDataFrame(ASKED, "q long, text string")
    textindex.append(frame.where("doc_id < 700"), path, "doc_id")
    textindex.append(frame.where("doc_id < 0"), path, "doc_id")  # an empty append
    textindex.append(frame.where("doc_id >= 700"), path, "doc_id")
    hits, blocks = textindex.searched(queries, path, "q", 7)
    got = {}
    for r in hits.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.doc, r.score))
    plain = retrieval.bm25_topk(queries, frame.select("doc_id", "text"), "q", "doc_id", 7).orderBy("q", "rank").collect()
    full = {}
    for r in plain:
        full.setdefault(r.q, []).append((r.doc_id, r.score))
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in full.items()}
    assert all(abs(a - b) < 1e-8 for q in got for (_, a), (_, b) in zip(got[q], full[q], strict=True))
    assert {q: [d for d, _ in got.get(q, [])] for q, _ in ASKED} == best(rows, [(q, t or "") for q, t in ASKED], 7)
    n = blocks.groupBy("q").agg(F.count("*").alias("all"), F.sum(F.col("scored").cast("int")).alias("scored")).collect()
    assert sum(r.scored for r in n) < sum(r["all"] for r in n)
    assert {r.q: r.scored < r["all"] for r in n}[3]
    before = {(r.q, r.doc, r["rank"]) for r in hits.collect()}
    textindex.compact(spark, path)
    assert [p for p in os.listdir(f"{tmp_path}/ix") if p.startswith("segment=")] == ["segment=1-3"]
    assert {(r.q, r.doc, r["rank"]) for r in textindex.topk(queries, path, "q", 7).collect()} == before


def test_an_append_cut_short_is_not_seen(spark, tmp_path, rows):
    path = f"file://{tmp_path}/ix"
    frame = spark.createDataFrame(rows[:300], DOC)
    textindex.append(frame, path, "doc_id")
    queries = spark.createDataFrame(ASKED, "q long, text string")
    want = sorted(map(tuple, textindex.topk(queries, path, "q", 3).collect()))
    folder = textindex.append(spark.createDataFrame(rows[300:400], DOC), path, "doc_id")
    os.remove(f"{folder.removeprefix('file://')}/stats/_SUCCESS")
    assert sorted(map(tuple, textindex.topk(queries, path, "q", 3).collect())) == want
    textindex.append(spark.createDataFrame(rows[300:400], DOC), path, "doc_id")  # again, under a new number
    full = retrieval.bm25_topk(queries, spark.createDataFrame(rows[:400], DOC).select("doc_id", "text"), "q", "doc_id", 3)
    assert {(r.q, r.doc, r["rank"]) for r in textindex.topk(queries, path, "q", 3).collect()} == {(r.q, r.doc_id, r["rank"]) for r in full.collect()}
    with pytest.raises(FileNotFoundError):
        textindex.topk(queries, f"file://{tmp_path}/none", "q", 3)


def test_phrases_are_found_at_every_place(spark, tmp_path, rows):
    path = f"file://{tmp_path}/ix"
    textindex.append(spark.createDataFrame(rows, DOC), path, "doc_id")
    asked = [(1, "rare pearl"), (2, "w0 w0 w0"), (3, "pearl rare pearl"), (4, "w2 w1"), (5, ""), (6, None), (7, "w7 abyss")]
    got = {tuple(r) for r in textindex.phrases(spark.createDataFrame(asked, "q long, text string"), path, "q").collect()}
    want = set()
    for q, t in asked:
        p = (t or "").split()
        for i, text, *_ in rows:
            words = (text or "").split()
            want |= {(q, i, k) for k in range(len(words)) if p and words[k : k + len(p)] == p}
    assert got == want and want


FACT = "id string, title string, chapter int, created_at string"


def batches(seed):
    rng = random.Random(seed)
    return [[(f"f{rng.randint(0, 60)}", rng.choice("abc"), rng.randint(1, 9), f"{b}-{k}", k) for k in range(n)] for b, n in enumerate((40, 3, 0, 25))]


def test_batches_end_in_the_full_upsert(spark, tmp_path):
    path, schema = f"file://{tmp_path}/st", spark.createDataFrame([], FACT).schema
    whole = spark.createDataFrame([], FACT)
    for k, b in enumerate(batches(4)):
        batch = spark.createDataFrame(b, FACT + ", ord int")
        before = factstore.manifest(spark, path)
        factstore.upsert(path, batch, "ord", schema, buckets=16)
        whole = spark.createDataFrame(facts.upsert(whole, batch, "ord").select(*schema.names).collect(), schema)
        assert sorted(map(tuple, factstore.read(spark, path, schema).collect())) == sorted(map(tuple, whole.collect()))
        after = factstore.manifest(spark, path)
        if k == 1:  # at most three buckets are rewritten, all others stay where they were
            assert 1 <= sum(before[i] != after[i] for i in after) <= 3
        if k == 2:
            assert before == after
    assert factstore.versions(spark, path) == [1, 2, 3]
    assert factstore.read(spark, path, schema, 1).count() == len({r[0] for r in batches(4)[0]})
    with pytest.raises(ValueError):
        factstore.read(spark, path, schema, 9)
    factstore.vacuum(spark, path)
    assert sorted(map(tuple, factstore.read(spark, path, schema).collect())) == sorted(map(tuple, whole.collect()))


def test_a_batch_cut_short_changes_nothing(spark, tmp_path):
    path, schema = f"file://{tmp_path}/st", spark.createDataFrame([], FACT).schema
    one, two = (spark.createDataFrame(b, FACT + ", ord int") for b in batches(5)[:2])
    factstore.upsert(path, one, "ord", schema)
    want = sorted(map(tuple, factstore.read(spark, path, schema).collect()))
    factstore.upsert(path, two, "ord", schema)
    done = sorted(map(tuple, factstore.read(spark, path, schema).collect()))
    os.remove(f"{tmp_path}/st/version=2/manifest/_SUCCESS")
    assert sorted(map(tuple, factstore.read(spark, path, schema).collect())) == want
    factstore.upsert(path, two, "ord", schema)
    assert sorted(map(tuple, factstore.read(spark, path, schema).collect())) == done


def test_states_close_where_the_next_begins(spark, tmp_path):
    path, kind = f"file://{tmp_path}/hs", "id string, subject string, mood string, valid_from int, valid_to int"
    schema = spark.createDataFrame([], kind).schema
    first = [("a1", "ann", "calm", 1, None), ("a3", "ann", "angry", 9, None), ("b1", "bo", "shy", 2, 4), ("n", None, "lost", 3, None), ("u", "bo", "vague", None, None)]
    second = [("a2", "ann", "sad", 5, None), ("a2", "ann", "sad", 5, None), ("a1", "ann", "rewritten", 1, None), ("b2", "bo", "bold", 4, None), ("b3", "bo", "glad", 4, 7)]
    factstore.add_states(path, spark.createDataFrame(first, schema), "subject", schema)
    assert {(r.id, r.valid_to) for r in factstore.read(spark, path, schema).collect()} == {("a1", 8), ("a3", None), ("b1", 4), ("n", None), ("u", None)}
    factstore.add_states(path, spark.createDataFrame(second, schema), "subject", schema)
    got = {(r.id, r.mood, r.valid_from, r.valid_to) for r in factstore.read(spark, path, schema).collect()}
    assert got == {("a1", "calm", 1, 4), ("a2", "sad", 5, 8), ("a3", "angry", 9, None), ("b1", "shy", 2, 3), ("b2", "bold", 4, None), ("b3", "glad", 4, 7), ("n", "lost", 3, None), ("u", "vague", None, None)}


def test_a_task_hands_on_only_the_best_of_a_query(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ix"
    frame = spark.createDataFrame([(i, f"w0 w{i % 7} w{i % 11}") for i in range(3000)], "doc_id long, text string")
    textindex.append(frame, path, "doc_id")
    kept = {}

    def settle(df, at):
        kept[at.rsplit("/", 1)[1]] = df
        return textindex_settle(df, at)

    textindex_settle = textindex.settle
    monkeypatch.setattr(textindex, "settle", settle)
    got = textindex.topk(spark.createDataFrame([(q, f"w{q} w3") for q in range(5)], "q long, text string"), path, "q", 4).collect()
    assert len(got) == 20
    for name in ("first", "rest"):
        assert kept[name].groupBy("q").count().where("count > 4").isEmpty()
        plan = kept[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "WindowGroupLimit" in plan


def test_the_postings_of_a_block_are_in_one_file(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    folder = textindex.append(spark.createDataFrame(texts(7, 1000), DOC), path, "doc_id")
    files = spark.read.parquet(f"{folder}/postings").select("block", F.input_file_name().alias("file")).distinct().groupBy("block").agg(F.count("*").alias("n"))
    assert files.where("n > 1").isEmpty() and files.count() >= 1000 // textindex.DOCS_PER_BLOCK
