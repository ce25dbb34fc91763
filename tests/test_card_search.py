"""Card searches: what BM25 finds is cut to its best before it meets the cards that names bring."""

import random

from pyspark.sql import functions as F

from quillmill.operators import retrieval


def tables(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    cards = [(i, f"n{i % 6}" + ("-x" if i % 4 == 0 else ""), " ".join(rng.choices(words, k=12)), i % 3, i % 4, i % 2, None if i % 3 else 6) for i in range(30)]
    queries = [(i, " ".join(rng.choices(words, k=4)), i % 9 if i % 5 else None) for i in range(40)]
    found = [(i, f"n{(i + j) % 6}", j + 1) for i in range(0, 40, 2) for j in range(3)]
    return (
        spark.createDataFrame(queries, "q long, text string, at int"),
        spark.createDataFrame(found, "q long, name string, ord int"),
        spark.createDataFrame(cards, "doc_ord long, source string, text string, depth_class int, revealed_in int, valid_from int, valid_to int"),
    )


def test_few_go_on_and_nothing_is_lost(spark):
    queries, found, cards = tables(spark)
    k = 3
    out = retrieval.search_cards(queries, found, cards, "q", k)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Union") :]  # scores are cut before the union
    got = {}
    for r in out.collect():
        got.setdefault(r.q, []).append((r["rank"], r.doc_ord, r.text))
    score = {(r.q, r.doc_ord): r.s for r in retrieval.bm25(queries, cards, "q", "doc_ord").select("q", "doc_ord", F.bround("score", 4).alias("s")).collect()}
    names, own = {}, {r.doc_ord: r for r in cards.collect()}
    for r in found.collect():
        names.setdefault(r.q, []).append((r.ord, r.name))
    for q in queries.collect():
        rows = []
        for d, c in own.items():
            if q["at"] is not None and not (c.revealed_in <= q["at"] and c.valid_from <= q["at"] and (c.valid_to is None or c.valid_to >= q["at"])):
                continue
            places = [(0, c.depth_class, o, -9999.0) for o, n in names.get(q.q, []) if n == c.source] + [(1, 0, o, -9998.0) for o, n in names.get(q.q, []) if n in c.source and n != c.source]
            places += [(2, 0, 0, -score[q.q, d])] if (q.q, d) in score else []
            if places:
                rows.append((*min(places), d))
        want = [(i + 1, r[-1], own[r[-1]].text) for i, r in enumerate(sorted(rows)[:k])]
        assert sorted(got.get(q.q, [])) == want


def test_dealt_queries_have_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    queries, _, cards = tables(spark)
    plain = {(r.q, r.doc_ord): r.score for r in retrieval.bm25(queries, cards, "q", "doc_ord").collect()}
    dealt = {(r.q, r.doc_ord): r.score for r in retrieval.bm25(queries, cards, "q", "doc_ord", carried=("at",), dealt=True).collect()}
    assert len(plain) > 100 and plain.keys() == dealt.keys() and all(abs(plain[x] - dealt[x]) < 1e-8 for x in plain)
