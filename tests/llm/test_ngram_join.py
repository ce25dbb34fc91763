import random
import re

from pyspark.sql import functions as F

from quillmill.llm import ngram_join
from quillmill.llm.ngram_join import ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                comp[q] = p
    return {(i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def corpus(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "Solo"), (5, "solo"), (6, "a b"), (7, "A  B")]
    base = [rng.choices(words, k=60) for _ in range(8)]
    common = rng.choices(words, k=30)
    for i in range(count):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = rng.choices(words, k=rng.randint(1, 20)) + common
        out.append((100 + i * 3 % 1000 + i, " ".join(w)))
    return out


def test_matches_brute_force(spark):
    rows = corpus(1, 220)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    got = {tuple(r) for r in ngram_jaccard_join(df, n=4, num=85, den=100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_tiles_of_a_split_field_lose_no_link(spark):
    rows = corpus(2, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in ngram_jaccard_join(df, n=5, num=4, den=5, chunk_ngrams=500).collect()}
    assert got == brute(rows, 5, 4, 5)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(7, t), (7, t), (9, t + " "), (None, t)], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(7, 3, 7), (7, 3, 7), (9, 3, 7), (None, 3, 7)], key=str)
    assert ngram_jaccard_join(df.limit(0)).count() == 0


def test_links_are_counted_inside_components(spark):
    rows = corpus(6, 120)
    rows += [(5000 + k, t) for k, (_, t) in enumerate(rows[30:36])]
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    want = {i: sum(bool(x and y) and j != i and 5 * len(x & y) >= 4 * len(x | y) for (j, _), y in zip(rows, sets, strict=True)) for (i, _), x in zip(rows, sets, strict=True)}
    assert max(want.values()) > 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_jaccard_join(df, chunk_ngrams=500, count_links=True).collect()
    assert {r.id: r.n_links for r in out} == want and len(out) == len(rows)


def test_tiles_are_bounded_by_sets_too(spark, monkeypatch):
    """Many sets of few n-grams in one component: no tile holds more pairs than two chunks of sets have."""
    from quillmill.llm import ngram_join

    base = " ".join(f"b{i}" for i in range(40))
    rows = [(i, f"{base} end{i}") for i in range(300)] + [(900, "apart from all of them")]
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 20)
    held, count = spark.sparkContext.accumulator(0), ngram_join._count_links

    def watched(num, den):
        inner = count(num, den)

        def run(t):
            held.add(int(len(set(t.column("s1").to_pylist())) > 100))
            return inner(t)

        return run

    monkeypatch.setattr(ngram_join, "_count_links", watched)
    out = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True).collect()
    assert {r.id: r.n_links for r in out} == {i: 299 for i in range(300)} | {900: 0}
    assert held.value == 0


def test_a_low_threshold_reaches_far_larger_partners(spark):
    words = [f"u{i}" for i in range(144)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:104])), (3, " ".join(words[:76])), (4, "else " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num, den in ((7, 10), (1, 2)):
        assert {tuple(r) for r in ngram_jaccard_join(df, num=num, den=den).collect()} == brute(rows, 5, num, den)


def test_rows_that_share_an_id_are_told_apart(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (2, text("a") + " more"), (9, text("b") + " more"), (9, text("c")), (None, text("d")), (None, text("a"))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, key string")
    out = ngram_jaccard_join(df, text_key=True).join(df.select(F.col("doc_id"), "text", F.xxhash64("text").alias("text_key")).distinct(), "text_key")
    got = sorted(((r.id, r.text, r.component_id) for r in out.where("id <=> doc_id").collect()), key=str)
    want = [(5, rows[0][1], 2), (5, rows[1][1], 5), (2, rows[2][1], 2), (9, rows[3][1], 5), (9, rows[4][1], 9), (None, rows[5][1], None), (None, rows[6][1], 2)]
    assert got == sorted(want, key=str)


def test_near_copies_that_need_the_second_round(spark):
    rng = random.Random(12)
    words, base = [f"w{i}" for i in range(900)], [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w[rng.choice([0, 0, 10]) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in ngram_jaccard_join(df, n=4, num=85, den=100).collect()} == brute(rows, 4, 85, 100)


def test_the_driver_hands_back_memory_between_steps(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ngram_join, "release_driver", calls.append)
    docs = spark.createDataFrame([(i, "a b c d e f g h " + "x" * (i % 2)) for i in range(4)], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_join(docs).count() == 4
    assert len(calls) >= 7
