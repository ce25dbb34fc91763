import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from pyspark.sql import functions as F

from quillmill.llm import langid
from quillmill.llm.langid import EVIDENCE, LONGEST, Model, fit, held_out, predict

SYLL = {"aa": ["ka", "to", "mi", "ru"], "bb": ["schw", "ung", "ber", "ein"], "cc": ["eau", "oux", "tre", "é"]}


def corpus(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLL))
        words = ["".join(rng.choices(SYLL[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(words).title(), lang, "s"))
    return rows


def test_held_out_accuracy_and_contract(spark):
    rows = corpus(600) + [(None, "ka to", "aa", "s"), (9001, None, "aa", "s"), (9002, "123 !!", "bb", "s"), (9003, "", None, "s"), (9004, "katomi " * 50000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = predict(df, fit(df)).withColumn("held_out", held_out("doc_id")).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    good = [r for r in held if r.doc_id < 9000]
    assert sum(r.lang_pred == r.lang for r in good) >= 0.99 * len(good)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_teach_nothing(spark):
    df = spark.createDataFrame(corpus(300), "doc_id long, text string, lang string, source string")
    other = df.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, predict(other, fit(other)).select("doc_id", "lang_pred", "score").collect())) == sorted(map(tuple, predict(df, fit(df)).select("doc_id", "lang_pred", "score").collect()))


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert predict(df, fit(df)).first().lang_pred == "und"
    assert predict(df.limit(0), fit(df.limit(0))).count() == 0


def test_a_long_word_counts_whole():
    model = Model([("k", "aa", 9), ("s", "bb", 9)], longest=1)
    lang, _ = model.predict(pa.array(["k" * 300 + "s" * 30_000, "k" * 30_000 + "s" * 300]))
    assert lang == ["bb", "aa"]


def brute(counts, texts):
    """The backoff in plain Python."""
    langs = sorted({x for _, x, _ in counts})

    def table(rows):
        c = {}
        for key, x, n in rows:
            c.setdefault(key, dict.fromkeys(langs, 0.5))[x] += n
        all_ = {x: sum(r[x] for r in c.values()) for x in langs}
        return {k: [math.log(r[x] / all_[x]) for x in langs] for k, r in c.items()}

    words = table(counts)
    grams = [table([(f"^{w}$"[i : i + n], x, k) for w, x, k in counts for i in range(len(w) + 3 - n)]) for n in range(1, LONGEST + 1)]
    out = []
    for t in texts:
        total, found = [0.0] * len(langs), Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
        for w, n in found.items():
            row = words.get(w)
            for k in range(LONGEST, 0, -1):
                hits = [g for i in range(len(w) + 3 - k) if (g := grams[k - 1].get(f"^{w}$"[i : i + k]))]
                if row is None and hits:
                    row = [sum(c) / len(hits) for c in zip(*hits, strict=True)]
            total = [a + n * b for a, b in zip(total, row or [0.0] * len(langs), strict=True)]
        e = [math.exp((a - max(total)) * min(1.0, EVIDENCE / max(1, found.total()))) for a in total]
        out.append((langs[e.index(max(e))], max(e) / sum(e)) if found else ("und", 0.0))
    return out


def test_backoff_matches_brute_force(monkeypatch):
    rng = random.Random(8)
    counts = Counter()
    for _ in range(300):
        lang = rng.choice(list(SYLL))
        counts["".join(rng.choices(SYLL[lang], k=rng.randint(1, 3))), lang] += rng.randint(1, 5)
    counts = [(w, x, n) for (w, x), n in counts.items()]
    texts = [None, "", "42", "Kato KATO kato", "zzzzqq", "x", "schwung-berein, eau2tre"] + ["_".join(rng.choices([w for w, *_ in counts], k=3) + ["".join(rng.choices("katomirueschwg", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]) for _ in range(200)]
    want = brute(counts, texts)
    for step in (langid.STEP, 7):
        monkeypatch.setattr(langid, "STEP", step)
        lang, score = Model(counts).predict(pa.array(texts))
        assert [x for x, _ in want] == lang and max(abs(a - b) for (_, a), b in zip(want, score, strict=True)) < 1e-9


def test_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "same", "bb", 7.0, "k"), (2, "same", "aa", 8.0, "k"), (3, "same", None, 9.0, "k"), (3, "same", None, 9.0, "k"), (6, "same", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    out = predict(df, Model([("same", "bb", 1), ("same", "aa", 1)]))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert [(r.lang_pred, r.score) for r in out.collect()] == [("aa", 0.5)] * 5
