"""The whole chain against a plain Python version of it, on a small fixture."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from test_mixing import tree as budgets

import corpus_pipeline
from quillmill.llm.packing import binary_lengths
from quillmill.llm.tokens import default_path

SYLL = {"de": ["schw", "ung", "ber", "ein"], "en": ["th", "ow", "ing", "ck"], "es": ["ña", "ido", "lla", "que"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epoch string"


def fixture():
    rng = random.Random(11)
    rows = []

    def add(words, lang):
        text = words if words is None else " ".join(words)
        rows.append((len(rows), text, lang, rng.choice(["crawl", "site-0", "site-0", "site-4", "site-12"]), len(text or ""), "clash"))

    for _ in range(160):
        lang = rng.choice(list(SYLL))
        words = ["".join(rng.choices(SYLL[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        add(words, lang)
        if rng.random() < 0.3:  # exact copies, near copies and copies too far off
            for _ in range(rng.randint(1, 4)):
                other = list(words)
                for _ in range(rng.choice([0, 0, 1, 5])):
                    other[rng.randrange(len(other))] = "".join(rng.choices(SYLL[lang], k=3))
                add(other, lang)
        if rng.random() < 0.2:
            add([*words[:25], f"mail{len(rows)}@ex.org", *words[10:20]], lang)
    for odd in (None, [], ["12", "34", "!!"]):
        add(odd, "en")
    return rows


def jaccard_representatives(texts):
    """Ids of least rank in each component of documents whose 5-word shingle sets have similarity 0.8."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i for i in texts if find(i) == i}


def mixed(docs):
    """(doc_id, text) of every row that the mix takes; docs: (doc_id, text, lang, source)."""
    per = {}
    for i, t, lang, source in docs:
        n = int(m[0]) if (m := re.search(r"[0-9]{1,6}$", source)) else -1
        domain = "crawl" if n < 1 else "web" if n < 10 else "curated"
        per.setdefault((domain, lang, source), []).append((i, t, len(t.split())))
    leaves = [(*k, sum(n for *_, n in v)) for k, v in sorted(per.items())]
    weight = [lambda g, n: 4.0 if g == "curated" else 3.0, lambda g, n: {"en": 6.0, "es": 1.0}.get(g, 1.5), lambda g, n: math.sqrt(n)]
    plan = budgets(leaves, float(sum(x[-1] for x in leaves)), 4, weight)
    out = []
    for leaf, b in plan.items():
        left, epoch = math.floor(round(b, 6)), 0
        while left > 0:
            for i, t, n in sorted(per[leaf[:3]], key=lambda d: (hashlib.md5(f"17:{epoch}:{d[0]}".encode()).hexdigest(), d[2])):
                if left > 0:
                    out.append((i, t if n <= left else " ".join(t.split()[:left])))
                    left -= n
            epoch += 1
    return out


def pieces(docs):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(default_path()), []
    for i, text in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in binary_lengths(len(ids)):
            out.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    return sorted(out)


def test_run_equals_plain_python(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    known = {i: (t, lang, s) for i, t, lang, s, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    keep = jaccard_representatives({i: t for i, (t, *_) in known.items()})
    assert 0 < len(keep) < len(known) < len(rows)
    clean = [(i, re.sub(r"[a-z0-9]+@ex\.org", "<EMAIL>", known[i][0]), *known[i][1:]) for i in sorted(keep)]
    assert any("<EMAIL>" in t for _, t, *_ in clean)
    want = pieces(mixed(clean))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))


def test_stages_keep_the_columns_and_stand_nulls_and_repeats(spark, tmp_path):
    rows = fixture()[:40] + [(3, "thowing ck ing", "en", None, None, "x"), (3, "thowing ck ing", "en", None, None, "x"), (None, "thing ow ing ck", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.count() > 0
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() > 0


def test_null_ids_and_one_id_with_two_texts_lose_no_row(spark, tmp_path):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (2, text("e")), (2, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows[:-1], key=str)


def test_rows_are_kept_alike_whatever_else_the_table_holds(spark, tmp_path):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, None), (1, text("d")), (4, text("d") + " x"), (5, None), (6, "")]
    more = [(2, text("e")), (2, text("f")), (2, text("d") + " y"), (3, text("g")), (3, text("g")), (7, None), (7, None)]
    stay = [r for r in rows if r[0] != 4]
    for have, want in ((rows, stay), (rows + more, stay + [more[0], more[1], more[3], more[5]])):
        docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in have], SCHEMA).repartition(3)
        got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_each_stage_keeps_null_and_repeated_rows(spark, tmp_path):
    good, lines = "the words of some text in one language", [(i, t, lang, "site-0", 1, "x") for i, t, lang, *_ in fixture() if t]
    odd = [(None, good, "en", None, None, None), (None, good, "en", None, None, None), (7001, good + " mail me@ex.org", "en", "site-0", 1, "x"), (7001, good, None, None, None, None), (7002, None, "en", "s", 0, "x")]
    docs = spark.createDataFrame(lines + odd, SCHEMA)
    mine = lambda df: sorted(((r.doc_id, r.text) for r in df.where("doc_id is null or doc_id > 7000").collect()), key=str)
    kept = [(None, good), (None, good), (7001, good), (7001, good + " mail me@ex.org")]
    assert mine(corpus_pipeline.language(spark, docs, str(tmp_path))) == sorted(kept, key=str)
    masked = [(i, t.replace("me@ex.org", "<EMAIL>") if t else t) for i, t, *_ in odd]
    assert mine(corpus_pipeline.personal_data(spark, docs, str(tmp_path))) == sorted(masked, key=str)
    assert {r for r in mine(corpus_pipeline.mixture(spark, docs, str(tmp_path)))} <= {(i, t) for i, t, *_ in odd if t}
    ends = corpus_pipeline.packed(spark, docs, str(tmp_path)).where("doc_id is null or doc_id > 7000")
    assert ends.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).count() == 4


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
