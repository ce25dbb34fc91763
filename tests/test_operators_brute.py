"""Operators without SQL against plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.operators import metrics, overlap, retrieval, samples


def sentences(rng, n):
    words = ["lake", "moon", "walks", "under", "the", "old", "red", "bridge", "slowly", "again"]
    return [" ".join(rng.choices(words, k=rng.randint(2, 7))) + "." for _ in range(n)]


def bare(t):
    return "".join(t.split())


def effective(t):
    return "".join(c for c in t if not c.isspace() and c not in "。！？!?；;，,、：:“”‘’「」『』\"'（）()【】《》….-—")


def test_near_matches_against_every_pair(spark):
    rng = random.Random(4)
    ref = sentences(rng, 25)
    cand = []
    for s in rng.choices(ref, k=120):
        w = s.split()
        w[rng.randrange(len(w))] = rng.choice(["lake", "moons", "walk"])
        cand.append(" ".join(w))
    seg = lambda rows, name: metrics.segmented(spark.createDataFrame([(name, " ".join(rows))], "doc_id string, text string"), "doc_id")
    ci, ri = overlap.items(seg(cand, "c"), "doc_id"), overlap.items(seg(ref, "r"), "doc_id")
    got = {r.pos: (r.ref_pos, round(r.similarity, 9)) for r in overlap.near_matches(ci, ri, "doc_id", False).collect()}
    mine = [(r.pos, r.exact, r.norm, r.visible) for r in ci.collect()]
    held = sorted((r.pos, r.exact, r.norm, r.visible) for r in ri.collect())
    want = {}
    for pos, exact, norm, visible in mine:
        if visible < 12 or exact in {h[1] for h in held} or norm in {h[2] for h in held}:
            continue
        best = (0.0, None)
        for rpos, _, rnorm, rvis in held:
            long = max(len(norm), len(rnorm))
            if rvis >= 12 and abs(len(norm) - len(rnorm)) <= max(8, int(long * 0.4)):
                q = SequenceMatcher(None, norm, rnorm, autojunk=False).ratio()
                if q >= 0.88 and q > best[0]:
                    best = (q, rpos)
        if best[1] is not None:
            want[pos] = (best[1], round(best[0], 9))
    assert got == want and len(got) > 5


def test_adjacent_near_duplicates_against_plain_python(spark):
    rng = random.Random(5)
    rows = []
    for i in range(30):
        s = sentences(rng, 6)
        rows.append((i, " ".join(x for a in s for x in (a, a.replace("the", "a"), a)[: rng.randint(1, 3)])))
    seg = metrics.segmented(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    got = {(r.doc_id, r.pos): r.similarity for r in metrics.near_duplicate_adjacent(seg, "doc_id").collect()}
    want = {}
    for r in seg.collect():
        units = [u for u in (bare(s) for s in r.sentences) if u]
        for k, (a, b) in enumerate(zip(units, units[1:], strict=False)):
            if a != b and (q := metrics.sentence_similarity(effective(a), effective(b))) >= 0.82:
                want[r.doc_id, k] = q
    assert got == want and len(got) > 10


def test_sentence_similarity_is_the_better_of_two():
    for a, b in (("abcdefgh", "abcdefgx"), ("hgfedcba", "abcdefgh"), ("short", "short"), ("aaaaaaaa", "bbbbbbbb")):
        short = min(len(a), len(b))
        want = 0.0 if short < 6 else min(1.0, max(SequenceMatcher(None, a, b).ratio(), (Counter(a) & Counter(b)).total() / max(1, short - min(2, short // 4))))
        assert metrics.sentence_similarity(a, b) == round(want, 4)


def test_the_longest_common_substring_of_two_texts(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choices("abc", k=rng.randint(0, 30))), "".join(rng.choices("abc", k=rng.randint(0, 30)))) for _ in range(60)]
    got = overlap.longest_common_substrings(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    for r in got:
        most = max((n for n in range(len(r.a) + 1) if any(r.a[i : i + n] in r.b for i in range(len(r.a) - n + 1))), default=0)
        assert r.lcs.length == most and r.a[r.lcs.a_start : r.lcs.a_start + most] == r.b[r.lcs.b_start : r.lcs.b_start + most]


def test_a_report_of_a_copy_and_of_another_text(spark):
    rng = random.Random(7)
    text = "\n\n".join(" ".join(sentences(rng, 5)) for _ in range(8))
    ref = spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id long, text string")
    cand = spark.createDataFrame([(1, text), (2, "Nothing of that is in here, not one word at all! " * 2), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in metrics.evaluate(ref, cand).collect()}
    assert out[1].contamination_risk == "high" and out[1].length_profile == 20 and "copied" in out[1].overall_warning
    assert out[2].contamination_risk == "low" and out[2].length_profile < 20 and out[2].exact_count == 0
    assert out[3].level == "invalid" and out[3].overall == 0 and "empty" in out[3].overall_warning
    shown = {r.doc_id: r for r in metrics.report_markdown(metrics.evaluate(ref, cand)).collect()}
    assert "| length_profile | 20.0 | 20 |" in shown[1].markdown and "contamination: high" in shown[1].summary
    assert "100.00%" in shown[1].markdown and "- none" not in shown[3].summary
    assert "text" not in metrics.text_free(metrics.evaluate(ref, cand)).columns


def test_whole_repetition_risk(spark):
    rows = [(1, "A calm lake lay beyond.\nNobody spoke until dusk fell upon them all.\nBirds, quickly gone!"), (2, "The same line again.\n" * 6), (3, "Go on. Stop now. Go on. Stop now. Then it was a quite long and different closing sentence.")]
    out = {r.doc_id: r for r in metrics.repetition_stats(metrics.segmented(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id"), "doc_id").collect()}
    assert [out[k].repetition_risk for k in (1, 2, 3)] == ["low", "high", "high"] and out[3].abab == 1 and out[2].consecutive_repeats == 5


def test_samples_of_sections(spark):
    part = lambda head, body: f"{head}\n{body}\n"
    main = part("第一章", "m" * 150) + part("第二章", "n" * 200) + part("第三章", "short")
    extras = "opening words " * 3 + part("番外一", "x" * 120) + part("番外二", "y" * 130)
    text = main + extras
    ranges = [("main", 0, len(main)), ("extras", len(main), len(text))]
    heads = {"main": "(?m)^第.章$", "extras": "(?m)番外.$"}
    good, skipped = samples.section_samples(spark.createDataFrame([(1, text)], "k long, text string"), ranges, heads, "k", "Go on.")
    rows = {r.sample_id: r for r in good.collect()}
    # the first chapter of a section follows its prelude; the first extra never counts
    assert sorted(rows) == ["novel2_extras_000002", "novel2_main_000001"]
    second = rows["novel2_main_000001"]
    assert (second.section_index, second.completion, second.target_chapter, second.max_chapter_used) == (2, "n" * 200, 1, 0)
    assert second.messages[1].content.endswith("m" * 150) and text[second.completion_start] == "n"
    assert {r.skip_reason: r["count"] for r in skipped.collect()} == {"main_empty_context": 1, "main_completion_lt_min": 1, "extras_first_without_same_section_context": 1}


def test_visible_pairs_against_every_pair_without_a_nested_loop(spark):
    rng = random.Random(8)
    some = lambda lo, hi: rng.choice([None, *range(lo, hi)])
    cards = [(i, some(-3, 9), some(-3, 9), some(0, 14)) for i in range(120)] + [(500, -(1 << 31), -(1 << 31), (1 << 31) - 1), (501, (1 << 31) - 1, 0, None)]
    targets = [(k, at) for k, at in enumerate([None, -(1 << 31), -2, 0, 3, 7, 13, (1 << 31) - 1])]
    c = spark.createDataFrame(cards, "card long, revealed_in int, valid_from int, valid_to int")
    t = spark.createDataFrame(targets, "target long, at int")
    pairs = retrieval.visible_pairs(t, c)
    want = sorted((k, i) for k, at in targets for i, r, s, e in cards if at is None or (r is not None and s is not None and r <= at and s <= at and (e is None or e >= at)))
    assert sorted((p.target, p.card) for p in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_a_dictionary_of_names_joins_the_tokens(spark):
    row = spark.createDataFrame([("Li Wei met 林清雪 there",)], ["t"]).select(S.tokens_with(["林清雪", "Li Wei", "none"])(F.col("t")).alias("w")).first()
    assert row.w == ["li", "wei", "met", "there", "林清", "清雪", "林清雪", "Li Wei"]


def test_grams_inside_a_row_equal_counting_each(spark):
    rng = random.Random(11)
    silent = frozenset(map(ord, ".-，"))
    texts = ["".join(rng.choices("ab.-，日😀", k=rng.randint(0, 80))) for _ in range(80)] + ["", "a", "aa", "....", "".join(map(chr, range(0x4E00, 0x4E00 + 9000))) * 2]
    for t in texts:
        for n in (1, 2, 3, 4, 6):
            seen = {}
            for i in range(len(t) - n + 1):
                seen.setdefault(t[i : i + n], []).append(i)
            want = sorted(((-len(at), at[0], g) for g, at in seen.items() if len(at) > 1 and any(ord(c) not in silent for c in g)))[:5]
            assert metrics.repeated_grams(t, n, 5, silent) == [(g, -c, i) for c, i, g in want]
    df = spark.createDataFrame([(None, "ab ab"), (1, None), (2, "xyxy")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n, r.gram, r["count"], r.first_pos, r["rank"]) for r in metrics.top_char_ngrams(df, "doc_id").collect()), key=str)
    assert got == sorted([(None, 2, "ab", 2, 0, 1), (2, 2, "xy", 2, 0, 1)], key=str)
    plan = metrics.top_char_ngrams(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Aggregate" not in plan and "Window" not in plan


def test_a_bound_on_similarity_never_errs():
    rng = random.Random(12)
    score = metrics.similarity_from(0.82)
    for _ in range(3000):
        a = "".join(rng.choices("abcd", k=rng.randint(0, 14)))
        b = "".join(rng.choices(a or "x", k=rng.randint(0, 14))) if rng.random() < 0.5 else a[: rng.randint(0, 14)] + "ab"
        q = metrics.sentence_similarity(a, b)
        assert score(a, b) == q if q >= 0.82 else score(a, b) < 0.82
