import pytest
from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.functions import text as X
from quillmill.operators import datasets, dedup, facts, merging, metrics, overlap, retrieval
from quillmill.streaming.session import Rounds, Session, fold_rounds

CALM = "清晨的雾气还没有散去，河面上漂着一层薄薄的白光。老船夫坐在岸边，慢慢整理着手里的渔网。\n\n“今天会下雨吗？”少年蹲在旁边问道。\n\n远处传来几声犬吠，村子里的炊烟已经升起来了。"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("text", "want"), [("一百二十三", 123), ("两万零五", 20005), ("十", 10), ("12", 12), ("x", None), ("一万二千三百四十五", 12345), ("", None)])
def test_chinese_numerals(spark, text, want):
    assert one(spark, X.chinese_int(F.lit(text)))[0] == want


def test_sentences_and_paragraphs(spark):
    r = one(spark, S.sentences(F.lit("“你好。”他走了！！3.14 是数……完。尾")), S.paragraphs(F.lit("a\r\n\r\nb\n \t\n\nc")), S.lines(F.lit("a b c\r\n")))
    assert r[0] == ["“你好。”", "他走了！！", "3.14 是数……完。", "尾"] and r[1] == ["a", "b", "c"] and r[2] == ["a", "b c"]


def test_prefill_think_and_json(spark):
    say = lambda t: one(spark, X.prefill(F.lit(t)))[0]
    assert [say("他走了。雨停了，天晴"), say("他走了。雨停了。"), say(""), say("没有任何停顿的一个非常长的句子就在这里结束")] == ["雨停了", "雨停了", "", "没有任何停顿的一个非常长的句子"]
    assert one(spark, X.strip_think(F.lit("<think>a</think>好的。\n正文 /no_think 尾")))[0] == "正文尾"
    r = one(spark, X.classifier_response(F.lit('```json\n{"label":"a","confidence":1.7}\n```'), ["a", "b"]), X.classifier_response(F.lit("it is b"), ["a", "b"]))
    assert tuple(r[0]) == ("a", 1.0) and tuple(r[1]) == ("b", 0.5)


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([("a", "前文\n第一章 甲\n" + "字" * 25 + "\n第二章 乙\n短"), ("b", "0123456789")], "path string, text string")
    rows = S.chunks(df, ["path"], size=10, overlap=3).collect()
    a = sorted((r for r in rows if r.path == "a"), key=lambda r: r.chunk_number)
    assert [r.chapter_title for r in a][:2] == ["前言/开篇", "第一章 甲"] and a[-1].chapter_number == 2 and a[-1].part_number is None
    assert [r.chapter_title for r in rows if r.path == "b"] == ["按字数切分"]


def test_style_report(spark):
    rep = "他走了。他走了。他走了。\n\n风起。云落。风起。云落。"
    ref = spark.createDataFrame([(i, CALM) for i in range(4)], "doc_id int, text string")
    cand = spark.createDataFrame([(0, CALM), (1, "本产品支持多种模式；请阅读手册。"), (2, rep), (3, "")], "doc_id int, text string")
    out = {r.doc_id: r for r in metrics.evaluate(ref, cand).collect()}
    assert out[0].r_paragraph_count == 3 and out[0].contamination_risk == "high" and out[0].longest == len("".join(CALM.split()))
    assert out[2].repetition_risk == "high" and out[3].level == "invalid" and out[1].overall < out[0].overall


def test_character_share_of_repeated_paragraphs(spark):
    text = "\n\n".join(["字" * 40, "甲乙", "字" * 40, "丙丁", "戊己", "庚辛"])
    seg = metrics.segmented(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id")
    r = metrics.duplicate_counts(seg, "doc_id", "paragraphs", "paragraph").first()
    assert r.duplicate_paragraph_count == 1 and abs(r.duplicate_paragraph_ratio - 80 / 88) < 1e-12


def test_common_substring():
    assert overlap.common_substring("xabcdy", "zabcabcd") == (4, 1, 4)
    assert overlap.common_substring("", "a") == (0, 0, 0)


def test_visibility(spark):
    cards = spark.createDataFrame([("a", 1, 1, None), ("b", 5, 5, None), ("c", None, None, None), ("d", 1, None, None), ("e", 1, 1, 2)], "source string, revealed_in int, valid_from int, valid_to int")
    seen = lambda at: {r.source for r in cards.where(retrieval.visible(F.lit(at).cast("int"))).collect()}
    assert [seen(0), seen(2), seen(3), seen(5), seen(None)] == [set(), {"a", "e"}, {"a"}, {"a", "b"}, set("abcde")]


def test_facts(spark):
    raw = spark.createDataFrame([(None, "event", "  ", "二人会面", 59, ["甲", "乙"], None, None, None, None, i, str(i)) for i in (1, 2)] + [(None, "bad", None, "x", 1, None, None, None, None, None, 3, "3")], "id string, type string, title string, summary string, chapter int, entities array<string>, valid_from int, valid_to int, revealed_in int, confidence double, ord int, created_at string")
    v = facts.validate(raw)
    assert [r.error for r in v.orderBy("ord").collect()] == [None, None, "type"]
    good = v.where("error is null").drop("error")
    up = facts.upsert(good.limit(0).drop("ord"), good, "ord")
    assert [(r.change, r.n_updates, r.created_at) for r in up.collect()] == [("inserted", 1, "1")]
    again = facts.upsert(up.drop("change", "n_updates", "first_ord"), good, "ord")
    assert [(r.change, r.n_updates) for r in again.collect()] == [("updated", 2)]
    assert {r.entity for r in facts.entity_cards(up).collect()} == {"甲", "乙"}
    assert facts.entity_cards_asof(up, F.lit(58)).count() == 0


def test_dedup_and_rounds(spark):
    long = "长" * 50
    df = spark.createDataFrame([(1, f"{long}\n中\n{long}\n后"), (2, "一二三四五六七八。" * 3 + "尾"), (3, "好。好。好。")], "doc_id int, text string")
    out = {r.doc_id: r.text for r in dedup.dedup_output(df, "doc_id").collect()}
    assert out == {1: f"{long}\n中", 2: "一二三四五六七八。" * 2, 3: "好。好。好。"}
    r = Rounds()
    assert r.add("甲" * 12 + "\n\n" + "乙" * 12) and r.add("丙" * 12 + "\n\n" + "甲" * 12) == "丙" * 12
    got = fold_rounds(spark.createDataFrame([("s", 0, "甲" * 12), ("s", 1, "甲" * 12), ("s", 2, "乙" * 12)], "session string, seq int, text string")).first()
    assert got.text == "甲" * 12 + "\n\n" + "乙" * 12 and got.rounds == 3


def test_session_compression():
    s = Session()
    s.apply("seed", "起" * 1000)
    s.apply("accept", "承" * 3500)
    assert len(s.tail) == 2000 and s.summary.startswith("[前情节选] 起") and s.compressed == 1


def test_merges(spark):
    df = spark.createDataFrame([(1, "《甲》", "勇", ["x"]), (2, "甲", "怯", ["x", "y"]), (3, "乙", "未知", [])], "o int, name string, trait string, tags array<string>")
    out = {r.key: r for r in merging.merge_named(df, "name", "o", ("tags",), ("trait",), ("trait",)).collect()}
    assert out["甲"].trait == "勇；怯" and out["甲"].tags == ["x", "y"] and out["甲"].conflicts and out["乙"].trait == "未明确"


def test_dataset_shapes(spark):
    ids = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    t, lab = datasets.step_labels(F.array(ids(1, 2), ids(3)), ids(1, 0), ids(9))
    r = one(spark, datasets.left_packed(ids(0, 0, 5, 6), 0), datasets.left_pads(ids(0, 0, 5, 6), 0), t, lab, datasets.keep_tail(ids(1, 2, 3), 2))
    assert list(r) == [[5, 6, 0, 0], 2, [1, 2, 9, 3, 9], [-100, -100, 1, -100, 0], [2, 3]]
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 4, 3, 3, 2, 9])], "id long, n long").coalesce(1)
    packed = datasets.pack_best_fit(df, "id", "n", 8).collect()
    size = dict(enumerate([5, 4, 3, 3, 2, 9]))
    used = {}
    for p in packed:
        used.setdefault(p.bin, []).append((p.offset, size[p.id]))
    assert all(sum(n for _, n in v) <= 8 or len(v) == 1 for v in used.values())
