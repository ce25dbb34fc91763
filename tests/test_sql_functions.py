"""Table functions in SQL text give the rows of the DataFrame forms."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.functions import sql

BOOK = "前言 here\n第一章 起\n　甲乙。丙！\n\n第十二章\n\n第二百零三章 尾 \nno end…… or 3.14 so?\r\nChapter 7\nlast 第五章 not a heading\n"
CARDS = "intro\n### 李（男）\nfirst\n### 王\nx\n### 李\nlast"
SUMMARIES = "# all\n## 起\n- **章节编号**: 3\n- **本章概要**: one\n two\n- **人物**: x\n## \n- **章节编号**：12\n- **本章概要**：未明确\n## 尾\n- **章节编号**: 4\n- **本章概要**: end"
TEXTS = [BOOK, BOOK * 3, CARDS, SUMMARIES, "", " \n\t\n ", None, "第三章 only\nbody", "x" * 95, "a\n\nb\n \n\nc\r\rd", "第九九九章 odd\nbody\n第1章\n第零章\n", "\n", "a'b\"c\\n 二十 Ⅳ", BOOK]


@pytest.fixture(scope="module")
def docs(spark):
    sql.register(spark)
    out = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("chapter_of", F.lit("clash"))
    out.createOrReplaceTempView("sql_docs")
    return out


def same(left, right):
    left = left.select(*right.columns)
    a, b = ([repr(tuple(r)) for r in df.collect()] for df in (left, right))
    assert sorted(a) == sorted(b) and len(a) > 0


def unfolded(spark, call, columns="c.*"):
    return spark.sql(f"SELECT id, {columns} FROM sql_docs, LATERAL {call} AS c")


@pytest.mark.parametrize("name", ["paragraphs", "sentences", "lines", "tokens"])
def test_arrays(spark, docs, name):
    same(spark.sql(f"SELECT id, {name}_of(text) AS got FROM sql_docs"), docs.select("id", getattr(S, name)(F.col("text")).alias("got")))


def test_chapters(spark, docs):
    one = docs.select("id", "text")
    same(unfolded(spark, "chapters_of(text)"), S.chapters_by_position(one).drop("text"))
    same(unfolded(spark, "numbered_chapters_of(text)"), S.chapters_by_number(one).drop("text"))
    got = unfolded(spark, "numbered_chapters_of(text)").where("id = 0").orderBy("chapter").select("chapter", "heading").collect()
    assert [tuple(r) for r in got] == [(1, "第一章 起"), (12, "第十二章"), (203, "第二百零三章 尾")]


@pytest.mark.parametrize("size, overlap", [(3000, 200), (20, 5), (7, 0), (5, 9)])
def test_chunks(spark, docs, size, overlap):
    same(unfolded(spark, f"chunks_of(text, {size}, {overlap})"), S.chunks(docs, ["id"], size=size, overlap=overlap))


def test_sections(spark, docs):
    pattern = r"(?m)^第[^\n]{1,4}章[^\n]*$"
    want = S.section_slices(docs.select("id", "text"), [("s", 3, 60)], {"s": pattern}, "id").drop("text", "section")
    got = spark.sql("SELECT id, c.* FROM sql_docs, LATERAL section_slices_of(text, :pattern, 3, 60) AS c", args={"pattern": pattern})
    same(got, want)


def test_cards_and_summaries(spark, docs):
    got = spark.sql("SELECT c.name, max_by(c.content, c.ord) AS content FROM sql_docs, LATERAL cards_of(text) AS c GROUP BY c.name")
    same(got, S.split_cards(docs))
    assert {r.name: r.content for r in got.collect()} == {"李": "### 李\nlast", "王": "### 王\nx"}
    same(spark.sql("SELECT c.* FROM sql_docs, LATERAL summaries_of(text) AS c"), S.chapter_summaries(docs))


def test_the_plan_has_neither_python_nor_a_shuffle(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    spark.read.parquet(f"{tmp_path}/d").createOrReplaceTempView("sql_stored")
    plan = spark.sql("SELECT id, c.* FROM sql_stored, LATERAL chunks_of(text, 20, 5) AS c")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not any(x in plan for x in ("Exchange", "Python", "Join")) and "chapter_of" not in plan


def test_an_empty_table(spark, docs):
    for call in ("chunks_of(text, 20, 5)", "chapters_of(text)", "cards_of(text)", "summaries_of(text)", "pieces_of(text, 'a')"):
        assert spark.sql(f"SELECT c.* FROM sql_docs, LATERAL {call} AS c WHERE id < 0").collect() == []
