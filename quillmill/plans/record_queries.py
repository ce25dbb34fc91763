"""Queries of extraction, merges of records, facts and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.operators import facts, factstore, merging, metrics
from quillmill.plans.registry import _FACTS, _WS, ORACLE_SQL, _strip, docs, query, raw_facts, read, seg
from quillmill.sources import cardstore, io
from quillmill.sources.durable import settle, work_dir


def extracted(spark, sf_dir):
    """The chunks' extractions, as a table: ten sections read it."""
    return settle(merging.normalize_extraction(answers(spark, sf_dir)).select("index", "extraction"), f"{work_dir(spark)}/extracted")


def answers(spark, sf_dir):
    """Chunks with a model's answer as JSON, in several shapes: lists, single objects, missing parts, no JSON."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    person = lambda c: F.concat(F.lit('{"name": "'), c, F.lit('", "description": "'), F.col("p_type"), F.lit('"}'))
    many = F.concat(F.lit('{"characters": ['), person(F.col("p_brand")), F.lit(', "noise", '), person(F.col("p_name")), F.lit('], "timeline": {"events": [{"event": "'), F.col("p_name"), F.lit('"}]}, "style": {"tone": "'), F.col("p_type"), F.lit('"}, "plot_threads": {"main_thread": "'), F.col("p_name"), F.lit('", "sub_threads": ["'), F.col("p_type"), F.lit('"]}}'))
    one = F.concat(F.lit('```json\n{"characters": '), person(F.col("p_brand")), F.lit(', "timeline": [{"event": "'), F.col("p_name"), F.lit('", "source": "own"}], "glossary": [{"term": "'), F.col("p_name"), F.lit('", "category": "'), F.col("p_type"), F.lit('"}]}\n```'))
    few = F.concat(F.lit('{"events": [{"event": "'), F.col("p_name"), F.lit('"}], "relationships": [{"a": "'), F.col("p_brand"), F.lit('", "b": "'), F.col("p_name"), F.lit('", "type": "'), F.col("p_type"), F.lit('"}], "chapter_summary": {"summary": "'), F.col("p_name"), F.lit('"}}'))
    text = F.when(k == 0, many).when(k == 1, one).when(k == 2, few).otherwise(F.lit("no answer"))
    return p.select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("chapter_title"), F.lit("f.txt").alias("file_name"), (F.col("p_partkey") * 10).alias("start_char"), (F.col("p_partkey") * 10 + 9).alias("end_char"), F.lit(None).cast("long").alias("chapter_number"), (F.col("p_partkey") + 1).alias("chunk_number"), text.alias("response"))


_LABEL = "p_brand || ' | f.txt:' || (p_partkey * 10) || '-' || (p_partkey * 10 + 9)"


@query(f"""
SELECT p_partkey AS index, CASE k WHEN 0 THEN p_brand || '|' || p_name WHEN 1 THEN p_brand ELSE '' END AS characters, CASE k WHEN 3 THEN '' ELSE p_name || '@' || CASE k WHEN 1 THEN 'own' ELSE lab END END AS timeline,
  CASE k WHEN 1 THEN p_name ELSE '' END AS terms, CASE k WHEN 2 THEN p_brand || '-' || p_name ELSE '' END AS relationships, CASE k WHEN 0 THEN p_type END AS tone, CASE k WHEN 0 THEN p_name ELSE '' END AS main_thread,
  CASE k WHEN 0 THEN p_type || '@' || lab ELSE '' END AS sub_threads, p_brand AS summary_title, (p_partkey + 1)::VARCHAR AS summary_number, lab AS summary_source
FROM (SELECT *, p_partkey % 4 AS k, {_LABEL} AS lab FROM part)
""")
def normalized_extractions(spark, sf_dir):
    """N1, N2."""
    out = merging.normalize_extraction(answers(spark, sf_dir))
    get = lambda m, f: F.try_element_at(m, F.lit(f))
    e = lambda p: F.col(f"extraction.{p}")
    join = lambda c, f: F.array_join(F.transform(c, f), "|")
    return out.select(
        "index",
        join(e("characters"), lambda m: get(m, "name")).alias("characters"),
        join(e("timeline"), lambda m: F.concat(get(m, "event"), F.lit("@"), get(m, "source"))).alias("timeline"),
        join(e("glossary"), lambda m: get(m, "term")).alias("terms"),
        join(e("relationships"), lambda m: F.concat(get(m, "a"), F.lit("-"), get(m, "b"))).alias("relationships"),
        get(e("style"), "tone").alias("tone"),
        F.array_join(e("plot_threads.main_thread"), "|").alias("main_thread"),
        join(e("plot_threads.sub_threads"), lambda m: F.concat(get(m, "description"), F.lit("@"), get(m, "source"))).alias("sub_threads"),
        get(e("chapter_summary"), "chapter_title").alias("summary_title"),
        get(e("chapter_summary"), "chapter_number").alias("summary_number"),
        get(e("chapter_summary"), "source").alias("summary_source"),
    )


@query("""
SELECT 'characters' AS section, (SELECT count(*) * 2 FROM part WHERE p_partkey % 4 = 0) + (SELECT count(*) FROM part WHERE p_partkey % 4 = 1) AS records
UNION ALL SELECT 'timeline', count(*) FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT 'relationships', count(*) FROM part WHERE p_partkey % 4 = 2
UNION ALL SELECT 'glossary', count(*) FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'sub_threads', count(*) FROM part WHERE p_partkey % 4 = 0
""")
def record_streams(spark, sf_dir):
    """T12."""
    out = None
    for name, rows in merging.streams(extracted(spark, sf_dir)).items():
        one = rows.groupBy(F.lit(name).alias("section")).agg(F.count("*").alias("records"))
        out = one if out is None else out.union(one)
    return out


_KEY = "lower(regexp_replace({c}, '\\s+', '', 'g'))"


@query(f"""
WITH c AS (SELECT {_KEY.format(c='p_brand')} AS key, p_brand AS name, p_type AS d, p_partkey AS o, 0 AS i FROM part WHERE p_partkey % 4 < 2 UNION ALL SELECT {_KEY.format(c='p_name')}, p_name, p_type, p_partkey, 1 FROM part WHERE p_partkey % 4 = 0),
d AS (SELECT key, d, min(o) AS o FROM c GROUP BY key, d),
r AS (SELECT least({_KEY.format(c='p_brand')}, {_KEY.format(c='p_name')}) || '||' || greatest({_KEY.format(c='p_brand')}, {_KEY.format(c='p_name')}) || '||' || {_KEY.format(c='p_type')} AS key, p_partkey AS o FROM part WHERE p_partkey % 4 = 2),
g AS (SELECT p_type AS category, count(*) AS n FROM part WHERE p_partkey % 4 = 1 GROUP BY p_type)
SELECT 'characters' AS section, key, string_agg(d, '；' ORDER BY o) AS value FROM d GROUP BY key UNION ALL SELECT 'relationships', key, min(o)::VARCHAR FROM r GROUP BY key UNION ALL SELECT 'glossary', category, n::VARCHAR FROM g
""")
def merged_results(spark, sf_dir):
    """The sections of all chunks' extractions, merged."""
    sections = merging.streams(extracted(spark, sf_dir))
    out = merging.merge_results(sections, "index")
    people = out["characters"].select(F.lit("characters").alias("section"), "key", F.col("description").alias("value"))
    r = out["relationships"]
    pair = F.array_join(F.array_sort(F.array(X.normalized_key(F.col("a")), X.normalized_key(F.col("b")))), "||")
    ties = r.select(F.lit("relationships"), F.concat_ws("||", pair, X.normalized_key(F.col("type"))), F.col("first_ord").cast("string"))
    terms = out["glossary"].select(F.lit("glossary"), "category", F.size("terms").cast("string"))
    return people.union(ties).union(terms)


@query("""
SELECT key, arg_min(event_type, event_id) AS kind, min(event_id) AS event_id FROM (SELECT *, lower(event_type || (user_id % 5)) AS key FROM events) GROUP BY key
""")
def merged_timeline(spark, sf_dir):
    """A17."""
    e = read(spark, sf_dir, "events").withColumn("src", (F.col("user_id") % 5).cast("string"))
    out = merging.merge_timeline(e, "event_type", "src", "event_id")
    return out.select(F.lower(F.concat("event_type", "src")).alias("key"), F.col("event_type").alias("kind"), "event_id")


@query("""
WITH t AS (SELECT 'p_type' AS f, p_type AS v, min(p_partkey) AS o FROM part GROUP BY p_type UNION ALL SELECT 'p_name', p_name, min(p_partkey) FROM part GROUP BY p_name),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY o, v) AS r FROM t)
SELECT string_agg(v, '；' ORDER BY r) FILTER (f = 'p_type') AS p_type, string_agg(v, '；' ORDER BY r) FILTER (f = 'p_name') AS p_name FROM r WHERE r <= 30
""")
def merged_style(spark, sf_dir):
    """A18."""
    return merging.merge_style(read(spark, sf_dir, "part"), ("p_type", "p_name"), "p_partkey")


@query("""
WITH o AS (SELECT lower(regexp_replace(p_brand, '\\s+', '', 'g')) AS key, p_partkey AS o, p_brand, p_type FROM part),
t AS (SELECT key, string_agg(p_type, '；' ORDER BY o) AS v FROM (SELECT key, p_type, min(o) AS o FROM o GROUP BY key, p_type) GROUP BY key)
SELECT 'generated/brands/' || n || '.md' AS rel_path, '# ' || n || chr(10) || chr(10) || '- p_type: ' || v || chr(10) AS content FROM (SELECT v, (SELECT arg_min(p_brand, o) FROM o x WHERE x.key = t.key) AS n FROM t)
""")
def record_cards(spark, sf_dir):
    """S17, X30."""
    p = read(spark, sf_dir, "part").withColumn("p_none", F.lit("未提及"))
    out = merging.merge_named(p, "p_brand", "p_partkey", texts=("p_type", "p_none"))
    return merging.record_cards(out, "brands", "p_brand", ("p_type", "p_none"))


@query(f"""
WITH d AS (SELECT doc_id, {_strip("regexp_replace(text, '" + _WS + "+', ' ', 'g')")} AS t, doc_id % 9 + 1 AS ch FROM documents)
SELECT doc_id, 'event' AS type, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE '第' || ch || '章新增事件' END AS title, left(t, 180) AS summary, ['a', 'b' || doc_id] AS entities, ch::INT AS valid_from, 0.3::DOUBLE AS confidence, 'needs_human_review' AS status, left(t, 80) AS quote FROM d
""")
def fact_drafts(spark, sf_dir):
    """N6."""
    d = docs(spark, sf_dir).withColumn("chapter", (F.col("doc_id") % 9 + 1).cast("int")).withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).otherwise(" "))
    d = d.withColumn("entities", F.concat(F.lit(" a，、b"), F.col("doc_id").cast("string"), F.lit(",")))
    rows = facts.draft(d).withColumn("quote", F.element_at("evidence", 1)["quote"])
    return rows.select(  # a draft has no id of its text; the entity tells it
        F.regexp_extract(F.element_at("entities", 2), r"b(\d+)", 1).cast("long").alias("doc_id"), "type", "title", "summary", "entities", "valid_from", "confidence", "status", "quote"
    )


@query(f"""
WITH {_FACTS}
SELECT 'facts/' || id || '.md' AS rel_path, md5('---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'type: "system_b_event"' || chr(10) || 'revealed_in: ' || chapter || chr(10) || 'valid_from: ' || chapter || chr(10) || 'valid_to: ' || coalesce(valid_to::VARCHAR, 'null') || chr(10)
  || 'system_b: true' || chr(10) || 'kg_id: "' || id || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '- 类型: event' || chr(10) || '- 章节: ' || chapter || chr(10) || '- 有效期: ' || chapter || ' -> ' || coalesce(valid_to::VARCHAR, 'None') || chr(10)
  || '- 置信度: 0.7' || chr(10) || '- 相关实体: ' || ent || chr(10) || chr(10) || '## 记忆' || chr(10) || chr(10) || summary || chr(10)) AS content_md5 FROM g
""")
def fact_card_files(spark, sf_dir):
    """S17, X21, X29, X30, F8, X22."""
    good = facts.validate(raw_facts(spark, sf_dir)).where("error is null")
    return facts.fact_card(good).select("rel_path", F.md5("content").alias("content_md5"))


_BODY = "string_agg('- ch' || chapter || ' [event] ' || summary, chr(10) ORDER BY chapter, id, '- ch' || chapter || ' [event] ' || summary)"


@query(f"""
WITH {_FACTS}
SELECT 'entities/' || ent || '.md' AS rel_path, md5('---' || chr(10) || 'title: "' || ent || '"' || chr(10) || 'type: "system_b_entity"' || chr(10) || 'revealed_in: ' || min(chapter) || chr(10) || 'valid_from: ' || min(chapter) || chr(10)
  || 'valid_to: ' || CASE WHEN bool_or(valid_to IS NULL) THEN 'null' ELSE max(valid_to)::VARCHAR END || chr(10) || 'system_b: true' || chr(10) || '---' || chr(10) || chr(10) || '# ' || ent || chr(10) || chr(10) || 'System B entity memory.' || chr(10) || chr(10) || {_BODY} || chr(10)) AS content_md5 FROM g GROUP BY ent
""")
def entity_card_files(spark, sf_dir):
    """S17, A13, T11."""
    out = facts.entity_card_files(facts.entity_cards(facts.validate(raw_facts(spark, sf_dir))))
    return out.select("rel_path", F.md5("content").alias("content_md5"))


@query(ORACLE_SQL["entity_card_files"])
def card_store(spark, sf_dir):
    """Entity cards as a data source: a version of the facts with even numbers, then one of all, appended; the
    cards that were written last are read back."""
    f, root = facts.validate(raw_facts(spark, sf_dir)), f"{work_dir(spark)}/cards"
    for known in (f.where("ord % 2 = 0"), f):
        cardstore.save(facts.entity_card_files(facts.entity_cards(known)), root)
    return cardstore.load(spark, root).select("rel_path", F.md5("content").alias("content_md5"))


@query("""
WITH k AS (SELECT item_id, item_id % 6 AS k, 'see 第三章 and 第' || (item_id % 4 + 1) || '章' || chr(10) || '**别名/称呼**: x、y' || item_id || chr(10) || '## 类型' || chr(10) || '地点' AS t FROM benchmark),
r AS (SELECT *, CASE k WHEN 0 THEN 'timeline.md' WHEN 1 THEN 'style.md' WHEN 2 THEN 'generated/c/n' || item_id || '.md' WHEN 3 THEN 'n' || item_id || '.md' WHEN 4 THEN 'other/n.md' ELSE '.hidden.md' END AS path, least(3, item_id % 4 + 1) AS first FROM k)
SELECT item_id, path AS rel_path, CASE k WHEN 0 THEN 'skip:aggregate' WHEN 2 THEN 'add:' || first ELSE 'add:1' END AS action,
  md5(CASE k WHEN 0 THEN '' WHEN 1 THEN '---' || chr(10) || 'title: style' || chr(10) || 'type: style' || chr(10) || 'revealed_in: 1' || chr(10) || 'valid_from: 1' || chr(10) || 'valid_to: null' || chr(10) || '---' || chr(10) || chr(10)
    WHEN 2 THEN '---' || chr(10) || 'title: n' || item_id || chr(10) || 'type: character' || chr(10) || 'aliases:' || chr(10) || '  - x' || chr(10) || '  - y' || item_id || chr(10) || 'revealed_in: ' || first || chr(10) || 'valid_from: ' || first || chr(10) || 'valid_to: null' || chr(10)
      || 'source_chapters:' || chr(10) || CASE WHEN item_id % 4 + 1 = 3 THEN '  - 3' ELSE '  - ' || first || chr(10) || '  - ' || greatest(3, item_id % 4 + 1) END || chr(10) || '---' || chr(10) || chr(10)
    ELSE '---' || chr(10) || 'title: n' || item_id || chr(10) || 'type: location' || chr(10) || 'revealed_in: 1' || chr(10) || 'valid_from: 1' || chr(10) || 'valid_to: null' || chr(10) || 'source_chapters:' || chr(10) || '  - 1' || chr(10) || '---' || chr(10) || chr(10) END || t) AS content_md5
FROM r WHERE k < 4
""")
def enriched_cards(spark, sf_dir):
    """N7, F2, X12, X13, X14; a second run changes nothing."""
    i = F.col("item_id")
    text = F.concat(F.lit("see 第三章 and 第"), (i % 4 + 1).cast("string"), F.lit("章\n**别名/称呼**: x、y"), i.cast("string"), F.lit("\n## 类型\n地点"))
    n = F.concat(F.lit("n"), i.cast("string"), F.lit(".md"))
    path = F.when(i % 6 == 0, "timeline.md").when(i % 6 == 1, "style.md").when(i % 6 == 2, F.concat(F.lit("generated/c/"), n)).when(i % 6 == 3, n).when(i % 6 == 4, "other/n.md").otherwise(".hidden.md")
    cards = read(spark, sf_dir, "benchmark").select(path.alias("rel_path"), text.alias("text"))
    made = io.enriched(cards)
    again = io.enriched(made.select("rel_path", F.col("content").alias("text"))).where("action like 'skip:%'").select("rel_path", "content")
    out = made.join(again.distinct(), ["rel_path", "content"], "left_semi")
    number = F.regexp_extract("content", r"、y(\d+)", 1).cast("long")
    return out.select(number.alias("item_id"), "rel_path", "action", F.md5("content").alias("content_md5"))


# ---------------------------------------------------------------- bundles with scores that SQL can't give


@query()
def repetition_whole(spark, sf_dir):
    """A6 from all its inputs, W2 among them."""
    out = metrics.repetition_stats(seg(spark, sf_dir), "doc_id")
    return out.select("doc_id", "duplicate_line_count", "duplicate_paragraph_count", "consecutive_repeats", "single_runs", "abab", "near_duplicate_count", "repetition_risk")


@query()
def near_duplicate_adjacent(spark, sf_dir):
    """W2, X34, U4."""
    return metrics.near_duplicate_adjacent(seg(spark, sf_dir), "doc_id").select("doc_id", "pos", "similarity")


def paired(spark, sf_dir):
    """Every turn of a conversation beside the turn before it."""
    c = read(spark, sf_dir, "conversations")
    both = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ctx"), "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before")).where("before is not null")
    return both.select("ctx", F.col("before").alias("text")), both.select("ctx", "text")


@query()
def style_reports(spark, sf_dir):
    """N9, A7, A8, style score, build_summary, X28, X31, S23: the report of every turn against the one before it."""
    ref, cand = paired(spark, sf_dir)
    whole = settle(metrics.evaluate(ref, cand, "ctx"), f"{work_dir(spark)}/reports")
    shown = metrics.report_markdown(whole, "ctx").select("ctx", F.md5("markdown").alias("markdown_md5"), F.md5("summary").alias("summary_md5"))
    return metrics.text_free(whole, "ctx").select("ctx", *metrics.WEIGHTS, "overall", "level", "repetition_risk", "contamination_risk").join(shown, "ctx")


@query("SELECT r AS risk, CASE r WHEN 'low' THEN 100.0 WHEN 'medium' THEN 60.0 WHEN 'high' THEN 20.0 ELSE 0.0 END::DOUBLE AS score, (strlen(r) * 7.25)::VARCHAR AS shown FROM (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'none' END AS r FROM events)")
def risk_points(spark, sf_dir):
    """X28."""
    r = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "none"))), (F.col("event_id") % 4 + 1).cast("int"))
    out = read(spark, sf_dir, "events").select(r.alias("risk")).distinct()
    return out.select("risk", X.risk_score(F.col("risk"), 60.0, 20.0).alias("score"), (F.length("risk") * F.lit(7.25)).cast("decimal(10,2)").cast("string").alias("shown"))


@query(f"""
WITH {_FACTS}
SELECT id, coalesce(min(ord) FILTER (ord % 3 = 0), min(ord) FILTER (ord % 3 = 1), min(ord))::VARCHAR AS created_at, arg_max(struct_pack(v := valid_to), ord % 3 * 1000000000000 + ord).v AS valid_to FROM g GROUP BY id
""")
def fact_store(spark, sf_dir):
    """Facts in three batches into a store of hash buckets, then all that it holds."""
    good = facts.validate(raw_facts(spark, sf_dir)).where("error is null").drop("error")
    path, schema = f"{work_dir(spark)}/facts", good.drop("ord").schema
    for k in range(3):
        factstore.upsert(path, good.where(F.col("ord") % 3 == k), "ord", schema)
    return factstore.read(spark, path, schema).select("id", "created_at", "valid_to")


@query("""
WITH s AS (SELECT event_id AS id, 'u' || user_id AS subject, (date_diff('day', DATE '1970-01-01', ts::DATE) - 19000)::INT AS valid_from, event_id % 3 = 0 AS ends FROM events),
n AS (SELECT subject, valid_from, lead(valid_from) OVER (PARTITION BY subject ORDER BY valid_from) AS next FROM (SELECT DISTINCT subject, valid_from FROM s))
SELECT id, subject, valid_from, CASE WHEN ends AND (next IS NULL OR valid_from + 2 < next - 1) THEN valid_from + 2 ELSE next - 1 END::INT AS valid_to FROM s JOIN n USING (subject, valid_from)
""")
def state_history(spark, sf_dir):
    """States of subjects in two batches, each closed where the next of its subject begins."""
    f = raw_facts(spark, sf_dir).select(F.col("ord").alias("id"), F.col("entities")[0].alias("subject"), F.col("chapter").alias("valid_from"), "valid_to")
    path = f"{work_dir(spark)}/states"
    for k in (1, 0):
        factstore.add_states(path, f.where(F.col("id") % 2 == k), "subject", f.schema)
    return factstore.read(spark, path, f.schema)
