"""Queries of retrieval, context and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.functions import text as X
from quillmill.operators import lattice, overlap, retrieval, textindex
from quillmill.plans.registry import ORACLE_SQL, _bare, _lines, _paragraphs, _strip, bench_seg, docs, query, read, seg
from quillmill.sources.durable import settle, work_dir
from quillmill.streaming import session


def cards(spark, sf_dir):
    """Benchmark items as cards: named by their second word, with windows and path classes by number."""
    b, i = read(spark, sf_dir, "benchmark"), F.col("item_id")
    name = F.lower(F.regexp_extract("text", r"^\S+ ([A-Za-z]+)", 1))
    end = F.when(i % 3 != 0, (i % 5 + 10).cast("int"))
    return b.select(i.alias("doc_ord"), F.when(i % 4 == 0, F.concat(name, F.lit("-x"))).otherwise(name).alias("source"), "text", (i % 3).alias("depth_class"), (i % 7).cast("int").alias("revealed_in"), (i % 5).cast("int").alias("valid_from"), end.alias("valid_to"))


def contexts(spark, sf_dir):
    """The turns of conversations as contexts, each at a point in time; some at none."""
    c = read(spark, sf_dir, "conversations")
    at = F.when(F.col("turn") % 4 != 3, (F.col("conv_id") % 13).cast("int"))
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ctx"), "text", at.alias("at"))


_CARDS = """
k AS (SELECT item_id AS doc_ord, lower(regexp_extract(text, '^\\S+ ([A-Za-z]+)', 1)) || CASE WHEN item_id % 4 = 0 THEN '-x' ELSE '' END AS source, text, item_id % 3 AS depth, item_id % 7 AS rev, item_id % 5 AS vf, CASE WHEN item_id % 3 <> 0 THEN item_id % 5 + 10 END AS vt FROM benchmark),
x AS (SELECT conv_id || '/' || turn AS ctx, text, CASE WHEN turn % 4 <> 3 THEN conv_id % 13 END AS at_ FROM conversations),
e0 AS (SELECT ctx, name, ((length(t) - length(replace(t, name, ''))) / length(name))::INT AS freq FROM (SELECT ctx, right(text, 500) AS t FROM x) JOIN (SELECT DISTINCT source AS name FROM k WHERE source <> '') ON contains(t, name)),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY freq DESC, name) AS ord FROM e0) WHERE ord <= 5)"""
_TOKENS = "list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), lambda q: length(q) > 1)"


@query(f"WITH {_CARDS} SELECT ctx, name, freq, ord::INT AS ord FROM e")
def context_entities(spark, sf_dir):
    """O4."""
    names = cards(spark, sf_dir).select(F.col("source").alias("name"))
    return retrieval.entities(contexts(spark, sf_dir), names, "ctx").select("ctx", "name", "freq", "ord")


@query()
def dictionary_cuts(spark, sf_dir):
    """Benchmark texts without their white space, cut by a dictionary of the words of all documents. Holds no SQL: the
    best path is tested against brute force."""
    words = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("weight"))
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.lower(X.compact(F.col("text"))).alias("text"))
    return lattice.cut_texts(asked, "text", words, least=1, runs=False).select("item_id", F.array_join("tokens", " ").alias("cut"))


def stored_index(spark, sf_dir):
    """All documents in an index of two appends."""
    path, d = f"{work_dir(spark)}/index", docs(spark, sf_dir)
    textindex.append(d.where("doc_id % 2 = 0"), path, "doc_id")
    textindex.append(d.where("doc_id % 2 = 1"), path, "doc_id")
    return path


@query(ORACLE_SQL["bm25_topk"])
def indexed_topk(spark, sf_dir):
    """The same result as ``bm25_topk``, from a stored index by blocks whose bound reaches the k-th score."""
    out = textindex.topk(read(spark, sf_dir, "benchmark"), stored_index(spark, sf_dir), "item_id", 5)
    return out.select("item_id", F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"), "rank")


@query(f"""
WITH t AS (SELECT doc_id, {_TOKENS.format(t='text')} AS ts FROM documents),
q AS (SELECT item_id, ts[:3] AS ts FROM (SELECT item_id, {_TOKENS.format(t='text')} AS ts FROM benchmark) WHERE len(ts) >= 3),
w AS (SELECT doc_id, unnest(range(len(ts) - 2)) AS place, unnest(list_transform(range(len(ts) - 2), lambda i: ts[i + 1] || ' ' || ts[i + 2] || ' ' || ts[i + 3])) AS g FROM t WHERE len(ts) >= 3)
SELECT item_id, doc_id, place::INT AS place FROM q JOIN w ON array_to_string(ts, ' ') = g
""")
def phrase_hits(spark, sf_dir):
    """Where the first three tokens of each benchmark item follow one another in a document, by stored positions."""
    asked = read(spark, sf_dir, "benchmark")
    first = F.slice(S.tokens(F.col("text")), 1, 3)
    asked = asked.select("item_id", F.array_join(first, " ").alias("text")).where(F.size(first) == 3)
    out = textindex.phrases(asked, stored_index(spark, sf_dir), "item_id")
    return out.select("item_id", F.col("doc").alias("doc_id"), F.col("at").cast("int").alias("place"))


_SEARCH = f"""
{_CARDS},
q AS (SELECT x.ctx, x.at_, coalesce((SELECT string_agg(name, ' ' ORDER BY ord) FROM e WHERE e.ctx = x.ctx), '') || ' ' || right(text, 150) AS qt FROM x),
t AS (SELECT doc_ord, {_TOKENS.format(t='text')} AS ts FROM k),
p AS (SELECT doc_ord, term, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_ord, len(ts) AS n, unnest(ts) AS term FROM t) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term, n),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM f) ELSE raw END AS idf FROM f),
a AS (SELECT ctx, term, count(*) AS qf FROM (SELECT ctx, unnest({_TOKENS.format(t='qt')}) AS term FROM q) GROUP BY ALL),
b AS (SELECT ctx, doc_ord, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 9) AS score FROM a JOIN i USING (term) JOIN p USING (term), s GROUP BY ALL HAVING score > 0),
u AS (SELECT ctx, doc_ord, 0 AS tier, depth AS prio, ord, 9999.0 AS score FROM e JOIN k ON name = source
  UNION ALL SELECT ctx, doc_ord, 1, 0, ord, 9998.0 FROM e JOIN k ON contains(source, name) AND name <> source
  UNION ALL SELECT ctx, doc_ord, 2, 0, 0, round_even(score, 4) FROM b),
v AS (SELECT u.*, k.source, row_number() OVER (PARTITION BY u.ctx, u.doc_ord ORDER BY tier, prio, ord, score DESC) AS r FROM u JOIN k USING (doc_ord) JOIN x USING (ctx) WHERE at_ IS NULL OR (rev <= at_ AND vf <= at_ AND (vt IS NULL OR vt >= at_))),
h AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY tier, prio, ord, score DESC, doc_ord) AS rank FROM v WHERE r = 1)"""


def found(spark, sf_dir, k):
    ctx, c = contexts(spark, sf_dir), cards(spark, sf_dir)
    names = settle(retrieval.entities(ctx, c.select(F.col("source").alias("name")), "ctx"), f"{work_dir(spark)}/names")
    listed = names.groupBy("ctx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), " ").alias("names"))
    end = ctx.select("ctx", F.right("text", F.lit(150)).alias("end"), "at")
    asked = end.join(listed, "ctx", "left").select("ctx", F.concat_ws(" ", F.coalesce("names", F.lit("")), "end").alias("text"), "at")
    return retrieval.search_cards(asked, names, c, "ctx", k)


@query(f"WITH {_SEARCH} SELECT ctx, rank::INT AS rank, doc_ord, source, round(score, 3) AS score FROM h WHERE rank <= 4")
def search_cards(spark, sf_dir):
    """Tiers by name, then BM25, cards visible at the context's point in time only."""
    return found(spark, sf_dir, 4).select("ctx", "rank", "doc_ord", "source", F.round("score", 3).alias("score"))


@query(f"""
WITH {_SEARCH},
l AS (SELECT conv_id, turn, unnest(range(len(ls))) AS line, unnest(ls) AS s FROM (SELECT conv_id, turn, {_lines()} AS ls FROM conversations WHERE role = 'assistant')),
w AS (SELECT conv_id || '/' || turn AS path, line, s, array_to_string(list(s) OVER (PARTITION BY conv_id, turn ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS block FROM l),
m AS (SELECT e.ctx, e.ord, block, row_number() OVER (PARTITION BY e.ctx, e.name ORDER BY path, line) AS r FROM e JOIN w ON contains(s, name) WHERE e.ord <= 3),
g AS (SELECT ctx, list(block ORDER BY o, r) AS bs FROM (SELECT ctx, block, min(ord * 10 + r) AS o, 0 AS r FROM m WHERE r <= 2 GROUP BY ctx, block) GROUP BY ctx)
SELECT x.ctx, coalesce((SELECT string_agg(name, '|' ORDER BY ord) FROM e WHERE e.ctx = x.ctx), '') AS entities, coalesce((SELECT string_agg(source, '|' ORDER BY rank) FROM h WHERE h.ctx = x.ctx AND rank <= 3), '') AS sources,
  md5(coalesce(array_to_string(bs[:3], '|'), '')) AS grep_md5 FROM x LEFT JOIN g USING (ctx)
""")
def retrieve_context(spark, sf_dir):
    """Entities, cards and passages of every context."""
    raw = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "text")
    out = retrieval.retrieve(contexts(spark, sf_dir), cards(spark, sf_dir), raw, "ctx")
    sources = F.transform(F.coalesce("bible", F.expr("cast(array() as array<struct<source:string,text:string,score:double>>)")), lambda b: b["source"])
    return out.select("ctx", F.array_join("entities", "|").alias("entities"), F.array_join(sources, "|").alias("sources"), F.md5(F.array_join("grep", "|")).alias("grep_md5"))


@query(f"""
WITH {_SEARCH},
c AS (SELECT h.ctx, h.rank, '【' || h.source || '】' || left(left(k.text, 1200), 300) AS line FROM h JOIN k USING (doc_ord) WHERE rank <= 4),
z AS (SELECT *, sum(length(line)) OVER (PARTITION BY ctx ORDER BY rank) AS used FROM c)
SELECT ctx, md5(string_agg(line, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM z WHERE used <= 700 GROUP BY ctx
""")
def card_contexts(spark, sf_dir):
    """N8."""
    out = retrieval.context_lines(found(spark, sf_dir, 4), "ctx", 700)
    return out.select("ctx", F.md5("context").alias("context_md5"))


@query(f"""
WITH {_CARDS}, s AS (SELECT ctx, at_, CASE WHEN length(ctx) % 3 = 0 THEN 'nobody' ELSE k.source END AS source, k.doc_ord AS used FROM x JOIN k ON k.doc_ord = length(x.text) % 40)
SELECT s.ctx, s.used, s.source FROM s LEFT JOIN k ON k.source = s.source AND k.doc_ord = s.used
WHERE k.source IS NULL OR NOT (at_ IS NULL OR (rev <= at_ AND vf <= at_ AND (vt IS NULL OR vt >= at_)))
""")
def card_leaks(spark, sf_dir):
    """A card is known by its number and source here."""
    c = cards(spark, sf_dir)
    tag = lambda s, n: F.concat_ws("#", s, n.cast("string"))
    s = contexts(spark, sf_dir).withColumn("used", F.length("text") % 40).join(c.select(F.col("doc_ord").cast("int").alias("used"), F.col("source").alias("name")), "used")
    s = s.withColumn("name", F.when(F.length("ctx") % 3 == 0, "nobody").otherwise(F.col("name"))).withColumn("source", tag(F.col("name"), F.col("used")))
    out = retrieval.leaks(s, c.withColumn("source", tag(F.col("source"), F.col("doc_ord"))))
    return out.select("ctx", "used", F.col("name").alias("source"))


@query(f"""
WITH s AS (SELECT (item_id % 20)::INT AS chapter, 'T' || item_id AS title, left({_bare('text')}, 30) AS summary FROM benchmark), t AS (SELECT unnest(range(0, 25)) AS target),
l AS (SELECT target, chapter, title, '[' || title || '] ' || summary AS line FROM t JOIN s ON chapter <= target),
b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY target ORDER BY chapter, title) AS up, sum(length(line) + 1) OVER (PARTITION BY target ORDER BY chapter DESC, title) AS down FROM l)
SELECT target, string_agg(line, chr(10) ORDER BY chapter, title) FILTER (up <= 400) AS oldest, string_agg(line, chr(10) ORDER BY chapter, title) FILTER (down <= 400) AS newest FROM b GROUP BY target
""")
def prior_summaries(spark, sf_dir):
    """F5, W7."""
    b = read(spark, sf_dir, "benchmark")
    s = b.select((F.col("item_id") % 20).cast("int").alias("chapter"), F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("title"), F.left(X.compact(F.col("text")), F.lit(30)).alias("summary"))
    t = spark.range(25).select(F.col("id").alias("target"), F.col("id").cast("int").alias("at"))
    up = retrieval.prior_summaries(t, s, "target").withColumnRenamed("prior", "oldest")
    return up.join(retrieval.prior_summaries(t, s, "target", descending=True).withColumnRenamed("prior", "newest"), "target")


@query(f"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS s FROM (SELECT doc_id, {_lines()} AS ls FROM documents WHERE contains(text, 'token'))),
w AS (SELECT *, array_to_string(list(s) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS block FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line)::INT AS block, greatest(line - 2, 0)::INT AS first_line, md5(block) AS block_md5 FROM w WHERE contains(s, 'token')
""")
def grep_windows(spark, sf_dir):
    """S14, the form with a window a hit."""
    return retrieval.grep(docs(spark, sf_dir), "doc_id", "token", merged=False).select("doc_id", "block", "first_line", F.md5("block_text").alias("block_md5"))


@query(f"""
WITH c AS (SELECT doc_id, raw, {_bare('raw')} AS exact FROM (SELECT doc_id, unnest({_paragraphs()}) AS raw FROM documents)),
n AS (SELECT doc_id, exact, lower(translate(exact, ' 。！？!?；;，,、：:“”‘’「」『』"''（）()【】《》….-—', '')) AS norm FROM c),
r AS (SELECT exact, lower(translate(exact, ' 。！？!?；;，,、：:“”‘’「」『』"''（）()【】《》….-—', '')) AS norm FROM (SELECT {_bare('raw')} AS exact FROM (SELECT unnest({_paragraphs()}) AS raw FROM benchmark)))
SELECT doc_id, (count(*) FILTER (exact IN (SELECT exact FROM r WHERE length(norm) >= 30)))::BIGINT AS exact_count, (count(*) FILTER (norm IN (SELECT norm FROM r WHERE length(norm) >= 30)))::BIGINT AS normalized_count
FROM n WHERE length(norm) >= 30 GROUP BY doc_id
""")
def paragraph_overlap(spark, sf_dir):
    """J6."""
    item = lambda s: overlap.items(s, "doc_id", "paragraphs", overlap.MIN_PARAGRAPH)
    out = overlap.paragraph_overlap(item(seg(spark, sf_dir)), item(bench_seg(spark, sf_dir)), "doc_id", False)
    return out.select("doc_id", "exact_count", "normalized_count")


# ---- the folds' SQL, by recursion over a session's events (their queries are in the registry)
ORACLE_SQL["session_fold"] = f"""
WITH RECURSIVE ev AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (
  SELECT conv_id, 0::BIGINT AS n, '' AS summary, '' AS tail, 0::BIGINT AS accepted, 0::BIGINT AS compressed FROM ev WHERE n = 1
  UNION ALL
  SELECT conv_id, n, CASE WHEN turn = 0 THEN '' WHEN long THEN {_strip("summary || chr(10) || '[前情节选] ' || " + _strip("left(left(t, length(t) - 2000), 200)"))} ELSE summary END,
    CASE WHEN long THEN right(t, 2000) ELSE t END, accepted + (turn <> 0)::BIGINT, compressed + long::BIGINT
  FROM (SELECT f.conv_id, ev.n, ev.turn, f.summary, f.accepted, f.compressed, CASE WHEN ev.turn = 0 THEN ev.text ELSE f.tail || CASE WHEN f.tail = '' THEN '' ELSE chr(10) END || ev.text END AS t,
          ev.turn <> 0 AND length(CASE WHEN f.tail = '' THEN '' ELSE f.tail || chr(10) END || ev.text) > 4000 AS long
        FROM f JOIN ev ON ev.conv_id = f.conv_id AND ev.n = f.n + 1))
SELECT conv_id::VARCHAR AS session, summary, tail, accepted, 0::BIGINT AS saved, compressed FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
"""
ORACLE_SQL["round_fold"] = f"""
WITH RECURSIVE ev AS (SELECT conv_id, {_paragraphs()} AS ps, {_strip('text')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (
  SELECT conv_id, 0::BIGINT AS n, []::VARCHAR[] AS seen, []::VARCHAR[] AS kept, 0::BIGINT AS rounds, false AS over FROM ev WHERE n = 1
  UNION ALL
  SELECT conv_id, n, CASE WHEN good THEN list_concat(seen, list_transform(ks, lambda q: {_bare('q')})) ELSE seen END, CASE WHEN good THEN list_append(kept, array_to_string(ks, chr(10) || chr(10))) ELSE kept END, rounds + (NOT over)::BIGINT,
    over OR length(s) < 5 OR rounds + 1 >= 8 OR coalesce(list_sum(list_transform(CASE WHEN good THEN list_append(kept, array_to_string(ks, chr(10) || chr(10))) ELSE kept END, lambda q: length(q))), 0) >= 2300
  FROM (SELECT *, NOT over AND length(s) >= 5 AND len(ks) > 0 AS good FROM (
    SELECT f.conv_id, ev.n, f.seen, f.kept, f.rounds, f.over, ev.s, CASE WHEN cut IS NULL OR cut = 0 THEN ps ELSE ps[:cut - 1] END AS ks
    FROM (SELECT f.*, ev.n AS en, list_position(list_transform(ev.ps, lambda q: length({_bare('q')}) >= 10 AND list_contains(f.seen, {_bare('q')})), true) AS cut FROM f JOIN ev ON ev.conv_id = f.conv_id AND ev.n = f.n + 1) f
    JOIN ev ON ev.conv_id = f.conv_id AND ev.n = f.en)))
SELECT conv_id AS session, array_to_string(kept, chr(10) || chr(10)) AS text, rounds FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
"""


_ACTION = "CASE WHEN turn = 0 THEN 'seed' WHEN turn % 7 = 6 THEN 'save' WHEN turn % 7 = 5 THEN 'reject' WHEN turn % 3 = 2 THEN 'replace' ELSE 'accept' END"


@query(f"""
WITH RECURSIVE ev AS (SELECT conv_id, {_ACTION} AS action, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (
  SELECT conv_id, 0::BIGINT AS n, '' AS summary, '' AS tail, '' AS last, 0::BIGINT AS accepted, 0::BIGINT AS saved, 0::BIGINT AS compressed FROM ev WHERE n = 1
  UNION ALL
  SELECT conv_id, n, CASE WHEN action = 'seed' THEN '' WHEN long THEN {_strip("summary || chr(10) || '[前情节选] ' || " + _strip("left(left(t, length(t) - 2000), 200)"))} ELSE summary END,
    CASE WHEN long THEN right(t, 2000) ELSE t END, CASE WHEN action = 'seed' THEN '' WHEN grows THEN text ELSE last END, accepted + (action = 'accept')::BIGINT, saved + (action = 'save')::BIGINT, compressed + long::BIGINT
  FROM (SELECT *, grows AND length(t) > 4000 AS long FROM (
    SELECT *, action = 'accept' OR fits AS grows, CASE WHEN action = 'seed' THEN text WHEN action = 'accept' THEN tail || CASE WHEN tail = '' THEN '' ELSE chr(10) END || text WHEN fits THEN left(tail, length(tail) - length(last)) || text ELSE tail END AS t
    FROM (SELECT f.conv_id, ev.n, ev.action, ev.text, f.summary, f.tail, f.last, f.accepted, f.saved, f.compressed, ev.action = 'replace' AND f.last <> '' AND ends_with(f.tail, f.last) AS fits FROM f JOIN ev ON ev.conv_id = f.conv_id AND ev.n = f.n + 1))))
SELECT conv_id::VARCHAR AS session, summary, tail, accepted, saved, compressed FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
""")
def session_edits(spark, sf_dir):
    """Sessions whose log holds every action: seed, accept, replace, reject and save."""
    c = read(spark, sf_dir, "conversations")
    return session.fold_sessions(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.expr(_ACTION).alias("action"), "text"))
