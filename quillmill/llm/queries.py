"""The registered queries of this subpackage: each applies one operator to its whole table, and its DuckDB SQL where SQL
can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import ann, divergence, embedding_dedup, html_extract, langid, merkle, mixing, ngram_join, packing, pii, records, resampling, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100).withColumnRenamed("id", "doc_id")


def ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with the number of links of each row, for which op1's SQL has no column."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100, count_links=True).withColumnRenamed("id", "doc_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_power_of_two(table(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null for null."""
    return F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))


#: The tree of ``documents``: a domain by the number of the source, then language, then source.
def tree() -> dict[str, Column]:
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("source", "([0-9]{1,6})$", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(-1))
    return {"domain": F.when(number < 1, "crawl").when(number < 10, "web").otherwise("curated"), "lang": F.col("lang"), "source": F.col("source")}


#: Target weights: fixed for domains and languages, smoothed by size for sources.
def target_weights() -> dict[str, Column]:
    domain = F.when(F.col("domain") == "crawl", 3.0).when(F.col("domain") == "web", 3.0).otherwise(4.0)
    lang = F.when(F.col("lang") == "en", 6.0).when(F.col("lang") == "es", 1.0).otherwise(1.5)
    return {"domain": domain, "lang": lang, "source": F.sqrt("tokens")}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_sources(docs, tree(), target_weights(), words(F.col("text"))).select("doc_id", "domain", "lang", "source", "epoch", "tokens", "taken")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_token_records(table(spark, sf_dir, "documents"))
    return records.read_token_records(spark, manifest, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_pii, op3_langid, op4_substring_dedup, op5_packing, op6_ann, op7_html, op8_embedding_dedup, op9_mixing, op10_token_records, op11_resampling, op12_divergence, op13_fingerprints, ngram_links)}

_WORDS = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 85 * (x.n + y.n - o.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

LINKS_SQL = OP1_SQL.replace("c.m AS component_id\n", "c.m AS component_id, coalesce(l.n, 0)::BIGINT AS n_links\n") + "LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = d.doc_id\n"

OP4_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS r(i) WHERE len(ws) >= 35),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win SEMI JOIN rep USING (h), unnest(range(0, 35)) AS r(k)),
each_word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""


def _fill(name: str, source: str, parent: str, budget: str) -> str:
    """One level of the split: children of ``parent`` in ``source(v, cap, ...)`` by weight, capped."""
    part = f"PARTITION BY {parent} ORDER BY cap / v" if parent else "ORDER BY cap / v"
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_0 AS (SELECT *, ({budget} - coalesce(sum(cap) OVER ({part}, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(v) OVER ({part}, path ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {source}),
{name} AS (SELECT *, least(cap, greatest(max(lev) OVER ({over}) * v, 0)) AS got FROM {name}_0)"""


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(text, '{_WORDS}'))::BIGINT AS tokens,
    CASE WHEN coalesce(try_cast(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS INT), -1) < 1 THEN 'crawl'
         WHEN coalesce(try_cast(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS INT), -1) < 10 THEN 'web' ELSE 'curated' END AS domain
  FROM documents),
t AS (SELECT * FROM d WHERE tokens > 0),
l3 AS (SELECT domain, lang, source, source AS path, sum(tokens)::DOUBLE AS tokens, 4 * sum(tokens)::DOUBLE AS cap, sqrt(sum(tokens)::DOUBLE) AS v FROM t GROUP BY ALL),
l2 AS (SELECT domain, lang, lang AS path, sum(cap) AS cap, CASE lang WHEN 'en' THEN 6.0 WHEN 'es' THEN 1.0 ELSE 1.5 END::DOUBLE AS v FROM l3 GROUP BY domain, lang),
l1 AS (SELECT domain, domain AS path, sum(cap) AS cap, CASE domain WHEN 'curated' THEN 4.0 ELSE 3.0 END::DOUBLE AS v, (SELECT sum(tokens)::DOUBLE FROM t) AS total FROM l2 GROUP BY domain),
{_fill("b1", "l1", "", "total").strip()},
k2 AS (SELECT l2.*, b1.got AS up FROM l2 JOIN b1 USING (domain)),
{_fill("b2", "k2", "domain", "up").strip()},
k3 AS (SELECT l3.*, b2.got AS up FROM l3 JOIN b2 ON l3.domain = b2.domain AND l3.lang IS NOT DISTINCT FROM b2.lang),
{_fill("b3", "k3", "domain, lang", "up").strip()},
plan AS (SELECT domain, lang, source, tokens, floor(round(got, 6))::BIGINT AS budget FROM b3),
runs AS (
  SELECT t.doc_id, t.domain, t.lang, t.source, e.epoch, t.tokens, p.budget,
    sum(t.tokens) OVER (PARTITION BY t.domain, t.lang, t.source ORDER BY e.epoch, md5('17:' || e.epoch || ':' || coalesce(t.doc_id::VARCHAR, 'null')), t.tokens) - t.tokens AS start
  FROM t JOIN plan p ON p.domain = t.domain AND p.lang IS NOT DISTINCT FROM t.lang AND p.source IS NOT DISTINCT FROM t.source, unnest(range(0, 5)) AS e(epoch))
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens, least(tokens, budget - start)::BIGINT AS taken FROM runs WHERE start < budget
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM, _LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

RESAMPLING_SQL = rf"""
WITH poly AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)),
t AS (
  SELECT 0 AS side, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents
  UNION ALL SELECT 1, row_number() OVER (), regexp_extract_all({_LOWER}, '{_ALNUM}') FROM benchmark),
f AS (
  SELECT side, r, unnest(ws) AS g FROM t
  UNION ALL SELECT side, r, ws[i] || ' ' || ws[i + 1] FROM t, unnest(range(1, len(ws))) AS u(i)),
raw AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM f)),
code AS (SELECT g, xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2), lambda k: ('0x' || h[k : k + 1])::BIGINT),
    lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 10000 AS bucket FROM raw, poly),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN code USING (g) GROUP BY bucket),
total AS (SELECT count(*) FILTER (side = 0) AS s_all, count(*) FILTER (side = 1) AS t_all FROM f),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM n, total),
w AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS total FROM f JOIN code USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
d AS (
  SELECT doc_id, len(ws) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
    ('0x' || left(sha256('7:' || doc_id), 8))::BIGINT AS h
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) JOIN (SELECT r, ws FROM t WHERE side = 0) USING (r) LEFT JOIN w USING (r)),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS most FROM s WHERE words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM s LEFT JOIN k USING (doc_id)
"""

DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '{_LETTERS}') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_all FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n_all) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(m.total, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n_all + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN m ON m.lang = g.lang AND m.source = g.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op11_resampling": RESAMPLING_SQL, "op12_divergence": DIVERGENCE_SQL, "op1_ngram_join": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op8_embedding_dedup": OP8_SQL, "op9_mixing": MIX_SQL, "ngram_links": LINKS_SQL}
