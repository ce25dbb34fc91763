"""Queries of samples, labels, audits and training rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.operators import datasets, prompts, samples
from quillmill.plans.registry import _TURNS, _WS, _bare, _sentences, _strip, docs, query, read, turns


def sectioned(spark, sf_dir):
    """Conversations' turns as samples of a section, and a label for most of them, some of them off."""
    c = read(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"), "conv_id", "turn")
    s = c.select("sample_id", F.element_at(F.array(F.lit("main"), F.lit("extras"), F.lit("vol4")), (F.col("turn") % 3 + 1).cast("int")).alias("source_section"))
    k = F.col("conv_id") % 5 + F.col("turn")
    label = c.select(
        F.when(k % 7 == 6, F.concat("sample_id", F.lit("?"))).otherwise(F.col("sample_id")).alias("sample_id"),
        F.when(k % 5 == 4, "main").when(k % 11 == 10, "other").otherwise(F.element_at(F.array(F.lit("main"), F.lit("extras"), F.lit("vol4")), (F.col("turn") % 3 + 1).cast("int"))).alias("source_section"),
        F.when(k % 4 == 3, "loud").otherwise(F.lit("mild")).alias("content_sensitivity"),
        F.when(k % 6 == 5, 1.5).otherwise(F.lit(0.5)).alias("source_section_confidence"),
        F.when(k % 9 == 8, F.lit(None).cast("double")).otherwise(F.lit(1.0)).alias("content_sensitivity_confidence"),
    )
    return s, label


_SECTIONED = """
c AS (SELECT conv_id || '/' || turn AS id, conv_id % 5 + turn AS k, ['main', 'extras', 'vol4'][turn % 3 + 1] AS sec FROM conversations),
l AS (SELECT CASE WHEN k % 7 = 6 THEN id || '?' ELSE id END AS sample_id, sec, k, CASE WHEN k % 5 = 4 THEN 'main' WHEN k % 11 = 10 THEN 'other' ELSE sec END AS lab FROM c)"""


@query(f"""
WITH {_SECTIONED}
SELECT sample_id, 'unknown sample' AS error FROM l WHERE k % 7 = 6 UNION ALL SELECT sample_id, 'section unknown' FROM l WHERE lab = 'other'
UNION ALL SELECT sample_id, 'section differs' FROM l WHERE k % 7 <> 6 AND lab <> sec UNION ALL SELECT sample_id, 'sensitivity unknown' FROM l WHERE k % 4 = 3
UNION ALL SELECT sample_id, 'source_section_confidence out of range' FROM l WHERE k % 6 = 5 UNION ALL SELECT sample_id, 'content_sensitivity_confidence out of range' FROM l WHERE k % 9 = 8
""")
def label_audit(spark, sf_dir):
    """J8, F9."""
    s, label = sectioned(spark, sf_dir)
    return samples.label_errors(s, label, ("mild",))


@query(f"""
WITH {_SECTIONED}
SELECT 'source_section' AS field, lab AS value, count(*) AS count FROM l GROUP BY lab UNION ALL SELECT 'content_sensitivity', CASE WHEN k % 4 = 3 THEN 'loud' ELSE 'mild' END, count(*) FROM l GROUP BY ALL
""")
def label_counts(spark, sf_dir):
    """A14, A15's frequencies."""
    return samples.counts(sectioned(spark, sf_dir)[1], "source_section", "content_sensitivity")


@query("""
WITH c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations),
m AS (SELECT n, CASE WHEN n % 10 = 0 THEN n - 1 WHEN n % 17 = 0 THEN NULL ELSE n END AS id FROM c), d AS (SELECT id FROM m WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
SELECT 'm' || id AS merged_sample_id, 'id null or repeated' AS error FROM m WHERE id IS NULL OR id IN (SELECT id FROM d)
UNION ALL SELECT 'm' || id, 'book unknown' FROM m WHERE n % 13 = 0 UNION ALL SELECT 'm' || id, 'section missing' FROM m WHERE n % 13 <> 0 AND n % 2 = 0 AND n % 6 = 0
UNION ALL SELECT 'm' || id, 'section unexpected' FROM m WHERE n % 13 <> 0 AND n % 2 = 1 AND n % 5 = 0 UNION ALL SELECT 'm' || id, 'no completion' FROM m WHERE n % 8 = 0 UNION ALL SELECT 'm' || id, 'role missing' FROM m WHERE n % 9 = 0
""")
def merged_audit(spark, sf_dir):
    """A15, U5."""
    from quillmill.functions.segment import global_index

    n = F.col("index")
    role = lambda r: F.struct(F.lit(r).alias("role"), F.lit("x").alias("content"))
    rows = global_index(read(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"]).select(
        F.when(n % 10 == 0, F.concat(F.lit("m"), (n - 1).cast("string"))).when(n % 17 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("m"), n.cast("string"))).alias("merged_sample_id"),
        F.when(n % 13 == 0, "novel3").when(n % 2 == 0, "novel2").otherwise("novel1").alias("source_book"),
        F.when((n % 2 == 0) & (n % 6 != 0), "extras").when((n % 2 == 1) & (n % 5 == 0), "main").alias("source_section"),
        F.when(n % 8 == 0, " \n").otherwise("words").alias("completion"),
        F.when(n % 9 == 0, F.array(role("user"))).otherwise(F.array(role("system"), role("user"))).alias("messages"),
        *[F.lit(None).cast("string").alias(c) for c in ("source_sample_id", "content_sensitivity", "source_section_confidence", "content_sensitivity_confidence", "target_chapter", "max_chapter_used")],
    )
    return samples.merged_errors(rows)


@query("""
SELECT count(*) AS total, sum((value > 400)::INT)::BIGINT AS failed, round(sum((value > 400)::INT) * 100.0 / count(*), 9) AS failed_percent, sum((user_id % 3 > 0)::INT)::BIGINT AS retried, sum(user_id % 3 + 1)::BIGINT AS attempts FROM events
""")
def call_statistics(spark, sf_dir):
    """A16."""
    e = read(spark, sf_dir, "events").select((F.col("value") > 400).alias("ollama_failed"), (F.col("user_id") % 3 + 1).alias("ollama_attempts"))
    return samples.call_statistics(e).withColumn("failed_percent", F.round("failed_percent", 9))


@query(f"""
SELECT lang, sum(m)::BIGINT AS marks, sum(n)::BIGINT AS chars, sum(s)::BIGINT AS sentences, round(CASE WHEN sum(n) = 0 THEN 0 ELSE sum(m) / sum(n) END, 9) AS density, round(CASE WHEN sum(s) = 0 THEN 0 ELSE sum(n) / sum(s) END, 9) AS mean_sentence
FROM (SELECT lang, length({_bare('text')}) AS n, length({_bare('text')}) - length(replace({_bare('text')}, ',', '')) AS m, len({_sentences()}) AS s FROM documents) GROUP BY lang
""")
def punctuation_density(spark, sf_dir):
    """A20."""
    out = samples.punctuation_density(read(spark, sf_dir, "documents").select("lang", "text"), "lang", mark=",")
    return out.withColumn("density", F.round("density", 9)).withColumn("mean_sentence", F.round("mean_sentence", 9))


@query("""
SELECT conv_id, turn, least(length(text), 400)::INT AS text_chars, least(length(role), 3)::INT AS role_chars, (least(length(text), 400) + least(length(role), 3))::INT AS total_chars FROM conversations
""")
def context_statistics(spark, sf_dir):
    """A21."""
    c = read(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return samples.context_chars(c, "key", {"text": 400, "role": 3}).select("key.*", "text_chars", "role_chars", "total_chars")


@query("""
WITH g AS (SELECT m AS model, a AS anchor, s AS seed FROM unnest(['a', 'b', 'c']) AS x(m), unnest([1, 2, 3, 4]) AS y(a), unnest([17, 42]) AS z(s))
SELECT g.* FROM g ANTI JOIN (SELECT DISTINCT ['a', 'b', 'c'][conv_id % 3 + 1] AS model, turn % 4 + 1 AS anchor, CASE WHEN turn < 2 THEN 17 ELSE 42 END AS seed FROM conversations WHERE conv_id < 9) d USING (model, anchor, seed)
""")
def pending_grid(spark, sf_dir):
    """Z4, J4, F7."""
    grid = samples.grid(spark, model=["a", "b", "c"], anchor=[1, 2, 3, 4], seed=[17, 42])
    done = read(spark, sf_dir, "conversations").where("conv_id < 9").select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("conv_id") % 3 + 1).cast("int")).alias("model"), (F.col("turn") % 4 + 1).alias("anchor"), F.when(F.col("turn") < 2, 17).otherwise(42).alias("seed"))
    return samples.pending(grid, done, ["model", "anchor", "seed"])


@query("""
WITH g AS (SELECT m AS model, a AS anchor, s AS seed FROM (SELECT DISTINCT role AS m FROM conversations), (SELECT DISTINCT conv_id AS a FROM conversations), unnest([17, 42]) AS z(s))
SELECT g.model, g.anchor, g.seed::INT AS seed FROM g ANTI JOIN (SELECT role AS model, conv_id AS anchor, CASE WHEN turn < 2 THEN 17 ELSE 42 END AS seed FROM conversations) d USING (model, anchor, seed)
""")
def pending_turns(spark, sf_dir):
    """Z4, J4, F7 over whole conversations: every role, conversation and seed that no turn has done."""
    c = read(spark, sf_dir, "conversations")
    done = c.select(F.col("role").alias("model"), F.col("conv_id").alias("anchor"), F.when(F.col("turn") < 2, 17).otherwise(42).alias("seed"))
    some = c.select(F.col("conv_id").alias("anchor")).distinct()
    roles = [r["role"] for r in c.select("role").distinct().orderBy("role").collect()]  # a handful of values
    every = some.select(F.explode(F.array(*map(F.lit, roles))).alias("model"), "anchor").select("model", "anchor", F.explode(F.array(F.lit(17), F.lit(42))).alias("seed"))
    return samples.pending(every, done, ["model", "anchor", "seed"])


_PREFILL = f"""
s AS (SELECT *, list_transform(string_split_regex(regexp_replace(recent, '{_WS}+$', '', 'g'), '[。！？]'), lambda q: {_strip('q')}) AS p FROM r),
w AS (SELECT *, CASE WHEN p[-1] <> '' THEN p[-1] WHEN len(p) > 1 THEN p[-2] ELSE '' END AS w0 FROM s),
f AS (SELECT *, CASE WHEN regexp_matches(w0, '[，,、；]') THEN regexp_extract(w0, '^([^，,、；]*)[，,、；]', 1) WHEN length(w0) <= 15 THEN regexp_replace(w0, '[。！？，,、；]+$', '') ELSE left(w0, 15) END AS begun FROM w)"""


@query(f"""
WITH r AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, text FROM conversations),
t AS (SELECT conv_id, turn, right(prev, 2000) AS recent, text FROM r WHERE turn >= 1),
k AS (SELECT (item_id % 12)::INT AS chapter, 'T' || item_id AS title, left(regexp_replace(text, '{_WS}+', '', 'g'), 30) AS summary FROM benchmark),
l AS (SELECT at_, chapter, title, '[' || title || '] ' || summary AS line FROM (SELECT DISTINCT turn - 1 AS at_ FROM t) JOIN k ON chapter <= at_),
b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY at_ ORDER BY chapter, title) AS used FROM l),
pr AS (SELECT at_, string_agg(line, chr(10) ORDER BY chapter, title) AS prior FROM b WHERE used <= 400 GROUP BY at_),
{_PREFILL.replace('FROM r)', 'FROM t)').replace('s AS', 's0 AS').replace('FROM s)', 'FROM s0)')},
u AS (SELECT conv_id, turn, text, recent, begun, CASE WHEN prior IS NULL THEN '' ELSE '【前情提要】' || chr(10) || left({_strip('prior')}, 500) || chr(10) || chr(10) END || '【当前上文】' || chr(10) || {_strip('recent')} AS usr FROM f LEFT JOIN pr ON at_ = turn - 1)
SELECT conv_id, turn::BIGINT AS target_chapter, turn - 1 AS max_chapter_used, md5(usr) AS user_md5, begun, left(text, 1200) AS completion, length(recent)::INT AS context_chars,
  md5('<|im_start|>system' || chr(10) || 'Go on.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || usr || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || left(text, 1200) || '<|im_end|>' || chr(10)) AS row_md5,
  md5({_strip('recent')}) AS context_md5 FROM u
""")
def built_samples(spark, sf_dir):
    """Samples of every conversation as a book, at the operator's own lengths; the row a trainer
    reads, and the context read back out of the prompt."""
    c = read(spark, sf_dir, "conversations")
    chapters = c.select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("heading"), F.col("text").alias("body"))
    b = read(spark, sf_dir, "benchmark")
    summaries = b.select((F.col("item_id") % 12).cast("int").alias("chapter"), F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("title"), F.left(X.compact(F.col("text")), F.lit(30)).alias("summary"))
    cards = spark.createDataFrame([], "doc_ord long, source string, text string, depth_class int, revealed_in int, valid_from int, valid_to int")
    out = samples.build_samples(chapters, cards, summaries, "Go on.", lo=1)
    user, begun = F.element_at("messages", 2)["content"], F.coalesce(F.try_element_at("messages", F.lit(3))["content"], F.lit(""))
    row = prompts.training_text(prompts.training_row(F.col("messages"), F.col("completion")))
    return out.select(F.col("book").alias("conv_id"), "target_chapter", "max_chapter_used", F.md5(user).alias("user_md5"), begun.alias("begun"), "completion", F.col("_meta.context_chars").alias("context_chars"), F.md5(row).alias("row_md5"), F.md5(prompts.context_of(prompts.flat(F.col("messages")))).alias("context_md5"))


@query(f"""
WITH t AS (SELECT conv_id, turn, role, text, ['main', 'extras', 'vol4'][conv_id % 3 + 1] AS sec, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ctx, (conv_id % 3) * 1000 + turn * 150 AS st, (conv_id % 3) * 1000 + turn * 150 + least(length(text), 400) AS en FROM conversations),
i AS (SELECT *, CASE WHEN st < 1000 THEN 'main' WHEN st < 2000 THEN 'extras' WHEN st < 3000 THEN 'vol4' END AS at_start, CASE WHEN greatest(en - 1, st) < 1000 THEN 'main' WHEN greatest(en - 1, st) < 2000 THEN 'extras' WHEN greatest(en - 1, st) < 3000 THEN 'vol4' END AS at_end FROM t)
SELECT coalesce(CASE WHEN sec = 'extras' AND turn + 1 = 1 THEN 'extras_first_without_same_section_context' WHEN length(text) < 60 THEN sec || '_completion_lt_min' WHEN at_start IS DISTINCT FROM sec THEN sec || '_completion_start_mismatch'
  WHEN at_end IS DISTINCT FROM sec THEN sec || '_completion_end_mismatch' WHEN {_strip("coalesce(ctx, '')")} = '' THEN sec || '_empty_context' END, 'kept') AS skip_reason, count(*) AS count FROM i GROUP BY ALL
""")
def sample_skips(spark, sf_dir):
    """F6, J12."""
    c, w = read(spark, sf_dir, "conversations"), Window.partitionBy("conv_id").orderBy("turn")
    start = ((F.col("conv_id") % 3) * 1000 + F.col("turn") * 150).cast("int")
    rows = c.select(F.element_at(F.array(F.lit("main"), F.lit("extras"), F.lit("vol4")), (F.col("conv_id") % 3 + 1).cast("int")).alias("section"), (F.col("turn") + 1).alias("section_index"), F.col("text").alias("completion"), F.lag("text").over(w).alias("context"), start.alias("completion_start"), (start + F.least(F.length("text"), F.lit(400))).alias("completion_end"))
    ranges = [("main", 0, 1000), ("extras", 1000, 2000), ("vol4", 2000, 3000)]
    return samples.eligible(rows, ranges, 60).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")).count()


# ---------------------------------------------------------------- trainers' rows


def shown(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""
WITH {_TURNS}, r AS (SELECT conv_id, turn, list_concat(p, c) AS a, list_concat(p, list_reverse(c)) AS b FROM t)
SELECT conv_id, turn, array_to_string(CASE WHEN a[-1] = 3 THEN a ELSE list_append(a, 3) END, ',') AS chosen, array_to_string(CASE WHEN b[-1] = 3 THEN b ELSE list_append(b, 3) END, ',') AS rejected FROM r
WHERE len(CASE WHEN a[-1] = 3 THEN a ELSE list_append(a, 3) END) <= 120 AND len(CASE WHEN b[-1] = 3 THEN b ELSE list_append(b, 3) END) <= 120
""")
def reward_rows(spark, sf_dir):
    """V4."""
    out = datasets.reward_row(turns(spark, sf_dir), 3, 120)
    return out.select("conv_id", "turn", shown("chosen_ids").alias("chosen"), shown("rejected_ids").alias("rejected"))


def labelled(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    pairs = t.select(F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id").alias("id"), F.col("role").alias("prompt"), F.left("text", F.lit(20)).alias("chosen"), F.right("text", F.lit(20)).alias("rejected"))
    return datasets.unpaired(pairs)


_KTO = """
k AS (SELECT conv_id * 100 + turn AS id, left(text, 20) AS completion, true AS label FROM conversations UNION ALL SELECT conv_id * 100 + turn, right(text, 20), false FROM conversations),
o AS (SELECT *, row_number() OVER (ORDER BY id, label DESC) AS ord FROM k)"""


@query(f"""
WITH {_KTO}, b AS (SELECT *, (ord - 1) // 6 AS batch FROM o)
SELECT id, label, completion, coalesce(lag(completion) OVER (PARTITION BY batch ORDER BY ord), last_value(completion) OVER (PARTITION BY batch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl_completion FROM b
""")
def mispaired_rows(spark, sf_dir):
    """V5."""
    from quillmill.functions.segment import global_index

    rows = global_index(labelled(spark, sf_dir).withColumn("_d", ~F.col("label")), ["id.id", "_d", "id.conv_id"]).withColumnRenamed("index", "ord")
    return datasets.mispaired(rows, 6).select("id.id", "label", "completion", "kl_completion")


@query("""
SELECT d AS desirable, u AS undesirable, round(u / d, 2) AS des_low, round(u * 1.33 / d, 2) AS des_high, round(d / 1.33 / u, 2) AS und_low, round(d / u, 2) AS und_high, k AS kept_desirable
FROM (SELECT sum((quality = 1)::INT)::BIGINT AS d, sum((quality <> 1)::INT)::BIGINT AS u, count(*) FILTER (quality = 1) AS k FROM labels)
""")
def label_balance(spark, sf_dir):
    """V6, V7."""
    rows = read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("label"))
    good, _ = datasets.split_by_label(rows)
    return datasets.balance(rows).crossJoin(F.broadcast(good.agg(F.count("*").alias("kept_desirable"))))  # one row each


@query("""
WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda q: length(q)) AS s FROM conversations),
t AS (SELECT conv_id, list(s ORDER BY turn) AS steps, list((turn % 2)::INT ORDER BY turn) AS labs FROM w GROUP BY conv_id)
SELECT conv_id, array_to_string(flatten(list_transform(steps, lambda s: list_concat(s, [7]))), ',') AS tokens,
  array_to_string(flatten(list_transform(range(1, len(steps) + 1), lambda i: list_concat(list_transform(range(len(steps[i])), lambda z: -100), [labs[i]]))), ',') AS labels,
  array_to_string(flatten(list_transform(range(1, len(steps) + 1), lambda i: list_concat(list_transform(range(len(steps[i])), lambda z: -100), [CASE WHEN i = len(steps) THEN labs[i] ELSE -100 END]))), ',') AS last_only FROM t
""")
def step_labels(spark, sf_dir):
    """V8."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda x: F.length(x)).alias("s"), (F.col("turn") % 2).cast("int").alias("l"))
    t = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s", "l"))).alias("x"))
    t = t.select("conv_id", F.transform("x", lambda e: e["s"]).alias("steps"), F.transform("x", lambda e: e["l"]).alias("labs"))
    tokens, labels = datasets.step_labels(F.col("steps"), F.col("labs"), F.array(F.lit(7)))
    _, last = datasets.step_labels(F.col("steps"), F.col("labs"), F.array(F.lit(7)), last_only=True)
    return t.select("conv_id", shown(tokens).alias("tokens"), shown(labels).alias("labels"), shown(last).alias("last_only"))


@query("""
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER () // 4 * 4 AS most FROM labels)
SELECT doc_id, (((i // 4 * 2 + r) * 4 + i % 4) * 3 + c)::BIGINT AS place, c::INT AS copy FROM i, unnest(range(2)) AS x(r), unnest(range(3)) AS y(c) WHERE i < most
""")
def repeat_order(spark, sf_dir):
    """V11 in an order by md5: every place of every copy."""
    by = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    return datasets.repeated(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", 3, 42, batch=4, repeats=2, by=by).select("doc_id", "place", F.col("copy").cast("int").alias("copy"))


@query("""
WITH n AS (SELECT count(*) AS n FROM labels)
SELECT n // 4 * 4 * 3 * 2 AS rows, n // 4 * 4 AS keys, 6 AS copies_each, n // 4 * 4 * 3 * 2 AS places, 0 AS least, n // 4 * 4 * 3 * 2 - 1 AS most, true AS batches_repeat FROM n
""")
def repeat_sampler(spark, sf_dir):
    """The order is seeded by a hash of Spark's, so what holds for every order is compared."""
    out = datasets.repeated(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", 3, 42, batch=4, repeats=2)
    per = out.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("place").alias("z"), F.min("place").alias("a"))
    whole = out.agg(F.count("*").alias("rows"), F.countDistinct("place").alias("places"), F.min("place").alias("least"), F.max("place").alias("most"))
    each = per.agg(F.count("*").alias("keys"), F.max("c").alias("copies_each"), F.bool_and(F.col("z") - F.col("a") == 4 * 3 + 2).alias("batches_repeat"))
    return whole.crossJoin(F.broadcast(each)).select("rows", "keys", "copies_each", "places", "least", "most", "batches_repeat")  # one row each


@query(f"""
WITH {_TURNS}, r AS (SELECT conv_id, turn, list_concat(list_transform(range(turn), lambda z: 0), list_transform(c, lambda x: CASE WHEN x = 4 THEN 0 ELSE x END)) AS ids FROM t)
SELECT conv_id, turn, CASE WHEN len(list_filter(ids, lambda x: x <> 0)) = 0 THEN len(ids) ELSE list_position(list_transform(ids, lambda x: x <> 0), true) - 1 END::INT AS pads,
  array_to_string(list_concat(list_filter(ids, lambda x: x <> 0), list_filter(ids, lambda x: x = 0)), ',') AS packed FROM r
""")
def pad_masks(spark, sf_dir):
    """V12."""
    t = turns(spark, sf_dir)
    ids = F.concat(F.array_repeat(F.lit(0), F.col("turn").cast("int")), F.transform("chosen_ids", lambda x: F.when(x == 4, 0).otherwise(x)))
    return t.select("conv_id", "turn", datasets.left_pads(ids, 0).alias("pads"), shown(datasets.left_packed(ids, 0)).alias("packed"))


@query(f"""
WITH {_TURNS} SELECT conv_id, turn, array_to_string(CASE WHEN p[1] = 5 THEN p ELSE list_prepend(5, p) END, ',') AS ids, len(CASE WHEN p[1] = 5 THEN p ELSE list_prepend(5, p) END)::INT AS attended FROM t
""")
def online_prompts(spark, sf_dir):
    """V15, V13's prompts."""
    out = datasets.prompt_row(turns(spark, sf_dir), 5)
    return out.select("conv_id", "turn", shown("prompt_input_ids").alias("ids"), F.aggregate("prompt_attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"))


@query("""
WITH RECURSIVE o AS (SELECT doc_id, size, row_number() OVER (ORDER BY size DESC, doc_id) AS n FROM (SELECT doc_id, least(length(coalesce(text, '')), 700)::BIGINT AS size FROM documents)),
f AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, []::BIGINT[] AS spaces, NULL::BIGINT AS bin, NULL::BIGINT AS "offset"
  UNION ALL
  SELECT n, doc_id, CASE WHEN k IS NULL THEN list_append(spaces, greatest(512 - size, 0)) ELSE list_transform(spaces, lambda x, i: CASE WHEN i = k THEN x - size ELSE x END) END,
    coalesce(k - 1, len(spaces)), CASE WHEN k IS NULL THEN 0 ELSE 512 - spaces[k] END
  FROM (SELECT o.n, o.doc_id, o.size, f.spaces, list_position(f.spaces, list_min(list_filter(f.spaces, lambda x: x >= o.size AND x > 0))) AS k FROM f JOIN o ON o.n = f.n + 1))
SELECT doc_id, bin, "offset" FROM f WHERE n > 0
""")
def packed_layout(spark, sf_dir):
    """V2: the bin and place of every row, as a sequential pass has them."""
    d = docs(spark, sf_dir).select("doc_id", F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(700)).alias("size"))
    return datasets.pack_best_fit(d, "doc_id", "size", 512).select("doc_id", "bin", "offset")


@query("SELECT count(*) AS rows, count(*) AS keys, sum(size)::BIGINT AS tokens, 0::BIGINT AS over_full, 0::BIGINT AS gaps FROM (SELECT least(length(text), 700) AS size FROM documents)")
def packed_bins(spark, sf_dir):
    """V2: which bins there are depends on the parts, so what holds for any packing is compared."""
    d = docs(spark, sf_dir).select("doc_id", F.least(F.length("text"), F.lit(700)).alias("size"))
    out = datasets.pack_best_fit(d, "doc_id", "size", 512).join(d, "doc_id")
    w = Window.partitionBy("part", "bin").orderBy("offset", F.desc("size"))
    end = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w), F.lit(0))
    out = out.withColumn("gap", (F.col("offset") != end).cast("int"))
    bins = out.groupBy("part", "bin").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.sum("gap").alias("gap"))
    over = bins.agg(F.sum(((F.col("s") > 512) & (F.col("n") > 1)).cast("long")).alias("over_full"), F.sum("gap").alias("gaps"))
    whole = out.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("keys"), F.sum("size").alias("tokens"))
    return whole.crossJoin(F.broadcast(over))  # one row each


@query("SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END + 0.5 * user_id, 6) AS reward FROM events")
def weighted_rewards(spark, sf_dir):
    """V9's sum: null and NaN rewards count nothing."""
    e = read(spark, sf_dir, "events")
    first = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return e.select("event_id", F.round(datasets.total_reward([first, F.col("user_id")], [1.0, 0.5]), 6).alias("reward"))


