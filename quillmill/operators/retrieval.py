"""Retrieval: point-in-time visibility, BM25, tiered ranking, entities, context lines, budgeted summaries.

A *card* has ``doc_ord`` (its path order), ``source``, ``text``, ``depth_class`` (0 root, 1 generated, 2 other) and the
window ``revealed_in, valid_from, valid_to``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.operators.blocks import tasks
from quillmill.operators.names import occurring
from quillmill.sources.durable import settle, work_dir

K1, B, FLOOR = 1.5, 0.75, 0.25
CARD_CHARS = 1200
#: Scores, of a query and a card each, that a task sums where queries are dealt; and parts, at most.
PAIRS, MOST_PARTS = 1_000_000, 20_000


def visible(at: Column, revealed: str = "revealed_in", start: str = "valid_from", end: str = "valid_to") -> Column:
    """seen at ``at`` if revealed and valid by then and not yet over; unknown windows are hidden; no ``at``: all."""
    known = (F.col(revealed) <= at) & (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at))
    return at.isNull() | F.coalesce(known, F.lit(False))


def path_class(path: Column, root: str) -> Column:
    """O2: 0 for a card at the root, 1 below ``generated``, else 2."""
    rel = F.regexp_replace(path, f"^{root.rstrip('/')}/", "")
    return F.when(F.instr(rel, "/") == 0, 0).when(rel.startswith("generated/"), 1).otherwise(2)


#: Bits of a point in time; an interval is a union of at most twice as many aligned blocks of 1, 2, 4, ... points.
POINT_BITS = 32
#: Targets without a point in time see every card; they meet them in so many parts.
ALL_PARTS = 64


def _blocks(start: Column, end: Column) -> Column:
    """The aligned blocks (level, number) that make up the points from ``start`` to ``end`` (null: no end)."""
    base = 1 << (POINT_BITS - 1)
    lo, hi = start.cast("long") + base, F.coalesce(end.cast("long") + base + 1, F.lit(1 << POINT_BITS))
    kind = "array<struct<level:int,block:bigint>>"
    zero = F.struct(lo.alias("lo"), hi.alias("hi"), F.expr(f"cast(array() as {kind})").alias("out"))

    def climb(s: Column, level: Column) -> Column:
        left, right = (s["lo"] < s["hi"]) & (s["lo"] % 2 == 1), (s["lo"] < s["hi"]) & (s["hi"] % 2 == 1)
        one = lambda c, n: F.when(c, F.array(F.struct(level.alias("level"), n.alias("block")))).otherwise(F.expr(f"cast(array() as {kind})"))
        out = F.concat(s["out"], one(left, s["lo"]), one(right, s["hi"] - 1))
        return F.struct(F.shiftright(s["lo"] + F.when(left, 1).otherwise(0), 1).alias("lo"), F.shiftright(s["hi"] - F.when(right, 1).otherwise(0), 1).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(POINT_BITS)), zero, climb, lambda s: s["out"])


def at_point(targets: DataFrame, rows: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """Every target with the rows whose interval holds its point, as an equality join: a point lies in one aligned block a
    level, an interval is a few blocks, and no two of them overlap, so each pair meets once."""
    base = 1 << (POINT_BITS - 1)
    levels = F.transform(F.sequence(F.lit(0), F.lit(POINT_BITS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col(at).cast("long") + base, k).alias("block")))
    t = targets.where(F.col(at).isNotNull()).select("*", F.explode(levels).alias("_b")).select("*", "_b.*").drop("_b")
    r = rows.select("*", F.explode(_blocks(start, end)).alias("_b")).select("*", "_b.*").drop("_b")
    return t.join(r, ["level", "block"]).drop("level", "block")


def visible_pairs(targets: DataFrame, cards: DataFrame, at: str = "at") -> DataFrame:
    """Every target with the cards visible at its point in time; a target without one sees all."""
    start = F.greatest("revealed_in", "valid_from")
    known = cards.where(F.col("revealed_in").isNotNull() & F.col("valid_from").isNotNull())
    free = targets.where(F.col(at).isNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(ALL_PARTS - 1))).alias("_p"))
    every = free.join(cards.withColumn("_p", F.pmod(F.xxhash64(*cards.columns), F.lit(ALL_PARTS)).cast("int")), "_p").drop("_p")
    return at_point(targets, known, at, start, F.col("valid_to")).unionByName(every)


def intervals(states: DataFrame, key: list[str], start: str) -> DataFrame:
    """Close each state where its successor begins: adds ``valid_from, valid_to`` (null while open)."""
    w = Window.partitionBy(*key).orderBy(start)
    return states.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(w) - 1)


def postings(tokenised: DataFrame, doc: str) -> DataFrame:
    """``doc, term, tf, len`` of ``tokenised(doc, tokens)``."""
    each = tokenised.select(doc, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return each.groupBy(doc, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def idf(tokenised: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``term, df, idf``; negative values become a quarter of the mean of all. ``n_docs`` has one row, ``n``: every card
    counts, hidden or empty ones too, so that what is visible doesn't change the scores."""
    df = tokenised.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return term_weights(df, n_docs)


def term_weights(df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``term, df, idf`` of ``df(term, df)``, all terms of a corpus."""
    raw = df.crossJoin(F.broadcast(n_docs)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg((FLOOR * F.avg("raw")).alias("eps"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, cards: DataFrame, query: str, doc: str, query_text: str = "text", card_text: str = "text", tokens: Callable[[Column], Column] = S.tokens, carried: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """``query, *carried, doc, score`` above 0; a query's repeated terms count each.

    Cards are tokenised once, into a table. Statistics come from all of it; only tokens that some query asks for become
    postings, each query term once with its count. With ``dealt``, for many queries on cards whose postings are small
    enough to be broadcast, queries are dealt to tasks by themselves and scores are summed there, about ``PAIRS`` a task.
    """
    work = work_dir(cards.sparkSession)
    made = settle(cards.select(doc, tokens(F.col(card_text)).alias("tokens")), f"{work}/tokens")
    stats = made.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    weight = idf(made, stats.select("n"))
    split = queries.select(query, *carried, tokens(F.col(query_text)).alias("_t"))
    if dealt:
        parts = -(-queries.count() * made.count() // PAIRS)
        split = split.repartition(min(MOST_PARTS, max(tasks(cards.sparkSession), parts)), query)
    asked = split.select(query, *carried, F.explode("_t").alias("term")).groupBy(query, *carried, "term").agg(F.count("*").alias("qf"))
    if dealt:
        posts = postings(made, doc).join(weight, "term").crossJoin(F.broadcast(stats.select("avgdl")))
        hit = asked.join(settle(posts, f"{work}/postings"), "term")
    else:
        wanted = asked.select("term").distinct()
        each = made.select(doc, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
        posts = each.groupBy(doc, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        hit = asked.join(weight, "term").join(posts, "term").crossJoin(F.broadcast(stats.select("avgdl")))
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("len") / F.col("avgdl"))
    part = F.col("qf") * F.col("idf") * tf * (K1 + 1) / (tf + norm)
    return hit.groupBy(query, *carried, doc).agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def bm25_topk(queries: DataFrame, cards: DataFrame, query: str, doc: str, k: int, **kw) -> DataFrame:
    """O3: the best ``k``, ties to the smaller document."""
    by = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return bm25(queries, cards, query, doc, **kw).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def entities(contexts: DataFrame, names: DataFrame, key: str, text: str = "text", top: int = 5, last: int = 500, others: DataFrame | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """Known names that occur in the end of a context: by frequency, then cards' names before ``others``'s, then by
    name (a total order). ``others(name)`` are what a recogniser found: under two characters and stop words don't count."""
    t = contexts.select(key, F.when(F.length(text) <= last, F.col(text)).otherwise(F.right(text, F.lit(last))).alias("_t"))
    known = names.select("name", F.lit(0).alias("tier"))
    if others is not None:
        known = known.union(others.where((F.length("name") > 1) & ~F.col("name").isin(*stop)).select("name", F.lit(1)))
    known = known.groupBy("name").agg(F.min("tier").alias("tier"))
    hit = occurring(t, "_t", known, "name")
    order = [F.desc("freq"), "name"]
    if others is not None:
        hit, order = hit.join(known, "name"), [F.desc("freq"), "tier", "name"]
    by = Window.partitionBy(key).orderBy(*order)
    return hit.select(key, "name", "freq", *order[1:-1]).withColumn("ord", F.row_number().over(by)).where(F.col("ord") <= top).select(key, "name", "freq", "ord")


def search_cards(queries: DataFrame, found: DataFrame, cards: DataFrame, query: str, k: int, at: str = "at", tokens: Callable[[Column], Column] = S.tokens) -> DataFrame:
    """Exact source matches (by path class, then entity, then order), then sources that contain an entity, then
    BM25; a card keeps its best place; hidden ones are out; cut to ``k`` after all.

    ``queries(query, text, at)``, ``found(query, name, ord)``. Of what BM25 finds only the best ``k`` visible cards go on:
    each card that a name brings before them takes one of the ``k`` places, so no more are needed. Texts join at the end.
    """
    work = work_dir(cards.sparkSession)
    c = cards.select("doc_ord", "source", "depth_class", "revealed_in", "valid_from", "valid_to")
    named = settle(found.select(query, "name", "ord"), f"{work}/named")
    asked = settle(queries.select(query, "text", at), f"{work}/asked")
    exact = named.join(c, F.col("name") == F.col("source")).select(query, "doc_ord", F.lit(0).alias("tier"), F.col("depth_class").alias("prio"), "ord", F.lit(9999.0).alias("score"))
    weak = named.join(occurring(c.select("doc_ord", "source"), "source", named, "name").drop("freq"), "name").where("name <> source").select(query, "doc_ord", F.lit(1).alias("tier"), F.lit(0).alias("prio"), "ord", F.lit(9998.0).alias("score"))
    seen = lambda rows: rows.join(c.drop("source", "depth_class"), "doc_ord").where(visible(F.col(at)))
    text = seen(bm25(asked, cards, query, "doc_ord", tokens=tokens, carried=(at,), dealt=True).withColumn("score", F.bround("score", 4)))
    text = text.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "doc_ord"))).where(F.col("_r") <= k)
    place = [query, "doc_ord", "tier", "prio", "ord", "score"]
    by_name = seen(exact.union(weak).join(asked.select(query, at), query)).select(*place)
    all_ = by_name.union(text.select(query, "doc_ord", F.lit(2).alias("tier"), F.lit(0).alias("prio"), F.lit(0).alias("ord"), "score"))
    order = ["tier", "prio", "ord", F.desc("score"), "doc_ord"]
    once = all_.repartition(query).withColumn("_r", F.row_number().over(Window.partitionBy(query, "doc_ord").orderBy(*order))).where("_r = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(cards.select("doc_ord", "source", F.left("text", F.lit(CARD_CHARS)).alias("text")), "doc_ord").select(query, "rank", "doc_ord", "source", "text", "score")


def grep(docs: DataFrame, key: str, keyword: str, context: int = 2, text: str = "text", merged: bool = True) -> DataFrame:
    """Blocks of lines around a fixed string: ``key, block, first_line, block_text``. ``merged`` unites blocks that
    touch; otherwise each hit has a window of its own."""
    each = docs.where(F.contains(F.col(text), F.lit(keyword))).select(key, F.posexplode(S.lines(F.col(text))).alias("line", "s"))
    w = Window.partitionBy(key).orderBy("line")
    hit = F.contains(F.col("s"), F.lit(keyword))
    if not merged:
        around = F.collect_list("s").over(w.rowsBetween(-context, context))
        own = each.withColumn("_a", around).where(hit)
        return own.select(key, F.row_number().over(w).alias("block"), F.greatest(F.col("line") - context, F.lit(0)).alias("first_line"), F.array_join("_a", "\n").alias("block_text"))
    near = F.max(hit.cast("int")).over(w.rowsBetween(-context, context)) == 1
    kept = each.withColumn("_n", near).where("_n").withColumn("_new", F.when(F.lag("line").over(w) == F.col("line") - 1, 0).otherwise(1))
    kept = kept.withColumn("block", F.sum("_new").over(w))
    return kept.groupBy(key, "block").agg(F.min("line").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("block_text"))


def budget_prefix(rows: DataFrame, key: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """Rows until the first that would overflow the budget; costs are positive, so a filter is a stop."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def prior_summaries(targets: DataFrame, summaries: DataFrame, key: str, up_to: str = "at", budget: int = 400, descending: bool = False) -> DataFrame:
    """One text a target of the summaries up to its chapter, oldest first, within the budget. Oldest first, all
    targets share one run of at most ``budget`` summaries; ``descending``, each has its own."""
    s = summaries.withColumn("_line", F.concat(F.lit("["), F.col("title"), F.lit("] "), F.col("summary")))
    order = [F.desc("chapter") if descending else "chapter", "title"]
    if descending:
        met = at_point(targets.select(key, up_to), s, up_to, F.col("chapter"), F.lit(None).cast("int"))
    else:
        head = s.orderBy(*order).limit(budget)  # a line costs 1 or more
        met = at_point(targets.select(key, up_to), head, up_to, F.col("chapter"), F.lit(None).cast("int"))
    kept = budget_prefix(met, [key], order, F.length("_line") + 1, budget)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "title", "_line"))), lambda x: x["_line"]), "\n").alias("prior"))


def context_lines(hits: DataFrame, key: str, budget: int = 1500, clip: int = 300) -> DataFrame:
    """The ranked cards of a target as one text, up to the first that would overflow the budget: ``key, context``.
    ``hits(key, rank, source, text)`` are cards visible before the target."""
    line = F.concat(F.lit("【"), F.col("source"), F.lit("】"), F.left("text", F.lit(clip)))
    kept = budget_prefix(hits.withColumn("_line", line), [key], ["rank"], F.length("_line"), budget)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda x: x["_line"]), "\n\n").alias("context"))


def retrieve(contexts: DataFrame, cards: DataFrame, raw: DataFrame | None, key: str, k: int = 3, grep_k: int = 2, at: str = "at") -> DataFrame:
    """Entities of the last 500 characters, cards for entities and the last 150, and grep blocks of the first three
    entities: ``key, entities, bible, grep``. ``raw(path, text)`` isn't bound in time; leave it out where that leaks."""
    names = cards.select(F.col("source").alias("name"))
    found = settle(entities(contexts, names, key), f"{work_dir(contexts.sparkSession)}/entities")
    listed = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("entities"))
    ctx = contexts.select(key, at, F.right("text", F.lit(150)).alias("_end")).join(listed, key, "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    query = F.concat_ws(" ", F.array_join("entities", " "), "_end")
    hits = search_cards(ctx.select(key, query.alias("text"), at), found, cards, key, k, at)
    bible = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "text", "score"))), lambda x: F.struct(x["source"].alias("source"), x["text"].alias("text"), x["score"].alias("score"))).alias("bible"))
    out = ctx.join(bible, key, "left")
    if raw is None:
        return out.select(key, "entities", "bible", F.array().cast("array<string>").alias("grep"))
    first = found.where("ord <= 3").select(key, "name", "ord")
    lines = raw.select("path", F.posexplode(S.lines(F.col("text"))).alias("line", "s"))
    # the first hits of a name are the same for every context that asks for it
    by = Window.partitionBy("name").orderBy("path", "line")
    hits = occurring(lines, "s", first, "name").select("path", "line", "name").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= grep_k)
    hits = settle(hits, f"{work_dir(raw.sparkSession)}/hits")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(-2, 2)
    around = lines.join(hits.select("path").distinct(), "path", "left_semi").withColumn("block", F.array_join(F.collect_list("s").over(w), "\n"))
    made = settle(hits.join(around.select("path", "line", "block"), ["path", "line"]), f"{work_dir(raw.sparkSession)}/blocks")
    # equal blocks have one number, and contexts choose by numbers; the texts join at the end
    texts = settle(made.groupBy("block").agg(F.min(F.struct("name", "_r")).alias("n")), f"{work_dir(raw.sparkSession)}/texts")
    met = first.join(made.join(texts, "block").select("name", "_r", "n"), "name")
    chosen = met.groupBy(key).agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_r", "n"))), lambda x: x["n"])), 1, k).alias("_n"))
    out = out.join(chosen, key, "left")
    for i in range(k):
        out = out.join(texts.select(F.col("n").alias(f"_n{i}"), F.col("block").alias(f"_b{i}")), F.get("_n", F.lit(i)) == F.col(f"_n{i}"), "left")
    return out.select(key, "entities", "bible", F.array_compact(F.array(*[f"_b{i}" for i in range(k)])).alias("grep"))


def leaks(samples: DataFrame, cards: DataFrame, source: str = "source", at: str = "at") -> DataFrame:
    """Used cards that weren't visible, or aren't known, at the sample's point in time."""
    c = cards.select(F.col("source").alias("_s"), "revealed_in", "valid_from", "valid_to")
    return samples.join(c, F.col(source) == F.col("_s"), "left").where(F.col("_s").isNull() | ~visible(F.col(at))).drop("_s")
