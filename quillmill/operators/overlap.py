"""Overlap between candidate and reference texts: semi joins, shingles, near matches, longest common substring.

``ref`` and ``cand`` are frames of :func:`quillmill.operators.metrics.segmented`. With ``pair`` set, rows meet only
within equal values of that key; without it, every candidate is held against the whole reference.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.functions import text as X
from quillmill.operators.blocks import spread, tasks
from quillmill.operators.commonsub import gram_counts, longest_common
from quillmill.operators.metrics import pair_score
from quillmill.operators.nearjoin import near_best
from quillmill.sources.durable import settle, work_dir

MIN_SENTENCE, MIN_PARAGRAPH, MIN_VISIBLE, NEAR = 8, 30, 12, 0.88


def items(seg: DataFrame, key: str, column: str = "sentences", least: int = MIN_SENTENCE) -> DataFrame:
    """``key, pos, raw, exact, norm, visible`` of pieces with ``least`` effective characters."""
    # made before the rows are, so that a condition on norm doesn't make it twice
    made = F.transform(column, lambda s: F.struct(s.alias("raw"), X.compact(s).alias("exact")))
    made = F.transform(made, lambda s: F.struct(s["raw"].alias("raw"), s["exact"].alias("exact"), X.bare_lower(s["exact"]).alias("norm")))
    out = seg.select(key, F.posexplode(made).alias("pos", "_s")).select(key, "pos", "_s.*")
    return out.where(F.length("norm") >= least).withColumn("visible", F.length("exact"))


def plain_items(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """:func:`items` of sentences as the SQL of J1 and J2 cuts them."""
    return items(spread(docs.select(key, text)).select(key, S.plain_sentences(F.col(text)).alias("sentences")), key)


def sentence_overlap(cand: DataFrame, ref: DataFrame, key: str, pair: bool, column: str) -> DataFrame:
    """J1 (column exact) or J2 (column norm): ``key, total, matched, ratio`` of every candidate with an item."""
    out = sentence_overlaps(cand, ref, key, pair, (column,))
    return out.select(key, "total", F.col(f"{column}_matched").alias("matched"), X.ratio(F.col(f"{column}_matched"), F.col("total")).alias("ratio"))


def sentence_overlaps(cand: DataFrame, ref: DataFrame, key: str, pair: bool, columns: tuple[str, ...] = ("exact", "norm")) -> DataFrame:
    """J1 and J2 over one pass of the candidates: ``key, total`` and how many items match by each column."""
    on = [key] if pair else []
    met = cand.select(key, *columns)
    for c in columns:
        met = met.join(ref.select(*on, c).distinct().withColumn(f"_{c}", F.lit(True)), [*on, c], "left")
    return met.groupBy(key).agg(F.count("*").alias("total"), *[F.count(f"_{c}").alias(f"{c}_matched") for c in columns])


def shingle_overlap(cand: DataFrame, ref: DataFrame, key: str, pair: bool, k: int, text: str = "text") -> DataFrame:
    """The candidate's multiset of k-grams (without white space and punctuation) against the reference's set.

    Totals are arithmetic; of the grams only those that the reference holds are counted, and they are matched as text,
    so no hash can err. A reference small enough to be broadcast leaves the candidate's grams where they are.
    """
    grams = lambda df: df.select(key, F.explode(X.shingles(X.normalized(F.col(text)), k)).alias("gram"))
    on = [key, "gram"] if pair else ["gram"]
    hit = grams(cand).join(grams(ref).select(*on).distinct(), on, "left_semi").groupBy(key).agg(F.count("*").alias("matched"))
    n = F.greatest(F.length(X.normalized(F.col(text))) - (k - 1), F.lit(0)).cast("long")
    total = cand.groupBy(key).agg(F.sum(n).alias("total")).where("total > 0")
    return total.join(hit, key, "left").select(key, "total", F.coalesce("matched", F.lit(0)).alias("matched"))


def sequence_ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit; the matching blocks of difflib are one, so never longer."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _near_whole(cand: DataFrame, ref: DataFrame, key: str, threshold: float) -> DataFrame:
    """Each candidate item against all of the reference, in blocks of its inverted file; what is found is little."""
    own, other = cand.where(F.col("visible") >= MIN_VISIBLE), ref.where(F.col("visible") >= MIN_VISIBLE)
    some = settle(near_best(own, other, threshold, MIN_SENTENCE, common_subsequence, sequence_ratio), f"{work_dir(cand.sparkSession)}/near")
    some = some.join(ref.select("exact").distinct(), "exact", "left_anti").join(ref.select("norm").distinct(), "norm", "left_anti")
    first = other.groupBy(F.col("norm").alias("ref_norm")).agg(F.min(F.struct(F.col(key).alias("ref_key"), F.col("pos").alias("ref_pos"), F.col("raw").alias("ref_raw"))).alias("r"))
    best = Window.partitionBy(key, "pos").orderBy(F.desc("similarity"), "r.ref_key", "r.ref_pos")
    met = some.join(first, "ref_norm").withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return met.select(*cand.columns, "similarity", "r.ref_key", "r.ref_pos", "ref_norm", "r.ref_raw")


def near_matches(cand: DataFrame, ref: DataFrame, key: str, pair: bool, threshold: float = NEAR) -> DataFrame:
    """The best reference item of each candidate item that has no exact or normalised twin.

    Blocked on shared trigrams: a ratio of t needs matching characters, so pairs under the length gap, or with too few
    common trigrams or characters, are cut before difflib runs. Ties go to the earliest reference item.
    """
    if not pair:
        return _near_whole(cand, ref, key, threshold)
    on = [key]
    own = cand.where(F.col("visible") >= MIN_VISIBLE).join(ref.select(*on, "exact").distinct(), [*on, "exact"], "left_anti").join(ref.select(*on, "norm").distinct(), [*on, "norm"], "left_anti")
    other = ref.where(F.col("visible") >= MIN_VISIBLE).select(*on, F.col("pos").alias("ref_pos"), F.col("norm").alias("ref_norm"), F.col("raw").alias("ref_raw"))
    tri = lambda df: df.select("*", F.explode(F.array_distinct(X.shingles(F.col("norm"), 3))).alias("tri"))
    o = other.select("*", F.explode(F.array_distinct(X.shingles(F.col("ref_norm"), 3))).alias("tri"))
    long, short = F.greatest(F.length("norm"), F.length("ref_norm")), F.least(F.length("norm"), F.length("ref_norm"))
    pairs = tri(own).join(o, [*on, "tri"]).where(long - short <= F.greatest(F.lit(8), F.floor(long * 0.4)))
    # ratio = 2 * matching / (both lengths) <= 2 * short / (both lengths)
    pairs = pairs.where(2 * short >= threshold * (long + short)).dropDuplicates([key, "pos", "ref_pos"])
    scored = pairs.withColumn("similarity", pair_score(sequence_ratio)("norm", "ref_norm")).where(F.col("similarity") >= threshold)
    best = Window.partitionBy(key, "pos").orderBy(F.desc("similarity"), "ref_pos")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "tri")


def common_substring(a: str, b: str) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest common substring; earliest in a, then in b.

    A suffix automaton of ``b`` is walked by ``a``: linear in both.
    """
    link, length, first, nxt = [-1], [0], [0], [{}]
    last = 0
    for i, ch in enumerate(b):
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        first.append(i)
        nxt.append({})
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                nxt.append(dict(nxt[q]))
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    best, at, where, state, n = 0, 0, 0, 0, 0
    for i, ch in enumerate(a):
        while state and ch not in nxt[state]:
            state = link[state]
            n = length[state]
        if ch in nxt[state]:
            state = nxt[state][ch]
            n += 1
        if n > best:
            best, at, where = n, i - n + 1, first[state] - n + 1
    return best, at, where


def longest_common_substrings(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``lcs(length, a_start, b_start)`` of two text columns, white space deleted; in Arrow batches."""


    @F.pandas_udf("length int, a_start int, b_start int")
    def lcs(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([common_substring(p or "", q or "") for p, q in zip(x, y, strict=True)], columns=["length", "a_start", "b_start"])

    return pairs.withColumn("lcs", lcs(X.compact(F.col(a)), X.compact(F.col(b))))


def paragraph_overlap(cand: DataFrame, ref: DataFrame, key: str, pair: bool) -> DataFrame:
    """``key, exact_count, normalized_count, examples`` over paragraphs of 30 effective characters or more."""
    on = [key] if pair else []
    e = ref.select(*on, "exact").distinct().withColumn("_e", F.lit(True))
    n = ref.select(*on, "norm").distinct().withColumn("_n", F.lit(True))
    met = cand.join(e, [*on, "exact"], "left").join(n, [*on, "norm"], "left")
    kind = F.when(F.col("_e"), "exact").when(F.col("_n"), "normalized")
    shown = F.struct("pos", kind.alias("match_type"), X.truncate(F.col("raw"), 120).alias("paragraph"))
    return met.groupBy(key).agg(F.count("_e").alias("exact_count"), F.count("_n").alias("normalized_count"), F.slice(F.array_sort(F.collect_list(F.when(kind.isNotNull(), shown))), 1, 3).alias("examples"))


def contamination_risk(exact_ratio: Column, exact: Column, norm_ratio: Column, norm: Column, near: Column, near_ratio: Column, sh12: Column, sh20: Column, longest: Column, par_exact: Column, par_norm: Column) -> Column:
    """A7."""
    high = ((exact_ratio >= 0.3) & (exact >= 2)) | ((norm_ratio >= 0.3) & (norm >= 2)) | (longest >= 200) | (sh20 >= 0.35) | (par_exact > 0) | (par_norm > 0)
    medium = (exact_ratio >= 0.1) | (norm_ratio >= 0.1) | (near >= 2) | (near_ratio >= 0.2) | (longest >= 80) | (sh12 >= 0.25)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def contamination_stats(ref: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    """The contamination bundle of pairs that share ``key``. Each part is a table before they are joined: a plan of all of
    them, with their many expressions, is more than a small driver holds."""
    root = work_dir(cand.sparkSession)
    part = lambda df, name: settle(df, f"{root}/{name}")
    ci, ri = part(items(cand, key), "candidates"), part(items(ref, key), "references")
    out = cand.select(key)
    o = sentence_overlaps(ci, ri, key, True)
    names = (("exact", "exact"), ("normalized", "norm"))
    o = o.select(key, F.col("total").alias("_n"), *[F.col(f"{c}_matched").alias(f"{name}_count") for name, c in names], *[X.ratio(F.col(f"{c}_matched"), F.col("total")).alias(f"{name}_ratio") for name, c in names])
    out = out.join(part(o, "sentences"), key, "left")
    near = near_matches(ci, ri, key, True).groupBy(key).agg(F.count("*").alias("near_count"))
    out = out.join(part(near, "near"), key, "left")
    for k in (8, 12, 20):
        s = shingle_overlap(cand, ref, key, True, k)
        out = out.join(part(s.select(key, X.ratio(F.col("matched"), F.col("total")).alias(f"shingle{k}_ratio")), f"shingles{k}"), key, "left")
    both = cand.select(key, F.col("text").alias("_a")).join(ref.select(key, F.col("text").alias("_b")), key, "left")
    lcs = longest_common_substrings(both, "_a", "_b").select(key, F.col("lcs.length").alias("longest"))
    p = paragraph_overlap(items(cand, key, "paragraphs", MIN_PARAGRAPH), items(ref, key, "paragraphs", MIN_PARAGRAPH), key, True)
    p = p.select(key, F.col("exact_count").alias("par_exact"), F.col("normalized_count").alias("par_norm"))
    out = out.join(part(lcs, "longest"), key, "left").join(part(p, "paragraphs"), key, "left")
    out = out.na.fill(0).withColumn("near_ratio", X.ratio(F.col("near_count"), F.col("_n"))).drop("_n")
    c = F.col
    return out.withColumn("contamination_risk", contamination_risk(c("exact_ratio"), c("exact_count"), c("normalized_ratio"), c("normalized_count"), c("near_count"), c("near_ratio"), c("shingle12_ratio"), c("shingle20_ratio"), c("longest"), c("par_exact"), c("par_norm")))


def contamination_whole(ref: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    """The signals of A7 and the risk of every candidate against the whole reference. The candidates' sentences are made
    once and held against the reference's; those that have no twin there are kept for the search of near matches."""
    root = work_dir(cand.sparkSession)
    ci, ri = items(cand, key).select(key, "exact", "norm", "visible"), settle(items(ref, key), f"{root}/reference")
    for c in ("exact", "norm"):
        ci = ci.join(ri.select(c).distinct().withColumn(f"_{c}", F.lit(True)), c, "left")
    alone = F.col("_exact").isNull() & F.col("_norm").isNull() & (F.col("visible") >= MIN_VISIBLE)
    ci = settle(ci.select(key, "_exact", "_norm", F.when(alone, F.col("norm")).alias("norm")), f"{root}/sentences")
    names = (("exact", "exact"), ("normalized", "norm"))
    o = ci.groupBy(key).agg(F.count("*").alias("_n"), *[F.count(f"_{c}").alias(f"{name}_count") for name, c in names])
    out = cand.select(key).distinct().join(o.select("*", *[X.ratio(F.col(f"{name}_count"), F.col("_n")).alias(f"{name}_ratio") for name, _ in names]), key, "left")
    # a sentence that repeats is sought once; dealt to a number of parts, which adaptive execution doesn't unite
    other = ri.where(F.col("visible") >= MIN_VISIBLE)
    sought = ci.where("norm is not null").select("norm").repartition(tasks(cand.sparkSession), "norm").distinct()
    near = settle(near_best(sought, other, NEAR, MIN_SENTENCE, common_subsequence, sequence_ratio).select("norm").distinct(), f"{root}/near")
    out = out.join(ci.join(near, "norm").groupBy(key).agg(F.count("*").alias("near_count")), key, "left")
    text = lambda df: df.select(key, X.normalized(F.col("text")).alias("text"))
    s = gram_counts(text(cand), text(ref), key, "text", (12, 20))
    out = out.join(s.select(key, *[X.ratio(F.col(f"matched{k}"), F.col(f"total{k}")).alias(f"shingle{k}_ratio") for k in (12, 20)]), key, "left")
    p = paragraph_overlap(items(cand, key, "paragraphs", MIN_PARAGRAPH), items(ref, key, "paragraphs", MIN_PARAGRAPH), key, False)
    out = out.join(longest_common(cand, ref, key), key, "left").join(p.select(key, F.col("exact_count").alias("par_exact"), F.col("normalized_count").alias("par_norm")), key, "left")
    signals = [n for n in out.columns if n != key]
    out = out.na.fill(0, signals).withColumn("near_ratio", X.ratio(F.col("near_count"), F.col("_n"))).drop("_n")
    c = F.col
    return out.withColumn("contamination_risk", contamination_risk(c("exact_ratio"), c("exact_count"), c("normalized_ratio"), c("normalized_count"), c("near_count"), c("near_ratio"), c("shingle12_ratio"), c("shingle20_ratio"), c("longest"), c("par_exact"), c("par_norm")))
