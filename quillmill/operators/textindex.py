"""A stored inverted index with appends, and searches that score only the blocks of documents that can matter.

An index is a folder of segments ``segment=<first>-<last>``; each append adds one, :func:`compact` makes one of all. Ids of
documents are ordered, at most ``DOCS_PER_BLOCK`` neighbours are a block, and a row of ``postings`` holds one term in one
block: its documents with counts, lengths and positions, and beside them the largest count and the least length, which
bound the term's part of a score whatever the mean length has become since. A segment counts once its ``stats``, written
last, are there; what a failed append left is ignored. A document's id must be new to the index. Null texts count as
documents and have no tokens; an empty table makes an empty segment; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.operators.retrieval import B, K1, term_weights
from quillmill.sources.durable import discard, hadoop_path, settle, work_dir

Tokens = Callable[[Column], Column]

DOCS_PER_BLOCK_BITS = 6
DOCS_PER_BLOCK = 1 << DOCS_PER_BLOCK_BITS
#: Where a segment's number stands in the number of a block; below it are the partition and the row.
SEGMENT_BIT = 45
#: Blocks that a query scores before it has a bound, and the slack for scores rounded to nine places.
FIRST_BLOCKS, SLACK = 2, 1e-6


def _segments(spark: SparkSession, path: str, committed: bool = True) -> list[tuple[int, int, str]]:
    """(first, last, folder) of the segments, those that another holds left out."""
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        return []
    found = []
    for s in fs.listStatus(at):
        name, folder = s.getPath().getName(), s.getPath().toString()
        if name.startswith("segment=") and (not committed or fs.exists(hadoop_path(spark, f"{folder}/stats/_SUCCESS")[1])):
            first, last = name.removeprefix("segment=").split("-")
            found.append((int(first), int(last), folder))
    inside = lambda a, b: a is not b and b[0] <= a[0] and a[1] <= b[1]
    return sorted(a for a in found if not committed or not any(inside(a, b) for b in found))


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    paths = [f"{p}/{name}" for _, _, p in _segments(spark, path)]
    if not paths:
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.parquet(*paths)


def _commit(postings: DataFrame, terms: Callable[[DataFrame], DataFrame], stats: DataFrame, folder: str) -> None:
    """``stats`` last, as the sign that all is there. ``postings`` are dealt by block; a file has them in order of terms, so
    a reader skips row groups. ``terms`` makes the terms, from the postings as written if it likes."""
    opts = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "true", "compression": "zstd"}
    postings.sortWithinPartitions("term", "block").write.mode("overwrite").options(**opts).parquet(f"{folder}/postings")
    posts = postings.sparkSession.read.schema(postings.schema).parquet(f"{folder}/postings")
    terms(posts).write.mode("overwrite").options(**opts).parquet(f"{folder}/terms")
    stats.write.mode("overwrite").options(**opts).parquet(f"{folder}/stats")


def append(docs: DataFrame, path: str, doc: str, text: str = "text", tokens: Tokens = S.tokens) -> str:
    """Add ``docs`` to the index at ``path`` as a new segment; its folder. Texts are tokenised once; tokens are shuffled
    by block before they become rows, and both groupings then need no shuffle of their own."""
    spark = docs.sparkSession
    number = max([last for _, last, _ in _segments(spark, path, committed=False)], default=0) + 1
    folder = f"{path.rstrip('/')}/segment={number}-{number}"
    # a row's number within its range, cut by blocks, below the segment's number
    block = F.lit(number << SEGMENT_BIT) + F.shiftright(F.monotonically_increasing_id(), DOCS_PER_BLOCK_BITS)
    work = work_dir(spark)
    sorted_ = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("tokens")).repartitionByRange("doc").sortWithinPartitions("doc")
    held = settle(sorted_.withColumn("block", block), f"{work}/tokens")
    each = held.repartition("block").select("block", "doc", F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "term"))
    one = each.groupBy("block", "term", "doc").agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"), F.array_sort(F.collect_list("pos")).alias("at"))
    post = F.struct("doc", "tf", "len", "at")
    rows = one.groupBy("block", "term").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.array_sort(F.collect_list(post)).alias("posts"))
    stats = held.agg(F.count("*").alias("docs"), F.count("tokens").alias("texts"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total"))
    _commit(rows, lambda posts: posts.groupBy("term").agg(F.sum("n").alias("df")), stats, folder)
    discard(spark, work)
    return folder


def compact(spark: SparkSession, path: str) -> None:
    """One segment of all. It is committed, and from then on the only one read, before the others go; run it while no
    search is under way."""
    old = _segments(spark, path)
    if len(old) < 2:
        return
    terms = _table(spark, path, "terms").groupBy("term").agg(F.sum("df").alias("df"))
    stats = _table(spark, path, "stats").agg(*[F.sum(c).alias(c) for c in ("docs", "texts", "total")])
    _commit(_table(spark, path, "postings").repartition("block"), lambda _: terms, stats, f"{path.rstrip('/')}/segment={old[0][0]}-{old[-1][1]}")
    for _, _, folder in old:
        discard(spark, folder)


def _part(tf: Column, length: Column) -> Column:
    return F.col("qf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avgdl")))


def searched(queries: DataFrame, path: str, query: str, k: int, text: str = "text", tokens: Tokens = S.tokens, first: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(``query, doc, score, rank``, ``query, block, bound, scored``): the exact best ``k``, ties to the smaller document,
    and the blocks that hold a query's terms with what was done to them.

    A block's bound is the sum of its terms' bounds. Each query scores its ``first`` best blocks; the k-th score there is
    a floor, and of the other blocks only those whose bound reaches it are scored. Queries with the same id are one.

    Postings of asked terms are dealt by block, so that a block's bounds and scores are summed where it lies (as long as the
    asked terms are broadcast), and a task hands on the best ``k`` of a query alone.
    """
    spark, work = queries.sparkSession, work_dir(queries.sparkSession)
    total = _table(spark, path, "stats").agg(F.sum("docs").alias("n"), F.try_divide(F.sum("total"), F.sum("texts")).alias("avgdl"))
    df = _table(spark, path, "terms").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.select(query, F.explode(tokens(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qf"))
    weighed = asked.join(term_weights(df, total.select("n")), "term").crossJoin(F.broadcast(total.select("avgdl")))  # one row
    asked = settle(weighed.select(query, "term", "qf", "idf", "avgdl"), f"{work}/asked")
    posts = _table(spark, path, "postings").join(asked.select("term").distinct(), "term", "left_semi")
    heads = posts.select("term", "block", "max_tf", "min_len").repartition("block").join(asked, "term")
    bound = F.sum(F.greatest(_part(F.col("max_tf"), F.col("min_len")), F.lit(0.0)))
    bounds = settle(heads.groupBy(query, "block").agg(bound.alias("bound")).where("bound > 0"), f"{work}/bounds")
    best = Window.partitionBy(query).orderBy(F.desc("score"), "doc")
    top = lambda s: s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def scores(blocks: DataFrame, name: str, few: bool = False) -> DataFrame:
        """The best ``k`` documents of each query in its blocks; few ones are picked out before postings are dealt."""
        asking = blocks.groupBy("block").agg(F.collect_list(query).alias("asking"))
        some = posts.select("term", "block", "posts.doc", "posts.tf", "posts.len")
        some = some.join(F.broadcast(asking.select("block")), "block", "left_semi") if few else some
        met = some.repartition("block").join(asking, "block").join(asked, "term").where(F.array_contains("asking", F.col(query)))
        each = met.select("block", query, "qf", "idf", "avgdl", F.explode(F.arrays_zip("doc", "tf", "len")).alias("p")).select("*", "p.*")
        sums = each.groupBy("block", query, "doc").agg(F.round(F.sum(_part(F.col("tf"), F.col("len"))), 9).alias("score")).where("score > 0")
        return settle(top(sums.select(query, "doc", "score")).drop("rank"), f"{work}/{name}")

    by = Window.partitionBy(query).orderBy(F.desc("bound"), "block")
    early = settle(bounds.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= first).select(query, "block"), f"{work}/early")
    head = scores(early, "first", few=True)
    floor = top(head).where(F.col("rank") == k).select(query, F.col("score").alias("floor"))
    marked = bounds.join(early.withColumn("early", F.lit(True)), [query, "block"], "left").join(floor, query, "left")
    reach = F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))
    blocks = settle(marked.select(query, "block", "bound", F.coalesce("early", F.lit(False)).alias("early"), (F.coalesce("early", F.lit(False)) | reach).alias("scored")), f"{work}/blocks")
    rest = scores(blocks.where("scored and not early"), "rest")
    return top(head.unionByName(rest)), blocks.drop("early")


def topk(queries: DataFrame, path: str, query: str, k: int, **kw) -> DataFrame:
    """``query, doc, score, rank``: as :func:`searched`."""
    return searched(queries, path, query, k, **kw)[0]


def phrases(queries: DataFrame, path: str, query: str, text: str = "text", tokens: Tokens = S.tokens) -> DataFrame:
    """``query, doc, at``: every place where a query's tokens follow one another in a document, by positions (from 0). Only
    blocks that hold all of a query's terms are opened. A query without tokens is nowhere."""
    spark = queries.sparkSession
    made = queries.select(query, tokens(F.col(text)).alias("_t"))
    each = made.select(query, F.size("_t").alias("size"), F.size(F.array_distinct("_t")).alias("kinds"), F.posexplode("_t").alias("off", "term"))
    want = settle(each, f"{work_dir(spark)}/phrases")
    posts = _table(spark, path, "postings")
    kinds = want.select(query, "kinds", "term").distinct()
    whole = posts.select("term", "block").join(kinds, "term").groupBy(query, "block").agg(F.count("*").alias("n"), F.first("kinds").alias("kinds")).where("n = kinds").select(query, "block")
    met = posts.select("term", "block", "posts").join(want.join(whole, query), ["term", "block"])
    places = met.select(query, "size", "off", F.explode("posts").alias("p")).select(query, "size", "p.doc", F.explode("p.at").alias("pos"), "off")
    runs = places.groupBy(query, "doc", (F.col("pos") - F.col("off")).alias("at")).agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return runs.where("n = size").select(query, "doc", "at")
