"""A training-data pipeline over ``documents``: language ID, n-gram Jaccard join, PII, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import langid, mixing, ngram_join, packing, pii
from quillmill.llm.common import release_driver, settle, work_dir
from quillmill.llm.queries import target_weights, tree, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this score the language isn't known well enough; four languages at even odds give 0.25.
LEAST_SCORE = 0.5


def begin(spark: SparkSession) -> None:
    """What every stage begins with: a bound on what a batch holds on both sides of the Python boundary (documents are a
    few thousand characters long), and the driver's memory of the stage before handed back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    release_driver(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with the predicted one as ``lang``; a text that is null or has no letter, or whose
    score is doubtful, goes. Null and repeated ids and repeated rows are documents like others."""
    begin(spark)
    out = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    good = out.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return good.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (five words, similarity 0.8). Rows with no id all stay, and
    so does a text that is null or has no words. Rows that share an id and have unlike texts are judged each by its own
    text; of rows that repeat an id and a text one stays, the least by its other columns."""
    begin(spark)
    found = ngram_join.ngram_jaccard_join(docs, text_key=True)
    kept = found.where("id is not null and id = component_id").groupBy(F.col("id").alias("doc_id"), F.col("text_key").alias("_k")).count()
    kept = settle(kept, f"{work_dir(spark)}/kept")
    rows = docs.select(*COLUMNS).withColumn("_k", F.xxhash64(F.col("text").cast("string")))
    one = lambda c: rows.join(kept.where(c).select("doc_id", "_k"), ["doc_id", "_k"], "left_semi")
    again = one("count > 1").groupBy("doc_id", "_k").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return rows.where("doc_id is null").select(*COLUMNS).unionByName(one("count = 1").select(*COLUMNS)).unionByName(again.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span of personal data replaced by a placeholder of its kind. A null text stays null; null and
    repeated ids and repeated rows are documents like others."""
    begin(spark)
    found = pii.find_pii(docs, keep=tuple(COLUMNS))
    spans = F.array_sort(F.concat("base", "added"))
    clean = F.when(F.size(spans) > 0, pii.redact(F.col("row.text"), spans)).otherwise(F.col("row.text"))
    return found.select("row.doc_id", clean.alias("text"), "row.lang", "row.source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, once an epoch; the last of a source is cut to the words it is given. Texts that are
    null or have no words add nothing and go; null languages and sources are leaves of their own; null and repeated ids
    and repeated rows are documents like others."""
    begin(spark)
    out = mixing.mix_sources(docs.select(*COLUMNS), tree(), target_weights(), words(F.col("text")))
    head = F.array_join(F.slice(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""), F.lit(1), F.col("taken").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("taken") < F.col("tokens"), head).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's tokens, a sequence each. A null or empty text is its end id alone; null and repeated
    ids and repeated rows are documents like others."""
    begin(spark)
    return packing.pack_power_of_two(docs, with_ids=False, memo=60_000).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packed", packed)]

#: Language ID, weak supervision and tokenization aren't SQL; tests hold the chain against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"{root}/{name}")
    return docs
