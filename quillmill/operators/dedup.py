"""Output de-duplication: what is kept before the first violation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.functions import text as X

PARAGRAPH_CHARS, SENTENCE_CHARS, SEEN_CHARS = 50, 8, 10


def _cut(pieces: DataFrame, key: str, least: int, nth: int) -> DataFrame:
    """``key, pos, piece`` before the nth occurrence of a piece of ``least`` characters."""
    own = pieces.withColumn("_k", X.strip(F.col("piece")))
    n = F.row_number().over(Window.partitionBy(key, "_k").orderBy("pos"))
    seen = own.withColumn("_bad", F.when((F.length("_k") >= least) & (n >= nth), F.col("pos")))
    first = F.min("_bad").over(Window.partitionBy(key))
    return seen.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("pos") < F.col("_first"))).select(key, "pos", "piece")


def _joined(pieces: DataFrame, key: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(key).agg(X.strip(text).alias("text"))


def dedup_output(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Cut at the second copy of a long line, then at the third of a sentence: ``key, text``."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)")).alias("pos", "piece"))
    one = _joined(_cut(lines, key, PARAGRAPH_CHARS, 2), key)
    parts = one.select(key, F.posexplode(F.split("text", r"(?<=[。！？\n])")).alias("pos", "piece"))
    two = _joined(_cut(parts, key, SENTENCE_CHARS, 3), key)
    return docs.select(key).join(two, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def _paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    each = docs.select(key, F.posexplode(S.paragraphs(F.coalesce(text, F.lit("")))).alias("pos", "piece"))
    return each.withColumn("unit", X.compact(F.col("piece")))


def internal_duplicates(docs: DataFrame, key: str, text: str = "text", least: int = SEEN_CHARS) -> DataFrame:
    """Every further occurrence of a paragraph: ``key, pos, piece, unit, nth``."""
    each = _paragraphs(docs, key, text).where(F.length("unit") >= least)
    return each.withColumn("nth", F.row_number().over(Window.partitionBy(key, "unit").orderBy("pos"))).where("nth > 1")


def truncate_at_seen(docs: DataFrame, seen: DataFrame, key: str, text: str = "text", least: int = SEEN_CHARS) -> DataFrame:
    """W5 for one round: paragraphs before the first that ``seen(key, unit)`` holds: ``key, text, truncated, skipped``."""
    known = seen.select(key, "unit").distinct().withColumn("_seen", F.lit(True))
    bad = F.when(F.col("_seen") & (F.length("unit") >= least), F.col("pos"))
    met = _paragraphs(docs, key, text).join(known, [key, "unit"], "left").withColumn("_first", F.min(bad).over(Window.partitionBy(key)))
    kept = F.when(F.col("_first").isNull() | (F.col("pos") < F.col("_first")), F.struct("pos", "piece"))
    out = met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["piece"]), "\n\n").alias("text"), F.max(F.col("_first").isNotNull()).alias("truncated"))
    out = docs.select(key).join(out, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return out.withColumn("skipped", F.col("truncated") & (F.col("text") == ""))
