"""Target-distribution importance resampling over hashed word runs.

Every run of one or two words of a text is a feature, hashed to a bucket by its CRC-32, which a byte automaton computes
from the Arrow buffers (``byte_words``). How much more frequent a bucket is in the target than in the corpus is its gain;
a document's weight is the mean gain of its features. Adding Gumbel noise that the id decides and taking the highest
scores draws documents without replacement in proportion to the exponent of their weights.

Two passes read the texts: one counts buckets (a row a task and bucket travels), one scores. Only the array of gains,
``buckets`` numbers, is broadcast; texts never travel.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.byte_words import ALNUM, run_crcs, spans, steps
from quillmill.llm.common import ordered_partitions, settle, tidy, with_running_sum, work_dir

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
#: Bytes of text that one step takes, and rows of a part of the draw.
STEP_BYTES, PART_ROWS = 1 << 20, 500_000


def _counts(buckets: int, longest: int):
    """(bucket, n) of a task's features."""

    def run(batches):
        have = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column("text"), STEP_BYTES):
                for _, crc in run_crcs(data, *spans(data, offsets, ALNUM), longest):
                    have += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        full = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(have[full])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket; at most ``buckets`` rows reach the driver."""
    each = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_counts(buckets, longest), whole=True), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share of the target over that of the corpus."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = ((b + 1.0) * float(t_all) / ((a + 1.0) * float(s_all)) for a, b, t_all, s_all in zip(corpus.tolist(), target.tolist(), [s + n] * n, [t + n] * n, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weigh(held, longest: int):
    """(id, tie, place, n_words, n_features, total gain) of each text."""

    def run(batches):
        gain = held.value
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for a, b, data, offsets in steps(batch.column("text"), STEP_BYTES):
                begin, end, first = spans(data, offsets, ALNUM)
                n_words[a:b] = np.diff(first)
                for start, crc in run_crcs(data, begin, end, first, longest):
                    text = np.searchsorted(start, first)
                    sums = np.concatenate(([0], np.cumsum(gain[crc % np.uint32(len(gain))])))
                    n_features[a:b] += np.diff(text)
                    total[a:b] += np.diff(sums[text])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "tie", "place")], pa.array(n_words), pa.array(n_features), pa.array(total)], names=["id", "tie", "place", "n_words", "n_features", "total"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) that ``seed`` and the id decide; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)``, one row per input row: ``share`` percent of the rows with
    ``least_words`` words are drawn, highest score first, and have a rank from 1; the others have a null one.

    A null or empty text has no words, no features, weight 0, and isn't drawn unless ``least_words`` is 0; a text of any
    length counts whole. Ties go to the smaller id, a null id last, rows that repeat an id by their text's hash, and rows
    that are equal throughout as read, each a row of its own. An empty table gives no rows, an empty target has no
    features; extra columns are ignored.
    """
    spark = docs.sparkSession
    root = work_dir(spark)
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    held = spark.sparkContext.broadcast(gain)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    out = base.mapInArrow(tidy(_weigh(held, longest)), "id long, tie long, place long, n_words long, n_features long, total long")
    n, total = F.col("n_features"), F.col("total")
    weight = F.when(n == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    out = out.withColumn("weight", weight.cast("long")).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).drop("total")
    scored = settle(out, f"{root}/scored")
    able = scored.where(F.col("n_words") >= least_words)
    rows = able.count()
    order = [F.desc("score"), F.col("id").asc_nulls_last(), "tie", "place"]
    parts = max(1, min(spark.sparkContext.defaultParallelism, rows // 10_000), -(-rows // PART_ROWS))
    dealt = with_running_sum(ordered_partitions(able.withColumn("one", F.lit(1)), order, f"{root}/order", parts), order, "one", "before")
    drawn = F.when(F.col("before") < rows * share // 100, F.col("before") + 1)
    names = ["id", "n_words", "n_features", "weight", "score"]
    ranked = dealt.select(*names, drawn.cast("long").alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank")))
