"""The index of all rows, where counts and rows are parts of unlike size."""

import pytest

from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.operators import datasets, samples


@pytest.fixture
def small_parts(spark):
    """Parts of long rows stay apart, parts of their keys alone are put together."""
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def rows(spark, n=400):
    """Rows of a kilobyte that doesn't compress."""
    body = F.concat(*[F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(8)])
    return spark.range(0, n, 1, 5).select((n - F.col("id")).alias("k"), body.alias("body"))


def test_no_row_is_lost_and_indexes_follow_the_order(spark, small_parts):
    got = S.global_index(rows(spark), ["k"]).select("k", "index", "body").collect()
    assert sorted((r.k, r["index"]) for r in got) == [(i, i) for i in range(1, 401)]
    assert len({r.body for r in got}) == 400


def test_its_users(spark, small_parts):
    two = rows(spark).withColumn("sample_id", F.col("k").cast("string"))
    lab = two.select("sample_id", F.lit("main").alias("source_section"), F.lit(1.0).alias("source_section_confidence"), F.lit("mixed").alias("content_sensitivity"), F.lit(0.5).alias("content_sensitivity_confidence"))
    got = samples.merge_samples(rows(spark), two, lab, ("k", "k")).select("merged_sample_id", "source_book", "k").collect()
    assert sorted((r.merged_sample_id, r.k + 400 * (r.source_book == "novel2")) for r in got) == [(f"merged_{i:06d}", i) for i in range(1, 801)]
    places = [r.place for r in datasets.repeated(rows(spark), "k", 2, 7).collect()]
    assert sorted(places) == list(range(800))


def test_ties_and_no_rows(spark):
    none = spark.createDataFrame([], "k long, v string")
    assert S.global_index(none, ["k"]).collect() == []
    many = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c"), (2, "d")], "k long, v string")
    got = [(r["index"], r.k) for r in S.global_index(many, ["k"]).orderBy("index").collect()]
    assert got == [(1, None), (2, 1), (3, 1), (4, 2)]
