"""A fact store that grows by batches, each of which rewrites only the hash buckets that it hits.

A store is a folder of versions. ``version=N/data`` holds the buckets that batch N rewrote, and ``version=N/manifest``,
written last, says for every bucket which version has it. A version counts once its manifest is there, so a batch that
failed half way changed nothing. The number of buckets is fixed by the first batch: choose it so that a bucket fits a task;
the manifest has a row a bucket, and so has all that the driver reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmill.operators import facts
from quillmill.sources.durable import discard, hadoop_path, settle, work_dir

BUCKETS = 64


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, in order."""
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if fs.exists(hadoop_path(spark, f"{path}/version={v}/manifest/_SUCCESS")[1]))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int | None]:
    """Bucket to the version that holds it, null for an empty one; without a version, of the newest. Empty: no store."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"no version {version} at {path}")
    if not known:
        return {}
    at = known[-1] if version is None else version
    rows = spark.read.schema("bucket int, held int").parquet(f"{path}/version={at}/manifest").collect()
    return {r.bucket: r.held for r in rows}


def _read(spark: SparkSession, path: str, held: dict[int, int | None], schema: StructType) -> DataFrame:
    paths = [f"{path}/version={v}/data/bucket={b}" for b, v in sorted(held.items()) if v is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The store's rows, now or as of a version."""
    return _read(spark, path, manifest(spark, path, version), schema)


def apply(path: str, batch: DataFrame, key: str, schema: StructType, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """One batch. ``merge(stored, batch)`` sees the hit buckets only and gives their new rows, at least ``schema``; rows
    that share a ``key`` share a bucket. Returns what ``merge`` gave, as a table. An empty batch commits no version."""
    spark = batch.sparkSession
    path = path.rstrip("/")
    held = manifest(spark, path)
    held = held or dict.fromkeys(range(buckets))
    into = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(len(held))).cast("int")
    new = settle(batch, f"{work_dir(spark)}/batch")
    hit = {r.bucket for r in new.select(into.alias("bucket")).distinct().collect()}
    done = settle(merge(_read(spark, path, {b: held[b] for b in hit}, schema), new), f"{work_dir(spark)}/merged")
    if not hit:
        return done
    number = max(versions(spark, path), default=0) + 1
    out = done.select(*schema.names, into.alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", key)
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/version={number}/data")
    rows = [(b, number if b in hit else v) for b, v in held.items()]
    spark.createDataFrame(rows, "bucket int, held int").coalesce(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/version={number}/manifest")
    return done


def upsert(path: str, batch: DataFrame, order: str, schema: StructType, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """:func:`facts.upsert` of a batch into the store: the rows of the hit buckets with ``change`` and ``n_updates``."""
    return apply(path, batch, key, schema, lambda old, new: facts.upsert(old, new, order, key), buckets)


def add_states(path: str, batch: DataFrame, subject: str, schema: StructType, key: str = "id", start: str = "valid_from", end: str = "valid_to", buckets: int = BUCKETS) -> DataFrame:
    """States are added, never overwritten: a state ends before the next later one of its subject begins, or where it says,
    whichever is first. A key that is stored already, or repeated in the batch, is taken once: the stored one, then the
    least row. Rows without subject or start never close others and stay as they are. Starts of a subject are made distinct
    before they are put in order, so a subject with many states doesn't land in one task whole."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in schema.names if c not in (subject, key)]
        both = old.select(*schema.names, F.lit(0).alias("_age")).union(new.select(*schema.names, F.lit(1)))
        once = both.groupBy(subject, key).agg(F.min(F.struct("_age", *rest)).alias("_s")).select(subject, key, *[F.col(f"_s.{c}").alias(c) for c in rest])
        starts = once.select(subject, start).distinct()
        following = starts.withColumn("_next", F.lead(start).over(Window.partitionBy(subject).orderBy(start)))
        closed = once.join(following.where(F.col(start).isNotNull()), [subject, start], "left").withColumn(end, F.least(end, F.col("_next") - 1))
        return closed.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names])

    return apply(path, batch, subject, schema, merge, buckets)


def vacuum(spark: SparkSession, path: str) -> int:
    """Drop all versions but the newest and those that its manifest reads; their number."""
    known = versions(spark, path)
    used = set(manifest(spark, path).values()) | set(known[-1:])
    gone = [v for v in known if v not in used]
    for v in gone:
        discard(spark, f"{path.rstrip('/')}/version={v}")
    return len(gone)
