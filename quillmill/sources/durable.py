"""Tables that cut lineage: Parquet below ``spark.checkpoint.dir``, which all executors share, so a lost executor costs a
re-read and nothing else."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary
    folder, set for the session; on a cluster, whose executors don't share one, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillmill-{uuid.uuid4().hex}"


def settle(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and return the table that reads it back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) by the default file system that Spark itself uses."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`settle` that nothing reads any more."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a full URI."""
    fs, p = hadoop_path(spark, folder)
    return fs.makeQualified(p).toString()


def open_uri(uri: str):
    """(file system, path) of a full URI by Arrow, which reaches local, HDFS and object stores alike."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
