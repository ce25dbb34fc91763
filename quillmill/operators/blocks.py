"""Texts against an index of many items: a bounded block of items is indexed at a time, and texts pass in Arrow batches.

Items small enough, by a count of their characters, are held by every task and the texts stay where they are. Beyond
that they are dealt to blocks; a block's items are sent ahead of each share of the texts and indexed there, so neither
side goes through the driver and no task holds more than a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of items that are broadcast, and of a block beyond that. Rows that are looked up at once.
HELD, BLOCK, ROWS = 4_000_000, 4_000_000, 1024
_indexes: dict[str, object] = {}


def _index(key: str, build: Callable, items: Callable):
    """A worker's index of a broadcast, kept for its next tasks; others are dropped."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = build(items())
    return _indexes[key]


def _answer(batch: pa.RecordBatch, index, use: Callable, names: list[str]) -> pa.RecordBatch:
    rows, found = use(index, batch.column("_t").to_pylist())
    row = batch.column("_row").take(pa.array(rows))
    return pa.RecordBatch.from_arrays([row, *found], names=["_row", *names])


def tasks(spark: SparkSession) -> int:
    """Parts of rows that are dear each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly, for work that is dear by the row: a table of a few files is a few tasks, whatever its rows
    cost. A table of as many files as there are tasks to keep busy stays as it is: its texts needn't be shuffled."""
    spark = rows.sparkSession
    if len(rows.inputFiles()) >= 2 * spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(tasks(spark))


def meet(rows: DataFrame, text: str, items: DataFrame, build: Callable[[list[str]], object], use: Callable[[object, list], tuple[np.ndarray, list]], out: StructType, held: int = HELD, block: int = BLOCK, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``rows`` (their columns ``keep``, or all) with what ``use`` finds for their ``text``: the columns of ``out``, a row for each find in each block.

    ``items`` has one column of strings; empty and null ones go, repeated ones count once. ``build(items)`` makes an
    index; ``use(index, texts)`` gives the number of the text of each find, and a column for each field of ``out``.
    Null texts reach ``use`` as None; an empty table on either side gives no finds but what ``use`` makes of no items.
    """
    spark = rows.sparkSession
    item = items.select(F.col(items.columns[0]).alias("item")).where("length(item) > 0").distinct()
    size = item.agg(F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("n")).first()["n"]
    base = rows.select(F.struct(*[F.col(c) for c in keep or rows.columns]).alias("_row"), F.col(text).alias("_t"))
    schema = StructType([StructField("_row", base.schema["_row"].dataType), *out.fields])
    names = out.names
    if size <= held:
        key, all_ = uuid.uuid4().hex, spark.sparkContext.broadcast([r["item"] for r in item.collect()])

        def run(batches):
            index = _index(key, build, lambda: all_.value)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    yield _answer(batch.slice(at, ROWS), index, use, names)

        return base.mapInArrow(run, schema).select("_row.*", *names)
    blocks, shares = -(-size // block), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = [F.col("_block"), F.col("_share")]
    asked = base.withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int")).withColumn("_block", each(blocks)).select(*place, F.lit(None).cast("string").alias("item"), "_t", "_row")
    told = item.withColumn("_block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).withColumn("_share", each(shares)).select(*place, "item", F.lit(None).cast("string").alias("_t"), F.lit(None).cast(schema["_row"].dataType).alias("_row"))

    def stream(batches):
        here, index, waiting = None, None, []
        for batch in batches:
            keys = np.stack((batch.column("_block").to_numpy(), batch.column("_share").to_numpy()))
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if b == a:
                    continue
                if (now := tuple(keys[:, a].tolist())) != here:
                    here, index, waiting = now, None, []
                part = batch.slice(a, b - a)
                ahead = int(part.num_rows - part.column("item").null_count)  # items come first
                waiting += part.column("item").slice(0, ahead).to_pylist()
                part = part.slice(ahead)
                if part.num_rows and index is None:
                    index, waiting = build(waiting), []
                for at in range(0, part.num_rows, ROWS):
                    yield _answer(part.slice(at, ROWS), index, use, names)

    both = told.unionByName(asked).repartition("_block", "_share").sortWithinPartitions("_block", "_share", F.col("item").asc_nulls_last())
    return both.mapInArrow(stream, schema).select("_row.*", *names)
