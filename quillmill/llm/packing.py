"""Packing by power-of-two decomposition: a document's tokens are cut into pieces whose lengths are powers of two, the
longest first, and pieces of equal length share a bucket. Every piece is a sequence, so no sequence crosses documents
and none needs padding."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import settle, tidy, work_dir
from quillmill.llm.tokens import CACHE, MEMO, default_path, encoder

MAX_LENGTH, END_ID = 2048, 1


def binary_lengths(total: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two, longest first, that sum to ``total``: as many of ``longest`` as fit, then its remainder's bits."""
    full, rest = divmod(total, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pieces(path: str, longest: int, end_id: int, with_ids: bool, memo: int):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"] + ["ids"] * with_ids

    def run(batches):
        enc, part, ranks = encoder(path, memo), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i, ids in zip(batch.column("id").to_pylist(), enc.texts(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for n in binary_lengths(len(ids), longest):
                    raw = ids[at : at + n].tobytes()
                    for col, v in zip(out, (i, at, n, zlib.crc32(raw), len(ids), part, ranks[n], raw), strict=False):
                        col.append(v)
                    ranks[n] += 1
                    at += n
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names=names)

    return run


def pack_power_of_two(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True, memo: int = MEMO) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``, one row per piece.

    Sequences are numbered from 0 without gaps, bucket by bucket from the shortest; ``offset`` is always 0. ``ids`` are
    little-endian unsigned 32-bit integers (left out unless ``with_ids``). A null or empty text is its end id alone. Ids
    may be null or repeated: each row is a document. An empty table gives no rows; extra columns are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    root = work_dir(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long" + ", ids binary" * with_ids
    pieces = settle(base.mapInArrow(tidy(_pieces(path or default_path(), longest, end_id, with_ids, memo), keep=CACHE), schema), f"{root}/pieces")
    # one row a task and bucket: where that task's sequences of that length begin
    size = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    bucket = size.groupBy("length").agg(F.sum("n").alias("all"))
    bucket = bucket.select("length", (F.sum("all").over(Window.orderBy("length")) - F.col("all")).alias("below"))
    inside = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base_of = size.withColumn("inside", inside).join(bucket, "length").select("length", "part", (F.col("below") + F.col("inside")).alias("first"))
    out = pieces.join(base_of, ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
