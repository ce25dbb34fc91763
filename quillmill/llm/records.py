"""Length-delimited binary records of token ids, with a separate offset index.

A shard is a sequence of frames, each: payload length (u64), masked CRC-32 of those 8 bytes (u32), payload, masked
CRC-32 of the payload (u32), all little-endian. A payload is one document: a flag byte (1: id is null, 2: ids take 4
bytes each, else 2), the document id (i64), the token ids. The index beside it has 24 bytes a frame (its offset, its
payload length, the tokens of the shard before it), so readers fetch frames in any order and share a shard's work. The
mask (rotate right by 15, add 0xA282EAD8) keeps a checksum of data that holds checksums from degenerating.

Texts are encoded where they lie and only ids travel to the shards. Tasks write under a name of their own; the
manifest, written by Spark after a task succeeds, names the files that count, and what failed attempts left beside them
is deleted then. A lost executor costs its tasks' files, which are written again under new names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import settle, tidy, work_dir
from quillmill.llm.tokens import CACHE, default_path, encoder
from quillmill.sources.durable import hadoop_path, open_uri, qualified

END_ID = 2
#: Bytes of text in a shard, least bytes of one where shards are few, and bytes of records that one reading task takes.
SHARD_BYTES, LEAST_BYTES, SPLIT_BYTES = 256 << 20, 1 << 20, 64 << 20
#: Rows a shard in the sample that sets where shards begin.
SAMPLE = 200
_LENGTH, _CRC, _HEAD, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQQ")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _LENGTH.pack(len(payload))
    return b"".join((head, _CRC.pack(masked_crc(head)), payload, _CRC.pack(masked_crc(payload))))


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return _HEAD.pack((doc_id is None) | 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    flag, doc_id = _HEAD.unpack_from(payload)
    return None if flag & 1 else doc_id, np.frombuffer(payload, "<u4" if flag & 2 else "<u2", offset=_HEAD.size).astype("<u4")


def index_entry(offset: int, length: int, tokens: int) -> bytes:
    return _ENTRY.pack(offset, length, tokens)


def read_frame(f) -> bytes | None:
    """The next payload of an open file; None at its end. A frame that is cut short or damaged raises ValueError."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or _CRC.unpack_from(head, 8)[0] != masked_crc(head[:8]):
        raise ValueError("damaged record length")
    n = _LENGTH.unpack_from(head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or _CRC.unpack_from(body, n)[0] != masked_crc(body[:n]):
        raise ValueError("damaged record")
    return body[:n]


def index_at(index_uri: str, k: int) -> tuple[int, int, int]:
    """(offset, payload length, tokens before) of record k of a shard."""
    fs, path = open_uri(index_uri)
    with fs.open_input_file(path) as f:
        f.seek(k * _ENTRY.size)
        return _ENTRY.unpack(f.read(_ENTRY.size))


def read_at(uri: str, index_uri: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a shard by its offset index alone."""
    fs, path = open_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(index_at(index_uri, k)[0])
        return unpack_ids(read_frame(f))


def _encode(path: str, end_id: int, bounds):
    """(shard, id, tie, place, tokens, payload) of each text: the shard by where (id, tie, place) lies among ``bounds``."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "tie", "place")]
            shard, tokens, payload = [], [], []
            for i, tie, place, ids in zip(*columns, enc.texts(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                shard.append(bisect_right(bounds.value, _key(i, tie, place)))
                tokens.append(len(ids))
                payload.append(pack_ids(i, ids))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *[batch.column(c) for c in ("id", "tie", "place")], pa.array(tokens, pa.int64()), pa.array(payload, pa.binary())], names=["shard", "id", "tie", "place", "tokens", "payload"])

    return run


def _key(i: int | None, tie: int, place: int) -> tuple:
    """Null ids come first."""
    return (i is not None, i or 0, tie, place)


_MANIFEST = "part int, path string, index_path string, records long, tokens long, bytes long"


def _write(folder: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        stem = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}"
        fs, name = open_uri(stem)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        records = tokens = at = 0
        with fs.open_output_stream(f"{name}.bin", buffer_size=1 << 20) as out, fs.open_output_stream(f"{name}.idx", buffer_size=1 << 16) as index:
            for batch in batches:
                for n, payload in zip(batch.column("tokens").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    data = frame(payload)
                    out.write(data)
                    index.write(index_entry(at, len(payload), tokens))
                    at += len(data)
                    records += 1
                    tokens += n
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{stem}.bin", "index_path": f"{stem}.idx", "records": records, "tokens": tokens, "bytes": at}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    return run


def _sweep(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """Delete shards that the manifest doesn't name: what failed attempts wrote."""
    fs, path = hadoop_path(spark, folder)
    if not fs.exists(path):
        return
    names = {p.rpartition("/")[2] for r in manifest.select("path", "index_path").toLocalIterator() for p in r}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("shard-") and name not in names:
            fs.delete(status.getPath(), False)


def write_token_records(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, and write shards in ascending id order (null ids first, repeated ids by
    their text's hash, then as read) into ``folder``, which must be empty or new. Returns the manifest ``(part, path,
    index_path, records, tokens, bytes, start, first)``, where ``start`` and ``first`` count the tokens and records of
    all shards before. Shards are sized by bytes unless ``shards`` says how many. Null texts are their end id alone; a
    text of any length is one record; an empty table gives an empty manifest or empty shards; extra columns are ignored.
    """
    spark = docs.sparkSession
    root = work_dir(spark)
    folder = qualified(spark, folder or f"{root}/records")
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    size = base.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if shards is None:
        shards = max(1, -(-size["bytes"] // SHARD_BYTES), min(4 * spark.sparkContext.defaultParallelism, size["bytes"] // LEAST_BYTES))
    bounds: list[tuple] = []
    if shards > 1:  # a sample by hash, of about SAMPLE rows a shard, sets where shards begin
        some = F.pmod(F.xxhash64("id", "tie", "place"), F.lit(1 << 30)) < min(1 << 30, (SAMPLE * shards << 30) // max(1, size["rows"]))
        keys = sorted(_key(*r) for r in base.select("id", "tie", "place").where(some).collect())
        bounds = [keys[len(keys) * k // shards] for k in range(1, shards)] if keys else []
    held = spark.sparkContext.broadcast(bounds)
    encoded = base.mapInArrow(tidy(_encode(path or default_path(), end_id, held), keep=CACHE), "shard int, id long, tie long, place long, tokens long, payload binary")
    ordered = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("id", "tie", "place").select("tokens", "payload")
    manifest = settle(ordered.mapInArrow(tidy(_write(folder)), _MANIFEST), f"{root}/manifest")
    _sweep(spark, folder, manifest)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.select("*", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first"))


def _read(with_ids: bool):
    names = ["id", "record", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            for split in batch.to_pylist():
                offset, _, before = index_at(split["index_path"], split["from"])
                start, out = split["start"] + before, [[] for _ in names]

                def rows(out=out):
                    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(out, names, strict=True)], names=names)

                fs, path = open_uri(split["path"])
                with fs.open_input_file(path) as f:
                    f.seek(offset)
                    for k in range(split["from"], split["to"]):
                        i, ids = unpack_ids(read_frame(f))
                        raw = ids.tobytes()
                        for col, v in zip(out, (i, split["first"] + k, start, len(ids), zlib.crc32(raw), raw), strict=False):
                            col.append(v)
                        start += len(ids)
                        if len(out[0]) >= 4096:
                            yield rows()
                            for col in out:
                                col.clear()
                yield rows()

    return run


def read_token_records(spark: SparkSession, manifest: DataFrame, with_ids: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(id, record, start, n_tokens, ids_crc32, ids)`` of every frame, checked against its checksums; ``record`` and
    ``start`` count records and ids before it over all shards. The index cuts a shard into ranges of records of about
    ``split_bytes``, each of them one row of work. An empty shard or manifest gives no rows."""
    schema = "id long, record long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    n = F.greatest(F.lit(1), F.least(F.ceil(F.col("bytes") / split_bytes), F.col("records")))
    work = manifest.where("records > 0").withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = lambda k: F.floor(F.col("records") * k / F.col("n")).cast("long")
    work = work.select("path", "index_path", "start", "first", cut(F.col("k")).alias("from"), cut(F.col("k") + 1).alias("to"))
    return work.repartition("path", "from").mapInArrow(tidy(_read(with_ids)), schema)
