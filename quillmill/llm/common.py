"""Shared plumbing of the training-data operators: word hashing, filters, connected components, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.sources.durable import discard, settle, work_dir

__all__ = ["carry", "connected_components", "discard", "leave", "ordered_partitions", "release", "release_driver", "settle", "tidy", "with_running_sum", "work_dir"]

#: Bytes of text that one vectorised hashing step takes at once; bounds the scratch arrays, not the documents.
STEP_BYTES = 1 << 19


# ---------------------------------------------------------------- hashing of words, vectorised over a batch of texts

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_Q = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_MASK = (1 << 64) - 1
_SLOT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        have = out
        if size <= 2 * STEP_BYTES:  # a very long text's powers aren't kept
            _powers[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and each text's first index (length
    ``len(texts) + 1``). ``lower`` folds A-Z only."""
    data = "\n".join(t or "" for t in texts).encode("utf-8", "surrogatepass") + b"\n"
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    begin, end = edge[0::2], edge[1::2]
    h = np.cumsum((_LOWER if lower else _BYTE)[buf] * powers(_P, len(buf)), dtype=np.uint64)
    before = np.where(begin > 0, h[begin - 1], np.uint64(0))
    words = mix((h[end - 1] - before) * powers(pow(_P, -1, 1 << 64), len(buf))[begin])
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 if t else 1 for t in texts), np.int64, len(texts))
    return words, np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths))))


def string_hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of an array without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    h = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_P, len(buf)), dtype=np.uint64)))
    start, end = at[:-1], at[1:]
    return mix((h[end] - h[start]) * powers(pow(_P, -1, 1 << 64), len(buf) + 1)[start] ^ mix((end - start).astype(np.uint64)))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text, in order; a shorter text is one shingle, no words give none."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    m = len(words) - k + 1
    out = np.full(m, (k * 0x9E3779B97F4A7C15) & _MASK, np.uint64)
    for i in range(k):
        out += words[i : i + m] * _SLOT[i]
    return mix(out)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words (none if there are fewer), by prefix sums."""
    if len(words) < n:
        return words[:0]
    g = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(_Q, len(words)), dtype=np.uint64)))
    m = len(words) - n + 1
    return mix((g[n:] - g[:m]) * powers(pow(_Q, -1, 1 << 64), m))


def in_steps(texts, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts (or their lengths) of about ``size`` characters; a longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = 1 if t is None else len(t) if isinstance(t, str) else int(t)
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


# ---------------------------------------------------------------- a filter of fixed size

#: Bits of the filter (8 MB), in the slices that tasks send. When it fills up, it lets more through and stays right.
BLOOM_BITS, BLOOM_SLICE = 1 << 26, 1 << 19


def _bits(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = mix(a)
    return (m >> np.uint64(38)).astype(np.int64), ((m & np.uint64(0xFFFFFFFF)) >> np.uint64(6)).astype(np.int64)


def _bloom_slices(batches):
    have = np.zeros(BLOOM_BITS // 8, np.uint8)
    for b in batches:
        for bit in _bits(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)):
            np.bitwise_or.at(have, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    size = BLOOM_SLICE // 8
    full = [i for i in range(BLOOM_BITS // BLOOM_SLICE) if have[i * size : (i + 1) * size].any()]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([have[i * size : (i + 1) * size].tobytes() for i in full], pa.binary())], names=["slice", "bits"])


def _or_slices(batches):
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column("slice").to_pylist(), b.column("bits").to_pylist(), strict=True):
            c = np.frombuffer(c, np.uint8)
            have[i] = have[i] | c if i in have else c
    yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([c.tobytes() for c in have.values()], pa.binary())], names=["slice", "bits"])


def bloom_of(keys: DataFrame) -> np.ndarray:
    """The filter of ``keys(key long)`` as bytes: slices are united on the executors; the driver gets the 8 MB that remain."""
    out, size = np.zeros(BLOOM_BITS // 8, np.uint8), BLOOM_SLICE // 8
    per_task = keys.mapInArrow(_bloom_slices, "slice int, bits binary").repartition(F.col("slice"))
    for r in per_task.mapInArrow(_or_slices, "slice int, bits binary").toLocalIterator():
        out[r["slice"] * size : (r["slice"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    return out


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x, y = _bits(keys)
    return ((bits[x >> 3] >> (x & 7)) & (bits[y >> 3] >> (y & 7)) & 1).astype(bool)


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, root: str, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, component being the least node that links reach; nodes with no edge are
    absent.

    Alternating large and small stars: each round replaces edges by edges to smaller neighbours, so the edge count
    never grows and a hub's neighbours are joined on, never gathered. Minima are partial aggregates; the join back is
    one that adaptive execution may split where a hub is hot. It ends when every edge leads to the root of a star.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, at = settle(now, f"{root}/cc0"), f"{root}/cc0"
    for k in range(1, rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        now = settle(small, f"{root}/cc{k}")
        release_driver(spark)
        discard(spark, at)
        at = f"{root}/cc{k}"
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- running sums over the whole table


def ordered_partitions(df: DataFrame, order: list, path: str, parts: int) -> DataFrame:
    """Write ``df`` range-partitioned by ``order`` and read it with ``part``: ascending parts hold ascending ranges."""
    out = df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    return settle(out, path)


def with_running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one in (part, order). One row a part is summed in a
    single place; rows are summed within their part."""
    total = df.groupBy("part").agg(F.sum(value).alias("_all"))
    before = total.select("part", (F.sum("_all").over(Window.orderBy("part")) - F.col("_all")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part").withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before")


#: Rows of an Arrow batch that are turned into Python objects at once.
ROWS = 1024


def sliced(batches):
    for b in batches:
        for i in range(0, max(1, b.num_rows), ROWS):
            yield b.slice(i, ROWS)


_carried: dict[str, dict] = {}


def carry(kind: str) -> dict:
    """A cache that a worker keeps between tasks of one kind."""
    return _carried.setdefault(kind, {})


def leave(keep: str | None = None) -> None:
    """Empty the caches that tasks of other kinds left in this worker."""
    left = [cache for kind, cache in _carried.items() if kind != keep and cache]
    for cache in left:
        cache.clear()
    if left:
        release()


def tidy(run, whole: bool = False, keep: str | None = None):
    """A function over Arrow batches, fed in slices unless ``whole``, that hands its memory back when its task ends:
    workers outlive tasks and stages. Of what earlier tasks left, only the cache ``keep`` stays."""

    def wrapped(batches):
        leave(keep)
        try:
            yield from run(batches if whole else sliced(batches))
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release_driver(spark: SparkSession) -> None:
    """Hand back what finished work left in the driver: dropped broadcasts and query plans, in its JVM and in Python. What a
    JVM's own threads have freed stays in its process until it is trimmed, too (Java 17.0.9 on; elsewhere this is left out)."""
    gc.collect()
    release()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(commands, "systemTrimNativeHeap", None, None)
