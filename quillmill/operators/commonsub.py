"""The longest substring that a text has in common with any text of a reference, of every length from 1.

A block of the reference is a row of characters with its pieces' 64-bit hashes by prefix sums; the hashes of all pieces of
one length are sorted once when that length is first asked for. A text's longest match in the block is found by doubling
the length while some piece of it occurs, then halving the step: pieces that occur at a length begin where pieces of half
that length occur, so few places are looked at beyond the first length. The piece found is compared as text; if its hash
alone agrees, the search is made anew with every piece compared (those of up to four characters are told apart by their
hashes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillmill.functions import text as X
from quillmill.operators.blocks import meet, spread

_P = 0x9E3779B97F4A7C15
#: Characters of a block of the reference, pieces that are kept sorted, of whatever lengths, and the length tried first.
BLOCK, KEPT, FIRST = 500_000, 4_000_000, 16
#: Characters of a block of pieces whose lengths are given.
GRAMS = 8_000_000
_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    while len(_power) < n:
        step = np.uint64(pow(_P, len(_power), 1 << 64))
        _power = np.concatenate((_power, _power * step))
    return _power[:n]


def _prefix(cp: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((cp + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * _powers(len(cp)), dtype=np.uint64)))


def _hash(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the pieces of ``size`` characters at some places: moved to a common power, so that equal pieces agree."""
    inverse = _inverses(len(sums))
    h = (sums[at + size] - sums[at]) * inverse[at]
    return h ^ (h >> np.uint64(29))


_inverse = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inverse
    one = pow(_P, -1, 1 << 64)
    while len(_inverse) < n:
        _inverse = np.concatenate((_inverse, _inverse * np.uint64(pow(one, len(_inverse), 1 << 64))))
    return _inverse[:n]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Hashes:
    """Distinct hashes, ascending, with a number for each. A table of bits, looked at first, keeps most others out."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.have, at = np.unique(hashes, return_index=True)
        self.numbers = numbers[at]
        bits = max(10, (4 * len(self.have)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[(self.have >> self.shift).astype(np.int64)] = True

    def among(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are had, the numbers of those)"""
        places = np.flatnonzero(self.some[(hashes >> self.shift).astype(np.int64)])
        if not len(places):
            return places, places
        k = np.minimum(np.searchsorted(self.have, hashes[places]), len(self.have) - 1)
        hit = self.have[k] == hashes[places]
        return places[hit], self.numbers[k[hit]]


class Block:
    """The pieces of some texts by length."""

    def __init__(self, texts: list[str]):
        self.texts = "".join(texts)
        self.sums = _prefix(_points(self.texts))
        size = np.array([len(t) for t in texts], np.int64)
        self.longest = int(size.max()) if len(size) else 0
        self.left = np.repeat(np.cumsum(size), size) - np.arange(len(self.texts))  # characters up to the end of a place's text
        self.kept: dict[int, Hashes] = {}

    def pieces(self, size: int) -> Hashes:
        """The distinct pieces of a length, with where each begins."""
        if size not in self.kept:
            if sum(len(x.have) for x in self.kept.values()) > KEPT:
                self.kept.clear()
            at = np.flatnonzero(self.left >= size)
            self.kept[size] = Hashes(_hash(self.sums, at, size), at)
        return self.kept[size]


def longest_match(block: Block, text: str) -> int:
    """Characters of the longest piece of ``text`` that is one of the block's, by its characters."""
    size = _longest(block, text, False)
    return _longest(block, text, True) if size < 0 else size


def _longest(block: Block, text: str, each: bool) -> int:
    """Compared as text are the pieces of every length (``each``), or only those found at the end; if none of these is
    real, the answer is -1."""
    sums, n = _prefix(_points(text)), len(text)
    most = min(n, block.longest)

    def places(size: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some places those at which a piece of the block begins, and where in the block."""
        some = some[some + size <= n]
        hit, where = block.pieces(size).among(_hash(sums, some, size))
        some = some[hit]
        if each and size > 4:
            real = np.array([text[a : a + size] == block.texts[b : b + size] for a, b in zip(some.tolist(), where.tolist(), strict=True)], bool)
            some, where = some[real], where[real]
        return some, where

    size, at, where = 0, np.arange(n), None
    step = FIRST
    while size + step <= most and len((found := places(size + step, at))[0]):  # doubling
        size, (at, where) = size + step, found
        step = size
    while step > 1:  # a length between size and size + step is left
        step //= 2
        if size + step <= most and len((found := places(size + step, at))[0]):
            size, (at, where) = size + step, found
    if each or size <= 4 or any(text[a : a + size] == block.texts[b : b + size] for a, b in zip(at.tolist(), where.tolist(), strict=True)):
        return size
    return -1


class Grams:
    """Pieces of a few lengths, each told by its hash and then compared as text."""

    def __init__(self, grams: list[str], sizes: tuple[int, ...]):
        self.sizes = {}
        for k in sizes:
            own = [g for g in grams if len(g) == k]
            at = np.arange(0, k * len(own), k)
            self.sizes[k] = own, Hashes(_hash(_prefix(_points("".join(own))), at, k), np.arange(len(own)))

    def count(self, text: str) -> list[int]:
        """For each length the places of ``text`` at which one of the pieces begins."""
        sums, out = _prefix(_points(text)), []
        for k, (own, hashes) in self.sizes.items():
            at, which = hashes.among(_hash(sums, np.arange(max(0, len(text) - k + 1)), k))
            out.append(sum(text[a : a + k] == own[i] for a, i in zip(at.tolist(), which.tolist(), strict=True)))
        return out


def gram_counts(cand: DataFrame, ref: DataFrame, key: str, text: str, sizes: tuple[int, ...], held: int = GRAMS, block: int = GRAMS) -> DataFrame:
    """``key, total<k>, matched<k>`` for each k of ``sizes``: how many k-character pieces a row of ``cand`` has, repeats
    counted, and how many of them ``ref`` has too. Rows that share a key are added up; a null text has none."""
    grams = lambda k: ref.select(F.explode(X.shingles(F.col(text), k)).alias("gram"))
    items = grams(sizes[0])
    for k in sizes[1:]:
        items = items.union(grams(k))

    def use(index: Grams, texts: list) -> tuple[np.ndarray, list]:
        n = [index.count(t) if t else [0] * len(sizes) for t in texts]
        return np.arange(len(texts)), [pa.array([x[i] for x in n], pa.int64()) for i in range(len(sizes))]

    total = [F.greatest(F.coalesce(F.length(text), F.lit(0)) - (k - 1), F.lit(0)).cast("long").alias(f"total{k}") for k in sizes]
    rows = spread(cand.select(key, text)).select(key, F.monotonically_increasing_id().alias("_id"), *total, text)
    out = StructType([StructField(f"matched{k}", LongType()) for k in sizes])
    keep = (key, "_id", *[f"total{k}" for k in sizes])
    met = meet(rows, text, items, lambda grams: Grams(grams, sizes), use, out, held, block, keep)
    met = met.groupBy(key, "_id").agg(*[F.max(f"total{k}").alias(f"total{k}") for k in sizes], *[F.sum(f"matched{k}").alias(f"matched{k}") for k in sizes])  # a row meets each block
    return met.groupBy(key).agg(*[F.sum(c).alias(c) for k in sizes for c in (f"total{k}", f"matched{k}")])


def _use(block: Block, texts: list) -> tuple[np.ndarray, list]:
    return np.arange(len(texts)), [pa.array([longest_match(block, t) if t else 0 for t in texts], pa.int32())]


def longest_common(cand: DataFrame, ref: DataFrame, key: str, text: str = "text", held: int = BLOCK, block: int = BLOCK) -> DataFrame:
    """``key, longest``: for each row of ``cand`` the characters, white space deleted, of the longest substring that it has
    in common with any one text of ``ref``; 0 for none, for null and for empty texts. Rows that share a key are one, with
    the longest of theirs; a null key is a key."""
    bare = lambda df: X.compact(F.coalesce(F.col(text), F.lit("")))
    out = meet(spread(cand.select(key, bare(cand).alias("_text"))), "_text", ref.select(bare(ref).alias("item")), Block, _use, StructType([StructField("longest", IntegerType())]), held, block, (key,))
    return cand.select(key).distinct().join(out.groupBy(F.col(key).alias("_k")).agg(F.max("longest").alias("longest")), F.col(key).eqNullSafe(F.col("_k")), "left").select(key, F.coalesce("longest", F.lit(0)).alias("longest"))
