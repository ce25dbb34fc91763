"""Source divergence audit: how far the sources of a language differ in the words they use.

Every task counts the terms of its texts in byte tries, one a language, whose leaves hold a counter a source and the
number of documents. Walking a trie in UTF-8 order gives its leaves as a sorted stream; the streams of all tries are
dealt by language and the first bytes, so what lies below a prefix meets in one place, in UTF-8 order again, and equal
paths are merged as they pass by: no task holds more than a batch and the leaf it is at, and a word in every document is
a row a task. The tries
are cut off at a bounded number of leaves, which adds rows, not errors. A first pass counts documents by hash of the term,
so that terms of too few documents mostly stay out of the tries; what it lets pass is counted exactly.

Of the merged leaves only kept terms go on. Pairs of sources are compared in tiles: blocks of sources against blocks, a
bucket of terms at a time; what a pair has no count for in either is added in one product.
"""

from __future__ import annotations

from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.byte_words import LETTERS, spans, steps
from quillmill.llm.common import mix, ordered_partitions, settle, string_hashes, tidy, with_running_sum, work_dir

LEAST_DOCS, UNIT, SMOOTH, TOP = 10, 1_000_000_000, 2, 10
#: Bytes of text a step; leaves and counters of a task's tries before they are handed on; rows of an Arrow batch.
STEP_BYTES, LEAVES, COUNTERS, ROWS = 1 << 20, 300_000, 1_500_000, 4096
#: Bytes that terms of a prefix range share.
PREFIX = 4
#: Buckets of the filter (2 MB of bits) and those that travel together.
FILTER_BITS, SLICE = 24, 4096
#: Sources of a block and terms of a bucket of the tiles that compare pairs.
BLOCK, BUCKET = 64, 4096
#: Rows of (language, source) that number a part.
PART_ROWS = 500_000


class RadixTrie:
    """A byte trie with whole labels on its edges. Leaves are numbers that ``new`` hands out; what is counted at them
    lies beside the trie. A node is [label, leaf or -1, children by first byte or None]."""

    def __init__(self, new):
        self.new, self.root = new, {}

    def leaf(self, term: bytes) -> int:
        """The leaf of a term, which must not be empty; added if it is new."""
        children, at, size = self.root, 0, len(term)
        while True:
            node = children.get(term[at])
            if node is None:
                leaf = next(self.new)
                children[term[at]] = [term[at:], leaf, None]
                return leaf
            label = node[0]
            if term.startswith(label, at):
                at += len(label)
            else:  # the edge forks within its label
                k = 1
                while k < size - at and label[k] == term[at + k]:
                    k += 1
                node[:] = [label[:k], -1, {label[k]: [label[k:], node[1], node[2]]}]
                at += k
            if at == size:
                if node[1] < 0:
                    node[1] = next(self.new)
                return node[1]
            if node[2] is None:
                node[2] = {}
            children = node[2]

    def walk(self):
        """(term, leaf) in order of UTF-8 bytes: a node before its children, children by their first byte."""
        stack = [(b"", self.root[c]) for c in sorted(self.root, reverse=True)]
        while stack:
            prefix, (label, leaf, children) = stack.pop()
            term = prefix + label
            if leaf >= 0:
                yield term, leaf
            if children:
                stack.extend((term, children[c]) for c in sorted(children, reverse=True))


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_LEAF_DDL = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of ``n``."""
    u, inv = np.unique(keys, return_inverse=True)
    out = np.zeros(len(u), np.int64)
    np.add.at(out, inv, n)
    return u, out


def document_terms(langs: list[str], data: np.ndarray, offsets: np.ndarray):
    """(terms, languages, each, at, row, n) of some texts, given by their bytes: the distinct terms; the distinct languages;
    the distinct ``language * len(terms) + term``, ascending; and for each term of each row which of those it is, the row,
    and how often it occurs there. None without terms."""
    begin, end, first = spans(data, offsets, LETTERS)
    if not len(begin):
        return None
    ends = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[LETTERS[data]])]).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    u, n = np.unique(np.repeat(np.arange(len(langs)), np.diff(first)) * len(terms) + code, return_counts=True)
    row, code = u // len(terms), u % len(terms)
    number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    lang = np.array([number[x] for x in langs], np.int64)
    each, at = np.unique(lang[row] * len(terms) + code, return_inverse=True)
    return terms, list(number), each, at, row, n


def buckets_of(terms: pa.Array, langs: list[str], each: np.ndarray) -> np.ndarray:
    """The filter's bucket of each (language, term)."""
    of_term, of_lang = string_hashes(terms.cast(pa.binary())), string_hashes(pa.array(langs, pa.string()))
    return (mix(of_term[each % len(terms)] + mix(of_lang[each // len(terms)])) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_slices(least: int):
    """(slice, counts): how many documents have a term of a bucket, no more than ``least``."""

    def run(batches):
        have = np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, data, offsets in steps(batch.column("text"), STEP_BYTES):
                found = document_terms(langs[a:b], data, offsets)
                if found is not None:
                    terms, names, each, at, _, _ = found
                    k, n = _summed(buckets_of(terms, names, each), np.bincount(at))
                    have[k] = np.minimum(have[k] + n, least)
        have = have.reshape(-1, SLICE)
        full = np.flatnonzero(have.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([have[i].tobytes() for i in full], pa.binary())], names=["slice", "counts"])

    return run


def _sum_slices(least: int):
    """(slice, bits): the buckets that ``least`` documents reach, of all that a task gets of each slice."""

    def run(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(c, np.uint8)
                have[i] = np.minimum(have[i] + n, least).astype(np.uint8) if i in have else n
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([np.packbits(n >= least).tobytes() for n in have.values()], pa.binary())], names=["slice", "bits"])

    return run


def often_filter(docs: DataFrame, least: int) -> np.ndarray:
    """A bit a bucket: whether ``least`` documents may have a term of it. Of a fixed size: the driver gets 2 MB, and
    where it fills up more terms pass and the result is the same."""
    least = min(least, 200)  # a byte a bucket
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    each = docs.select("lang", "text").mapInArrow(tidy(_filter_slices(least)), "slice int, counts binary").repartition(F.col("slice"))
    for r in each.mapInArrow(tidy(_sum_slices(least), whole=True), "slice int, bits binary").toLocalIterator():
        out[r["slice"] * SLICE >> 3 : (r["slice"] + 1) * SLICE >> 3] = np.frombuffer(r["bits"], np.uint8)
    return out


class Counts:
    """A task's tries with what their leaves count."""

    def __init__(self):
        self.new, self.tries, self.groups = count(), {}, {}
        self.docs, self.size = np.zeros(0, np.int64), 0
        self.keys, self.n = [], []

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def leaves(self, lang: str, terms: list[bytes]) -> np.ndarray:
        if lang not in self.tries:
            self.tries[lang] = RadixTrie(self.new)
        leaf = self.tries[lang].leaf
        return np.fromiter(map(leaf, terms), np.int64, len(terms))

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray, often) -> None:
        """Count the terms of some texts, given by their bytes; only those that ``often`` lets pass."""
        found = document_terms(langs, data, offsets)
        if found is None:
            return
        terms, names, each, inv, row, n = found
        size = len(terms)
        go = often(terms, names, each)
        if not go.any():
            return
        here = each[go]
        vocabulary = dict(zip(some := np.unique(here % size), terms.take(pa.array(some)).to_pylist(), strict=True))
        leaf, cut = np.full(len(each), -1, np.int64), np.searchsorted(here, np.arange(len(names) + 1) * size)
        leaf[go] = np.concatenate([self.leaves(name, [vocabulary[k] for k in (here[cut[i] : cut[i + 1]] - i * size).tolist()]) for i, name in enumerate(names)])
        self.size = max(self.size, int(leaf.max()) + 1)
        group = np.array([self.group(x, s) for x, s in zip(langs, sources, strict=True)], np.int64)
        leaf = leaf[inv]
        ok = leaf >= 0
        leaf, row, n = leaf[ok], row[ok], n[ok]
        keys, n = _summed(leaf << 32 | group[row], n)
        self.keys.append(keys)
        self.n.append(n)
        more = np.bincount(leaf)  # a row for each document that has the term
        if len(more) > len(self.docs):
            self.docs = np.concatenate((self.docs, np.zeros(max(len(more), 2 * len(self.docs)) - len(self.docs), np.int64)))
        self.docs[: len(more)] += more
        if sum(map(len, self.keys)) > 2 * COUNTERS:
            self.compact()

    def compact(self) -> None:
        if self.keys:
            keys, n = _summed(np.concatenate(self.keys), np.concatenate(self.n))
            self.keys, self.n = [keys], [n]

    def full(self) -> bool:
        if sum(map(len, self.keys)) > COUNTERS:
            self.compact()
        return sum(map(len, self.keys)) > COUNTERS or self.size > LEAVES

    def streams(self):
        """The leaves of all tries, in order of language and UTF-8, as record batches."""
        self.compact()
        if not self.keys:
            return
        keys, n = self.keys[0], self.n[0]
        names = pa.array([s for _, s in self.groups], pa.string())
        at = np.searchsorted(keys, np.arange(len(self.docs) + 1) << 32)
        for lang in sorted(self.tries, key=lambda x: x.encode("utf-8", "surrogatepass")):
            walk, done = self.tries[lang].walk(), False
            while not done:
                some = list(islice(walk, ROWS))
                done = len(some) < ROWS
                if not some:
                    break
                leaf = np.array([x[1] for x in some], np.int64)
                sizes = at[leaf + 1] - at[leaf]
                lists = np.concatenate(([0], np.cumsum(sizes)))
                take = np.arange(lists[-1]) + np.repeat(at[leaf] - lists[:-1], sizes)
                cuts = pa.array(lists.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([x[0].decode("utf-8", "replace") for x in some], pa.string()),
                        pa.array(self.docs[leaf]),
                        pa.ListArray.from_arrays(cuts, names.take(pa.array(keys[take] & 0xFFFFFFFF))),
                        pa.ListArray.from_arrays(cuts, pa.array(n[take])),
                    ],
                    schema=_LEAF,
                )


def _count(held):
    def often(terms, langs, each):
        k = buckets_of(terms, langs, each)
        return (held.value[k >> 3] >> (7 - (k & 7)) & 1).astype(bool)

    def run(batches):
        have = Counts()
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for a, b, data, offsets in steps(batch.column("text"), STEP_BYTES):
                have.add(langs[a:b], sources[a:b], data, offsets, often)
                if have.full():
                    yield from have.streams()
                    have = Counts()
        yield from have.streams()

    return run


def merge_leaves(t: pa.Table) -> pa.Table:
    """One row for each run of rows of the same language and term, their counters added up."""
    lang, term = t.column("lang").combine_chunks(), t.column("term").combine_chunks()
    if len(t) < 2:
        return t
    same = np.logical_and(*(pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (lang, term)))
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    run = np.cumsum(np.concatenate(([0], ~same)))
    lists = t.column("sources").combine_chunks()
    names = lists.flatten().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    keys, n = _summed(np.repeat(run, sizes) << 32 | code, t.column("counts").combine_chunks().flatten().to_numpy())
    cuts = pa.array(np.searchsorted(keys, np.arange(len(starts) + 1) << 32).astype(np.int32))
    docs = np.add.reduceat(t.column("docs").to_numpy(), starts)
    columns = [lang.take(pa.array(starts)), term.take(pa.array(starts)), pa.array(docs), pa.ListArray.from_arrays(cuts, names.dictionary.take(pa.array(keys & 0xFFFFFFFF))), pa.ListArray.from_arrays(cuts, pa.array(n))]
    return pa.Table.from_arrays(columns, schema=_LEAF)


def _merge(least: int):
    """The leaves of a range of terms, merged; those of fewer than ``least`` documents go."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).cast(_LEAF)
            t = merge_leaves(t if held is None else pa.concat_tables([held, t]))
            held = t.slice(len(t) - 1).combine_chunks()  # the last leaf may go on in the next batch
            t = t.slice(0, len(t) - 1)
            yield from t.filter(pc.greater_equal(t.column("docs"), least)).to_batches()
        if held is not None and held.column("docs")[0].as_py() >= least:
            yield from held.to_batches()

    return run


def kept_terms(docs: DataFrame, root: str, least_docs: int) -> DataFrame:
    """``lang, term, docs, sources, counts`` of the terms in at least ``least_docs`` documents of their language."""
    held = docs.sparkSession.sparkContext.broadcast(often_filter(docs, least_docs))
    leaves = docs.mapInArrow(tidy(_count(held)), _LEAF_DDL)
    met = leaves.repartition("lang", F.substring(F.col("term").cast("binary"), 1, PREFIX)).sortWithinPartitions("lang", "term")
    return settle(met.mapInArrow(tidy(_merge(least_docs), whole=True), _LEAF_DDL), f"{root}/kept")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)) in whole numbers; 0 where nothing is kept."""
    below = f"cast({total} + {SMOOTH} * {terms} as decimal(20,0))"
    return F.expr(f"coalesce(1 + (cast({n} + {SMOOTH} as decimal(20,0)) * cast({UNIT} as decimal(10,0))) div nullif({below}, cast(0 as decimal(20,0))), 0)").cast("long")


def _far(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most UNIT + 1, so 64 bits hold the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


_TILE = pa.schema([("lang", pa.string()), *[(c, pa.int64()) for c in ("i", "j", "a", "b", "value", "terms")]])


def _tile(key: tuple, t: pa.Table) -> pa.Table:
    """Sums over a bucket's terms for all pairs of two blocks of sources. Rows without a term are a block's shares for a
    count of 0; side 0 is the first block, 1 the second (a block against itself has side 0 only)."""
    lang, i, j, _ = (k.as_py() for k in key)
    side, head = t.column("side").to_numpy(), pc.is_null(t.column("term")).to_numpy()
    terms = t.column("term").combine_chunks().dictionary_encode()
    n, code = len(terms.dictionary), terms.indices.to_numpy(zero_copy_only=False)
    lists = t.column("cells").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    pos, p = flat.field("pos").to_numpy(), flat.field("p").to_numpy()
    of, at, first = np.repeat(side, sizes), np.repeat(code, sizes), np.repeat(head, sizes)
    grid = []
    for s in (0,) if i == j else (0, 1):
        k = first & (of == s)
        base = np.zeros(int(k.sum()), np.int64)
        base[pos[k]] = p[k]
        g = np.tile(base, (n, 1))
        k = ~first & (of == s)
        g[at[k].astype(np.int64), pos[k]] = p[k]
        grid.append(g)
    left, right = grid[0], grid[-1]
    out = []
    for a in range(left.shape[1]):
        b = np.arange(a + 1 if i == j else 0, right.shape[1])
        own, other = left[:, a : a + 1], right[:, b]
        d = own - other
        out.append(np.stack((np.full(len(b), a), b, (d * d // np.maximum(own + other, 1)).sum(axis=0))))
    a, b, value = np.concatenate(out, axis=1).astype(np.int64)
    same = lambda v: pa.array(np.full(len(a), v, np.int64))
    return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), same(i), same(j), pa.array(a), pa.array(b), pa.array(value), same(n)], schema=_TILE)


def _tiles(rows: DataFrame) -> DataFrame:
    """Each row of a block at every tile that the block is part of."""
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y"))
    return each.select("lang", F.least("block", "y").alias("i"), F.greatest("block", "y").alias("j"), "bucket", "term", F.when(F.col("block") <= F.col("y"), 0).otherwise(1).alias("side"), "cells")


def pair_sums(cells: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of each ordered pair of sources of a language. ``cells(lang, term, source, p)``."""
    some = known.where("sources > 1")
    own = some.select("lang", "source", "block", "pos", "blocks", "buckets")
    cell = F.struct(F.col("pos").alias("pos"), F.col("p").alias("p"))
    vectors = cells.select("lang", "term", "source", "p").join(own, ["lang", "source"]).groupBy("lang", "term", "block", "blocks", "buckets").agg(F.collect_list(cell).alias("cells"))
    vectors = vectors.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))
    heads = some.withColumn("p", F.col("p0")).groupBy("lang", "block", "blocks", "buckets").agg(F.collect_list(cell).alias("cells"))
    heads = heads.select("*", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    found = _tiles(vectors).union(_tiles(heads)).groupBy("lang", "i", "j", "bucket").applyInArrow(_tile, "lang string, i long, j long, a long, b long, value long, terms long")
    sums = found.groupBy("lang", "i", "j", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("seen"))
    side = lambda block, pos, tag: some.select("lang", F.col("block").alias(block), F.col("pos").alias(pos), F.col("source").alias(f"s{tag}"), F.col("p0").alias(f"p{tag}"), F.col("terms").alias(f"v{tag}"))
    named = sums.join(side("i", "a", "1"), ["lang", "i", "a"]).join(side("j", "b", "2"), ["lang", "j", "b"])
    rest = F.when(F.col("v1") > 0, (F.col("v1") - F.col("seen")) * F.expr("((p1 - p2) * (p1 - p2)) div nullif(p1 + p2, 0)")).otherwise(0)
    named = named.withColumn("value", F.col("value") + rest)
    return named.select("lang", F.col("s1").alias("source"), F.col("s2").alias("item"), "value").union(named.select("lang", F.col("s2").alias("source"), F.col("s1").alias("item"), "value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language, part ``pair`` ranks every other source
    of it by the distance of their shares of the language's kept terms, and part ``term`` the ``top`` terms that the
    source has more of than its language.

    Null texts, languages and sources are empty strings, which are a language and a source like others; rows are
    documents, repeated ones too; a text of any length counts whole. Ties go to the lesser item in UTF-8. A language
    that keeps no terms has pairs of value 0 and no terms; a sole source has no pairs. An empty table gives no rows;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    root = work_dir(spark)
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    base = docs.select(blank(lang_col, "lang"), blank(source_col, "source"), blank(text_col, "text"))
    kept = kept_terms(base, root, least_docs).withColumn("n_all", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_all").alias("lang_total"))
    cells = kept.select("lang", "term", "n_all", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", "term", "n_all", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = base.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    known = settle(known.withColumn("zero", F.lit(0)).withColumn("p0", _share("zero", "total", "terms")).withColumn("one", F.lit(1)), f"{root}/known")
    parts = max(1, -(-known.count() // PART_ROWS))
    at = with_running_sum(ordered_partitions(known, ["lang", "source"], f"{root}/order", parts), ["lang", "source"], "one", "at")
    ends = at.groupBy("lang").agg(F.min("at").alias("low"), F.count("*").alias("sources"))
    at = at.join(ends, "lang").withColumn("k", F.col("at") - F.col("low")).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("terms") / BUCKET)).cast("long"))
    known = settle(at.select("lang", "source", "total", "terms", "lang_total", "p0", "sources", "buckets", F.expr(f"k div {BLOCK}").alias("block"), (F.col("k") % BLOCK).alias("pos"), F.ceil(F.col("sources") / BLOCK).cast("long").alias("blocks")), f"{root}/sources")
    cells = cells.join(known.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    cells = cells.withColumn("p", _share("n", "total", "terms")).withColumn("q", _share("n_all", "lang_total", "terms"))
    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = ["lang", "source", "part", "item", "value", "rank"]
    terms = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value")).withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)
    pairs = pair_sums(cells, known).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(over))
    return pairs.select(*names).union(terms.select(*names))
