"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order: by a document-frequency sketch over every document, rarest first, with those that
a first round of prefixes found shared moved to the end. The order is cut into fragments at quantiles of the n-grams'
volume. A set is cut with it into one segment a fragment; of a pair of sets that may be similar, each fragment counts
the overlap of its two segments by itself, and the parts are summed per pair. Segments, not sets, are what is shuffled,
and a row holds one segment.

Which pairs may be similar: two sets with Jaccard similarity >= t share an n-gram among the first
``size - ceil(t*size) + 1`` of each, and the places at which they share bound the sizes that can. Pairs are counted in
two rounds. In the first, every set meets one hub, the set that stands first in most of its n-grams' postings: near
copies become components by as many pairs as there are sets. In the second, only postings that still hold several
components count, and there every pair of sets of different components that may be similar. After it, no link between
components is left to find, and a group of thousands of near copies was never expanded into its pairs. What two sets
can have in common is bounded before, by the smaller of their counts in each of ``CLASSES`` hash classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import bloom_of, connected_components, in_bloom, in_steps, mix, release_driver, settle, shingle_hashes, tidy, word_hashes, work_dir

#: Buckets of the document-frequency sketch: 4 MB, whatever the input. It orders n-grams; it never decides a link.
BUCKETS, SLICE = 1 << 20, 1 << 12
#: N-grams, and sets, that a chunk of a component may hold where links are counted; a tile has two chunks, and a number
#: for each of its pairs of sets.
CHUNK_NGRAMS, CHUNK_SETS = 500_000, 4096
#: An n-gram whose pairs of sets are at most one in so many of a tile's is counted pair by pair, the others by products of
#: matrices; and pairs that are counted at once.
DENSE, PAIRS = 250, 2_000_000
#: Fragments of the global order; the last one holds the n-grams moved to the end. Hash classes, by whose counts a pair
#: is bounded before its segments are fetched.
FRAGMENTS, CLASSES = 8, 256
_LOW56 = np.uint64((1 << 56) - 1)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-gram hashes (A-Z folded)."""
    for a, b in in_steps(texts):
        words, at = word_hashes(texts[a:b], True)
        for i in range(b - a):
            yield np.unique(shingle_hashes(words[at[i] : at[i + 1]], n))


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two sums of 64 bits over the set: equal sets, equal signatures."""
    with np.errstate(over="ignore"):
        a = mix(s).sum(dtype=np.uint64)
        b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def reach(size: int, positions: np.ndarray, num: int, den: int) -> np.ndarray:
    """The size of the largest partner of a set of ``size`` whose first common n-gram stands at each position of its
    order: what is left, size - position, must hold the least overlap."""
    return (size - positions) * (num + den) // num - size


def _profile(n: int):
    """A row a document (size, signature), then this task's slices of the sketch."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            ids, texts, sizes, s1, s2 = batch.column("id"), batch.column("key"), [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                sizes.append(len(s))
                x, y = signature(s)
                s1.append(x)
                s2.append(y)
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["id", "key", "size", "s1", "s2", "slice", "counts"])
        full = [i for i in range(BUCKETS // SLICE) if counts[i * SLICE : (i + 1) * SLICE].any()]
        k = len(full)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 5, pa.array(full, pa.int32()), pa.array([counts[i * SLICE : (i + 1) * SLICE].tobytes() for i in full], pa.binary())], names=["id", "key", "size", "s1", "s2", "slice", "counts"])

    return run


def _sum_slices(batches):
    """Adds sketch slices of one task up; a later step adds the tasks' sums."""
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
            c = np.frombuffer(c, np.uint32)
            have[i] = have[i] + c if i in have else c.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([c.tobytes() for c in have.values()], pa.binary())], names=["slice", "counts"])


def prefix_length(size: int, num: int, den: int) -> int:
    """N-grams of a set of ``size`` of which a partner at similarity num/den must have one."""
    return size - -(-num * size // den) + 1


def ordered_keys(s: np.ndarray, rank: np.ndarray, late: np.ndarray | None) -> np.ndarray:
    """The n-grams of a set as places in the global order: late or not, rank of the sketch, hash."""
    key = (rank[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s & _LOW56)
    return key if late is None else key | (in_bloom(late, key).astype(np.uint64) << np.uint64(63))


def fragment_bounds(counts: np.ndarray, rank: np.ndarray, fragments: int) -> np.ndarray:
    """Where fragments begin in the order: quantiles of the volume of n-grams that aren't moved, then the moved ones."""
    volume = np.bincount(rank, counts, 128)
    end = np.cumsum(volume)
    out = []
    for q in np.arange(1, fragments - 1) * end[-1] / (fragments - 1):
        r = int(np.searchsorted(end, q))
        share = (q - (end[r] - volume[r])) / volume[r] if volume[r] else 0.0
        out.append((r << 56) + int(share * (1 << 56)))
    return np.array([*sorted(min(x, (1 << 63) - 1) for x in out), 1 << 63], np.uint64)


def _prefixes(n: int, num: int, den: int, ranks, demoted=None):
    """(gram, s1, size, far) for each document's prefix in the global order, with the reach of the position; copies within
    a task are named once. N-grams in the filter ``demoted`` come last in the order."""

    def run(batches):
        rank, late, seen = ranks.value, demoted and demoted.value, set()
        for batch in batches:
            grams, s1, size, far = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                p = prefix_length(len(s), num, den)
                grams.append(np.sort(np.partition(ordered_keys(s, rank, late), p - 1)[:p]).view(np.int64))
                s1.append(np.full(p, sig[0], np.int64))
                size.append(np.full(p, len(s), np.int64))
                far.append(reach(len(s), np.arange(p), num, den))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, s1, size, far)], names=["gram", "s1", "size", "far"])

    return run


def _only(wanted, name: str):
    """Rows whose ``name`` may be in the filter; the others are not shuffled."""

    def run(batches):
        for b in batches:
            hit = in_bloom(wanted.value, b.column(name).to_numpy().view(np.uint64))
            if hit.any():
                yield b.filter(pa.array(hit))

    return run


def _segments(n: int, ranks, demoted, bounds: np.ndarray, wanted):
    """(s1, fragment, grams) of the sets of rows whose id may be wanted; each once a task, other texts aren't read.
    Fragment -1 has the set's n-grams of each hash class, counted."""

    def run(batches):
        rank, late, seen = ranks.value, demoted.value, set()
        for batch in batches:
            s1, part, grams, size = [], [], [], []
            asked = in_bloom(wanted.value, batch.column("id").to_numpy().view(np.uint64))
            for s in shingle_sets(batch.column("text").filter(pa.array(asked)).to_pylist(), n):
                if not len(s) or (a := signature(s)[0]) in seen:
                    continue
                seen.add(a)
                key = np.sort(ordered_keys(s, rank, late))
                cut = np.concatenate(([0], np.searchsorted(key, bounds), [len(key)]))
                some = np.flatnonzero(np.diff(cut))
                s1 += [a] * (len(some) + 1)
                part += [*some.tolist(), -1]
                size += [*np.diff(cut)[some].tolist(), CLASSES]
                grams += [key.view(np.int64), np.bincount((key & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)]
            if s1:
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(part, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(grams)))], names=["s1", "fragment", "grams"])

    return run


def _links(pairs: DataFrame, segments: DataFrame, num: int, den: int, path: str) -> DataFrame:
    """Those of ``pairs(a, b, size_a, size_b)`` that are similar: fragments count partial overlaps, then sums decide."""
    each = pairs.select("a", "b", "size_a", "size_b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    mine = segments.select(F.col("s1").alias("a"), "fragment", F.col("grams").alias("ga"))
    other = segments.select(F.col("s1").alias("b"), "fragment", F.col("grams").alias("gb"))
    met = each.join(mine, ["a", "fragment"]).join(other, ["b", "fragment"])
    partial = met.select("a", "b", "size_a", "size_b", "fragment", F.size(F.array_intersect("ga", "gb")).cast("long").alias("n")).repartition("a", "b")
    once = partial.groupBy("a", "b", "size_a", "size_b", "fragment").agg(F.max("n").alias("n"))  # a row of docs may repeat
    total = once.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return settle(total.where((num + den) * F.col("n") >= num * (F.col("size_a") + F.col("size_b"))).select("a", "b"), path)


def _add_pairs(total: np.ndarray, at: np.ndarray, row: np.ndarray, column: np.ndarray, is_left: np.ndarray, is_right: np.ndarray, rights: np.ndarray, some: np.ndarray) -> None:
    """Adds one to ``total`` for each pair of sets that hold one of ``some`` n-grams, a bounded number of pairs at a time.
    ``at`` are the n-grams, ascending, ``rights`` how many sets of the right side hold each."""
    gram, own = at[m := is_left & some[at]], row[m]
    other, start = column[is_right], np.cumsum(rights) - rights
    end, flat = np.cumsum(rights[gram]), total.reshape(-1)
    a = 0
    while a < len(gram):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PAIRS, "right")))
        n = rights[gram[a:b]]
        met = np.repeat(start[gram[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        np.add.at(flat, np.repeat(own[a:b], n) * total.shape[1] + other[met], np.float32(1))
        a = b


def _count_links(num: int, den: int):
    """Rows that each set of a tile is linked to in the tile's other chunk (or its own), by overlaps summed over
    fragments."""

    def run(t: pa.Table) -> pa.Table:
        own = t.column("i")[0] == t.column("j")[0]
        sets, row = np.unique(t.column("s1").to_numpy(), return_inverse=True)
        first = np.unique(row, return_index=True)[1]
        size, copies, side = (t.column(c).to_numpy()[first] for c in ("size", "copies", "side"))
        left = np.arange(len(sets)) if own else np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        place = np.full(len(sets), -1, np.int64)
        place[right] = np.arange(len(right))
        from_left = np.full(len(sets), -1, np.int64)
        from_left[left] = np.arange(len(left))
        total = np.zeros((len(left), len(right)), np.float32)
        fragment = t.column("fragment").to_numpy()
        for f in np.unique(fragment):
            part = t.filter(pa.array(fragment == f))
            lists = part.column("grams").combine_chunks()
            grams = lists.flatten().to_numpy()
            holder = np.repeat(row[fragment == f], np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((holder, grams))
            grams, holder = grams[order], holder[order]
            new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (holder[1:] != holder[:-1])))  # a row of docs may repeat
            grams, holder = grams[new], holder[new]
            at = np.cumsum(np.concatenate(([0], grams[1:] != grams[:-1])))
            is_left, is_right = from_left[holder] >= 0, place[holder] >= 0
            kinds = int(at[-1]) + 1
            lefts, rights = np.bincount(at[is_left], minlength=kinds), np.bincount(at[is_right], minlength=kinds)
            both = lefts * rights
            _add_pairs(total, at, from_left[holder], place[holder], is_left, is_right, rights, (both > 0) & (both * DENSE <= total.size))
            often = both * DENSE > total.size
            at, holder, is_left, is_right = ((np.cumsum(often) - 1)[at[often[at]]], *(x[often[at]] for x in (holder, is_left, is_right)))
            for k in range(0, int(often.sum()), 4096):
                now = (at >= k) & (at < k + 4096)
                x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
                x[from_left[holder[now & is_left]], at[now & is_left] - k] = 1
                y[place[holder[now & is_right]], at[now & is_right] - k] = 1
                total += x @ y.T
        hit = (num + den) * total.astype(np.int64) >= num * (size[left][:, None] + size[right][None, :])
        if own:
            np.fill_diagonal(hit, False)
            return pa.table({"s1": pa.array(sets[left]), "others": pa.array(hit @ copies[right], pa.int64())})
        return pa.table({"s1": pa.array(np.concatenate((sets[left], sets[right]))), "others": pa.array(np.concatenate((hit @ copies[right], copies[left] @ hit)), pa.int64())})

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5, chunk_ngrams: int = CHUNK_NGRAMS, count_links: bool = False, text_key: bool = False) -> DataFrame:
    """Classes of documents linked by n-gram Jaccard similarity >= num/den: ``(id, n_shingles, component_id)``.

    With ``count_links`` also ``n_links``, the rows that a row is similar to, copies included; every pair of different
    sets of a component is then counted, in tiles of bounded size. With ``text_key`` also ``text_key``, the xxhash64 of
    the text, which tells rows that share an id apart.

    One row per input row. A text of fewer than n words is one shingle; null texts and texts with no words have
    ``n_shingles`` 0 and link with nothing. A row whose id is null links with nothing; it has the component of rows
    with the same set, or null. Rows that repeat an id and a text count as copies; rows that share an id and have unlike
    texts are documents of their own, whose component has the least id that it holds. Texts of any length are read
    whole. An empty table gives no rows. Extra columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    root = work_dir(spark)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    # the driver hands back its memory after each step: what its share of thousands of tasks leaves adds up otherwise
    found = settle(base.mapInArrow(tidy(_profile(n)), "id long, key long, size long, s1 long, s2 long, slice int, counts binary"), f"{root}/profile")
    counts = np.zeros(BUCKETS, np.int64)
    slices = found.where("slice is not null").select("slice", "counts")
    for r in slices.repartition(F.col("slice")).mapInArrow(_sum_slices, "slice int, counts binary").toLocalIterator():
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(r["counts"], np.uint32)
    rank = np.minimum(127, 4 * np.log2(counts + 1)).astype(np.uint8)
    ranks, bounds = spark.sparkContext.broadcast(rank), fragment_bounds(counts, rank, FRAGMENTS)
    release_driver(spark)

    sized = found.where("slice is null").select("id", "key", "size", "s1", "s2")
    classes = sized.where("size > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min("size").alias("size"), F.count("*").alias("copies"))
    # n-grams that prefixes share go to the end of the order, so that prefixes meet by them only where nothing rarer is
    # left, as in near copies
    some, schema = base.where("id is not null"), "gram long, s1 long, size long, far long"
    first = some.mapInArrow(tidy(_prefixes(n, num, den, ranks)), schema).groupBy("gram").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"))
    demoted = spark.sparkContext.broadcast(bloom_of(first.where("lo <> hi").select(F.col("gram").alias("key"))))
    grams = settle(some.mapInArrow(tidy(_prefixes(n, num, den, ranks, demoted)), schema), f"{root}/prefixes")
    release_driver(spark)
    shared = grams.groupBy("gram").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.max("far").alias("most"), F.min("size").alias("least"))
    shared = settle(shared.where("lo <> hi and most >= least").select("gram", "most", "least"), f"{root}/shared")
    asked = spark.sparkContext.broadcast(bloom_of(shared.select(F.col("gram").alias("key"))))
    live = grams.mapInArrow(tidy(_only(asked, "gram")), schema).join(shared, "gram")
    live = settle(live.where("far >= least and size <= most").select("gram", "s1", "size", "far").distinct(), f"{root}/live")
    release_driver(spark)

    reps = classes.select("s1", "rep").join(live.select("s1").distinct(), "s1", "left_semi")
    wanted = spark.sparkContext.broadcast(bloom_of(reps.select(F.col("rep").alias("key"))))
    segments = settle(some.mapInArrow(tidy(_segments(n, ranks, demoted, bounds, wanted)), "s1 long, fragment int, grams array<long>"), f"{root}/segments")
    for held in (demoted, asked, wanted):
        held.unpersist()
    release_driver(spark)
    may = lambda x, y: (F.col(f"{x}far") >= F.col(f"{y}size")) & (F.col(f"{y}far") >= F.col(f"{x}size")) & (den * F.least(f"{x}size", f"{y}size") >= num * F.greatest(f"{x}size", f"{y}size"))
    # first round: each set and its hub
    hub = live.groupBy("gram").agg(F.max(F.struct((F.col("far") / F.col("size")).alias("far_share"), "s1", "size", "far")).alias("h")).select("gram", F.col("h.s1").alias("h1"), F.col("h.size").alias("hsize"), F.col("h.far").alias("hfar"))
    met = live.join(hub, "gram").where((F.col("s1") != F.col("h1")) & may("", "h")).groupBy("s1", "size", "h1", "hsize").count()
    best = met.groupBy("s1", "size").agg(F.max(F.struct("count", "h1", "hsize")).alias("b"))
    links = _links(best.select(F.col("s1").alias("a"), F.col("b.h1").alias("b"), F.col("size").alias("size_a"), F.col("b.hsize").alias("size_b")), segments, num, den, f"{root}/links1")
    release_driver(spark)
    joined = settle(connected_components(links, f"{root}/cc1"), f"{root}/joined1")
    # second round: pairs across components, in postings that hold several
    placed = live.join(joined.withColumnRenamed("node", "s1"), "s1", "left").withColumn("component", F.coalesce("component", "s1"))
    in_gram = placed.groupBy("gram", "component").count().groupBy("gram").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("k")).where("k > 1")
    placed = settle(placed.join(in_gram.select("gram", F.col("m.component").alias("major")), "gram"), f"{root}/placed")
    release_driver(spark)
    classed = segments.where("fragment = -1").select("s1", F.col("grams").alias("per_class")).dropDuplicates(["s1"])
    placed = placed.join(classed, "s1")
    minor = placed.where("component <> major").select("gram", *[F.col(c).alias(f"x{c}") for c in ("s1", "size", "far", "component", "per_class")])
    most = F.aggregate(F.zip_with("per_class", "xper_class", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)  # n-grams in common
    enough = (num + den) * most >= num * (F.col("size") + F.col("xsize"))
    met = placed.join(minor, (placed["gram"] == minor["gram"]) & (F.col("component") != F.col("xcomponent")) & may("", "x") & enough)
    lower = F.col("s1") < F.col("xs1")
    pairs = met.select(F.least("s1", "xs1").alias("a"), F.greatest("s1", "xs1").alias("b"), F.when(lower, F.col("size")).otherwise(F.col("xsize")).alias("size_a"), F.when(lower, F.col("xsize")).otherwise(F.col("size")).alias("size_b")).distinct()
    links = _links(settle(pairs, f"{root}/pairs2"), segments, num, den, f"{root}/links2")
    release_driver(spark)
    if not links.isEmpty():
        end = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        over = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        over = settle(connected_components(over, f"{root}/cc2"), f"{root}/joined2")
        top = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
        lone = over.join(joined, over["node"] == joined["node"], "left_anti").select("node", "component")
        joined = settle(joined.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")).union(lone).distinct(), f"{root}/joined")

    member = classes.join(joined.withColumnRenamed("node", "s1"), "s1")
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    least = classes.join(member.join(least, "component").select("s1", "s2", "component_id"), ["s1", "s2"], "left").select("s1", "s2", "copies", F.coalesce("component_id", "rep").alias("component"))
    columns = ["id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")]
    if count_links:
        linked = _degrees(member, segments, num, den, chunk_ngrams)
        least = least.join(linked, "s1", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
        columns.append(F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    return sized.join(least, ["s1", "s2"], "left").select(*columns, *[F.col("key").alias("text_key")] * text_key)


def _degrees(member: DataFrame, segments: DataFrame, num: int, den: int, chunk_ngrams: int) -> DataFrame:
    """``(s1, others)``: the rows of other sets that each set is linked to. A component's sets are dealt to chunks of
    about ``chunk_ngrams`` n-grams or ``CHUNK_SETS`` sets, whichever comes first, and every pair of chunks is a tile."""
    k = F.greatest(F.ceil(F.sum("size") / chunk_ngrams), F.ceil(F.count("*") / CHUNK_SETS))
    chunks = member.groupBy("component").agg(k.cast("int").alias("k"))
    tile = lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j"), F.when(F.col("c") <= j, 0).otherwise(1).alias("side"))
    tiles = member.join(chunks, "component").withColumn("c", F.pmod(F.xxhash64("s1"), F.col("k")).cast("int"))
    tiles = tiles.select("s1", "size", "copies", "component", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), tile)).alias("t")).select("s1", "size", "copies", "component", "t.*")
    cells = tiles.join(segments.where("fragment >= 0"), "s1").repartition("component", "i", "j")
    return cells.groupBy("component", "i", "j").applyInArrow(_count_links(num, den), "s1 long, others long").groupBy("s1").agg(F.sum("others").alias("others"))
