"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every window of 35 words has an anchor: the least hash among its short shingles, which depends on the window's words
alone. Windows in a row that share an anchor form a *segment* of words; a *reference block* is what the corpus holds under
some anchors, so the anchors of a document name every block that can hold one of its windows. A block is the words of its
segments, indexed by the order of their suffixes (prefix doubling, only of what still ties). Each segment is factored
greedily: the longest run of words that also starts elsewhere in the block, then on behind it. A factor of 35 words or
more is a duplicate span. A repeated window that lies in no factor straddles the end of one: those windows are looked up
in the index. So a window is found if and only if it starts elsewhere in its block.

What some documents of a batch repeat is factored there, with their own words as the block, and of equal windows the
first goes on, so a passage in a third of all documents sends a row a block of a batch, not a row a document. Anchors
whose shingle stands in one place only never leave their task (a Bloom filter of fixed size says so; when it fills up,
more rows travel and the result is the same).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import bloom_of, in_bloom, in_steps, settle, shingle_hashes, tidy, word_hashes, work_dir

WINDOW, ANCHOR = 35, 8
#: Words under an anchor beyond which its windows are dealt by their own hashes rather than by the anchor, and words of a
#: block (a reference block holds whole anchors, a batch's block whole texts).
HOT, BLOCK = 100_000, 1 << 18


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: its least shingle hash."""
    s = shingle_hashes(words, ANCHOR)
    span = window - ANCHOR + 1
    width = 1
    while width * 2 <= span:
        s = np.minimum(s[:-width], s[width:])
        width *= 2
    rest = span - width
    return np.minimum(s[: len(s) - rest], s[rest:]) if rest else s


def _texts(batch: pa.RecordBatch, window: int):
    """(row, word hashes) of each text that has a window."""
    texts = batch.column("text").to_pylist()
    for a, b in in_steps(texts):
        words, at = word_hashes(texts[a:b], False)
        for i in range(b - a):
            if at[i + 1] - at[i] >= window:
                yield a + i, words[at[i] : at[i + 1]]


def _anchor_counts(window: int):
    """(anchor, n): in how many places of this batch the anchor's shingle stands, 2 for more. A window that is repeated has
    its anchor's shingle in two places."""

    def run(batches):
        for batch in batches:
            keys, seen, found = list(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True)), {}, []
            for row, words in _texts(batch, window):
                seen[keys[row]] = seen.get(keys[row], 0) + 1
                if seen[keys[row]] > 2:
                    continue
                s = shingle_hashes(words, ANCHOR)
                found.append(s[np.isin(s, np.unique(anchors(words, window)))])
            if found:
                a, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["anchor", "n"])

    return run


def _ranges(at: np.ndarray) -> bytes:
    """Sorted window starts as (first, last + 1) pairs."""
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1
    return np.stack((first, last), 1).astype(np.int32).tobytes()


def index_block(words: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The index of a block: ranks of the pieces of 1, 2, 4, ... words at each place (cut at ``end``, where the place's
    segment ends), and the places in order of their suffixes. A rank is how many places come before; a place whose piece
    is the only one of its kind keeps its rank, and only the others are ranked by longer pieces."""
    n, width = len(words), 1
    longest = int((end - np.arange(n)).max())
    _, inv, count = np.unique(words, return_inverse=True, return_counts=True)
    ranks = [(np.cumsum(count) - count)[inv]]
    live = np.flatnonzero(count[inv] > 1)
    while len(live) and width < longest:
        r, ahead = ranks[-1], live + width
        after = np.where(ahead < end[live], r[np.minimum(ahead, n - 1)] + 1, 0)
        key, inv, count = np.unique(r[live] * (n + 2) + after, return_inverse=True, return_counts=True)
        old, before = key // (n + 2), np.cumsum(count) - count
        first = np.concatenate(([True], old[1:] != old[:-1]))
        new = r.copy()
        new[live] = (old + before - before[np.flatnonzero(first)][np.cumsum(first) - 1])[inv]
        ranks.append(new)
        live = live[count[inv] > 1]
        width *= 2
    return ranks, np.argsort(ranks[-1], kind="stable")


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the common piece that starts at places ``a`` and ``b``."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        ok = np.flatnonzero((x < end[a]) & (y < end[b]))
        hit = ok[ranks[k][x[ok]] == ranks[k][y[ok]]]
        out[hit] += np.minimum(1 << k, end[a[hit]] - x[hit])
    return out


class Block:
    """The words of some segments, ``seg`` numbering each word's segment, ascending, and their index: the places in suffix
    order, and what each shares with the next."""

    def __init__(self, words: np.ndarray, seg: np.ndarray):
        stop = np.flatnonzero(np.concatenate((np.diff(seg) != 0, [True]))) + 1
        size = np.diff(np.concatenate(([0], stop)))
        self.words, self.end, self.begin = words, np.repeat(stop, size), np.repeat(stop - size, size)
        ranks, self.order = index_block(words, self.end)
        self.shared = _common(ranks, self.order[:-1], self.order[1:], self.end)

    def firsts(self, window: int) -> np.ndarray:
        """Of the places whose windows are equal the first; a place with no equal is its own."""
        group = np.concatenate(([0], np.cumsum(self.shared < window)))
        least = np.minimum.reduceat(self.order, np.flatnonzero(np.concatenate(([True], self.shared < window))))
        out = np.empty(len(self.order), np.int64)
        out[self.order] = least[group]
        return out


def factorise(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy factors (place, words, source place) of a block's segments against the block itself, and for every place
    the length of the longest piece there that starts elsewhere too. A word that stands nowhere else is a literal."""
    n = len(block.words)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none, np.zeros(n, np.int64)
    before, after = np.concatenate(([0], block.shared)), np.concatenate((block.shared, [0]))
    longest, source = np.empty(n, np.int64), np.empty(n, np.int64)
    longest[block.order] = np.maximum(before, after)  # of all suffixes, a neighbour in order shares the most
    source[block.order] = np.where(before >= after, np.roll(block.order, 1), np.roll(block.order, -1))
    step = longest.tolist()
    place, at = [], 0
    while at < n:
        if step[at]:
            place.append(at)
            at += step[at]
        else:
            at += 1
    at = np.array(place, np.int64)
    return at, longest[at], source[at], longest


def repeated(block: Block, window: int) -> np.ndarray:
    """Where windows of a block begin that start elsewhere in it too, ascending: those in factors of ``window`` words or
    more, and of those that straddle a factor's end the ones that the index has twice. (A literal is in no such window.)"""
    place, size, _, longest = factorise(block)
    n = len(block.words)
    inside, near = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    long, ends = size >= window, place + size
    np.add.at(inside, place[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    out = np.cumsum(inside[:-1]) > 0
    np.add.at(near, np.maximum(ends - window + 1, 0), 1)
    np.add.at(near, ends, -1)
    straddles = np.flatnonzero((np.cumsum(near[:-1]) > 0) & ~out)
    out[straddles[longest[straddles] >= window]] = True
    return np.flatnonzero(out)


_SEGMENT = "anchor long, t1 long, t2 long, start int, words binary"


def _segments(window: int, bloom):
    """Rows with an anchor: segments to look up in their block. Rows without: ranges that this batch alone settles."""

    def parse(rows: list, t1, t2):
        """Factor the words under asked windows of some texts against each other."""
        row, at, words, anc = [], [], [], []
        for r, w, a, asked in rows:
            near = np.zeros(len(w) + 1, np.int64)
            near[asked] += 1
            np.add.at(near, asked + window, -1)
            own = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            row.append(np.full(len(own), r))
            at.append(own)
            words.append(w[own])
            full = np.zeros(len(w), np.uint64)
            full[asked] = a
            has = np.zeros(len(w), bool)
            has[asked] = True
            anc.append((full[own], has[own]))
        row, at, words = map(np.concatenate, (row, at, words))
        anc, has = (np.concatenate([x[i] for x in anc]) for i in (0, 1))
        block = Block(words, np.cumsum(np.concatenate(([0], (np.diff(row) != 0) | (np.diff(at) != 1)))))
        known = repeated(block, window)
        known = known[has[known]]
        first = block.firsts(window)
        send = np.flatnonzero(has & (first == np.arange(len(first))))
        out = ([], [], [], [], [])
        for i, kind in ((known, 0), (send, 1)):
            if not len(i):
                continue
            new = (np.diff(row[i]) != 0) if kind == 0 else (np.diff(row[i]) != 0) | (np.diff(at[i]) != 1) | (anc[i][1:] != anc[i][:-1])
            for g in np.split(i, np.flatnonzero(new) + 1):
                r = row[g[0]]
                out[0].append(int(anc[g[0]].view(np.int64)) if kind else None)
                out[1].append(t1[r])
                out[2].append(t2[r])
                out[3].append(int(at[g[0]]))
                out[4].append(words[g[0] : g[-1] + window].tobytes() if kind else _ranges(at[g]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "t1", "t2", "start", "words"])

    def run(batches):
        bits = bloom.value
        for batch in batches:
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            seen, held, size = {}, [], 0
            for row, words in _texts(batch, window):
                key = (t1[row], t2[row])
                seen[key] = seen.get(key, 0) + 1
                if seen[key] > 2:  # the second copy makes every window of both a repeat; further ones add nothing
                    continue
                anc = anchors(words, window)
                asked = np.flatnonzero(in_bloom(bits, anc))
                if not len(asked):
                    continue
                if held and size + len(words) > BLOCK:
                    yield parse(held, t1, t2)
                    held, size = [], 0
                held.append((row, words, anc[asked], asked))
                size += len(words)
            if held:
                yield parse(held, t1, t2)

    return run


def _look_up(window: int):
    """Factor the segments of each reference block: whole anchors (sorted), about ``BLOCK`` words. Gives back the ranges of
    windows that are repeated. Words are equal by all 64 bits of their hashes."""

    def parse(t: pa.Table):
        bits = t.column("words").to_pylist()
        lengths = np.array([len(x) // 8 for x in bits], np.int64)
        if len(lengths) < 2 and (not len(lengths) or lengths[0] <= window):
            return None
        words = np.frombuffer(b"".join(bits), np.uint64)
        seg = np.repeat(np.arange(len(lengths)), lengths)
        hit = repeated(Block(words, seg), window)
        if not len(hit):
            return None
        offset = np.arange(len(seg)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = t.column("start").to_numpy()[seg] + offset
        parts = np.split(hit, np.flatnonzero(np.diff(seg[hit])) + 1)
        take = np.array([seg[p[0]] for p in parts])
        return pa.RecordBatch.from_arrays([pa.array(t.column("t1").to_numpy()[take]), pa.array(t.column("t2").to_numpy()[take]), pa.array([_ranges(at[p]) for p in parts], pa.binary())], names=["t1", "t2", "ranges"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("words").nbytes // 8
            if size < BLOCK or not batch.num_rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            a, n = t.column("anchor").to_numpy(), np.cumsum(pc.binary_length(t.column("words")).to_numpy() // 8)
            at = 0
            while at < len(a):
                cut = int(np.searchsorted(n, (n[at - 1] if at else 0) + BLOCK)) + 1
                if cut >= len(a):
                    break
                while cut < len(a) and a[cut] == a[cut - 1]:
                    cut += 1
                if cut >= len(a):
                    break  # the last anchor may go on
                if (done := parse(t.slice(at, cut - at))) is not None:
                    yield done
                at = cut
            held = t.slice(at).combine_chunks().to_batches()
            size = int(n[-1] - (n[at - 1] if at else 0))
        if held and (done := parse(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield done

    return run


def _keep(window: int):
    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if ranges:
                    r = np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 2).astype(np.int64)
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, r[:, 0], 1)
                    np.add.at(depth, r[:, 1] + window - 1, -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def _dealt(found: DataFrame, hot: int, window: int, path: str) -> DataFrame:
    """The segments by anchor; those of an anchor with more than ``hot`` words as a row a window, with its hash for an
    anchor, so that equal windows still meet and no task holds the whole group."""
    asked = found.where("anchor is not null")
    many = settle(asked.groupBy("anchor").agg(F.sum(F.length("words")).alias("bytes")).where(F.col("bytes") > 8 * hot).select("anchor"), path)
    at = F.explode(F.sequence(F.lit(0), F.expr(f"int(length(words) / 8) - {window}"))).alias("at")
    split = asked.join(many, "anchor", "left_semi").select("t1", "t2", "start", "words", at)
    split = split.select("t1", "t2", (F.col("start") + F.col("at")).alias("start"), F.expr(f"substring(words, at * 8 + 1, {8 * window})").alias("words"))
    split = split.select(F.xxhash64("words").alias("anchor"), "t1", "t2", "start", "words")
    return asked.join(many, "anchor", "left_anti").select(split.columns).union(split)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``(id, n_words, n_removed, kept)``: each text without the words that lie in a window repeated anywhere.

    One row per input row; words are ``[^\\x20\\x09-\\x0D]+``, kept ones are joined by one space. A window counts as
    repeated if its words also start at another position of any row, the same one included, so rows that repeat a text
    repeat all its windows. Null and empty texts have no words; texts under ``window`` words lose nothing; ids may be
    null or repeated. A text of any length is parsed whole; an empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    root = work_dir(spark)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(7)).alias("t2"))
    some = base.where("text is not null").select("t1", "t2", "text")
    counts = some.mapInArrow(tidy(_anchor_counts(window), whole=True), "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))
    bloom = spark.sparkContext.broadcast(bloom_of(counts.where("n > 1").select(F.col("anchor").alias("key"))))
    found = settle(some.mapInArrow(tidy(_segments(window, bloom), whole=True), _SEGMENT), f"{root}/segments")
    asked = _dealt(found, hot, window, f"{root}/hot").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    spans = asked.mapInArrow(tidy(_look_up(window), whole=True), "t1 long, t2 long, ranges binary").union(found.where("anchor is null").select("t1", "t2", F.col("words").alias("ranges")))
    spans = spans.groupBy("t1", "t2").agg(F.collect_set("ranges").alias("ranges"))
    return base.join(spans, ["t1", "t2"], "left").select("id", "text", "ranges").mapInArrow(tidy(_keep(window)), "id long, n_words long, n_removed long, kept string")


def digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
