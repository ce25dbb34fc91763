"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are one class. Each pass hashes every class by random hyperplanes, concatenates the bits, and
sorts classes by (label, bits); near vectors tend to share leading bits, so each is compared with the ``window`` before
it. Verified pairs of all passes are united, and a pass sends only links that join two of its own components.

A vector's links all lie in its component, so link counts are then exact: each component's vectors are compared with
one another in tiles of bounded size, of which any number makes up a large component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import connected_components, settle, work_dir
from quillmill.llm.vectors import matrix, usable

PASSES, WINDOW, BITS, SEED = 12, 96, 62, 29
THRESHOLD = 0.98
#: Vectors of a component in one chunk; a tile compares two chunks.
CHUNK = 512
_ROW = "label long, pass int, bits long, id long, v array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that neither large nor tiny components overflow or vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hash(passes: int):
    """Each class once a pass, with its concatenated hyperplane bits."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            size = np.diff(b.column("v").offsets.to_numpy()) if b.num_rows else np.zeros(0)
            for dim in np.unique(size).tolist():  # vectors of another dimension never meet: the label is joined by it
                at = np.flatnonzero(size == dim)
                rows = b.take(pa.array(at))
                x = matrix(rows.column("v"), dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED).standard_normal((dim, passes * BITS))
                up = (unit(x) @ planes[dim]) > 0
                for p in range(passes):
                    bits = up[:, p * BITS : (p + 1) * BITS] @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(np.full(len(at), p, np.int32)), pa.array(bits), rows.column("id"), rows.column("v")], names=["label", "pass", "bits", "id", "v"])

    return run


class Joined:
    """Union-find over ids: which links still join two components."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x], x = root, y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _pairs(t: pa.Table, new: int, window: int, threshold: float):
    """Index pairs (i, j): rows from ``new`` on with the up to ``window`` rows before that share pass and label."""
    label, step = t.column("label").to_numpy(), t.column("pass").to_numpy()
    size = np.diff(t.column("v").combine_chunks().offsets.to_numpy())
    for a in range(new, t.num_rows, 512):
        z = min(a + 512, t.num_rows)
        lo = max(0, a - window)
        if (size[lo:z] != size[lo]).any():
            spans = [np.flatnonzero(size[lo:z] == d) + lo for d in np.unique(size[lo:z])]
        else:
            spans = [np.arange(lo, z)]
        for s in spans:
            x = unit(matrix(t.column("v").take(pa.array(s)), int(size[s[0]])))
            rows = np.flatnonzero(s >= a)
            if not len(rows):
                continue
            sim = x[rows] @ x.T
            i, j = np.nonzero(sim >= threshold)
            i, j = s[rows[i]], s[j]
            ok = (j < i) & (i - j <= window) & (label[i] == label[j]) & (step[i] == step[j])
            yield from zip(i[ok].tolist(), j[ok].tolist(), strict=True)


def _scan(window: int, threshold: float):
    """Links of each sorted part, and its first (side 1) and last rows (side 0), which its neighbours haven't seen."""

    def run(batches):
        from pyspark import TaskContext

        part, joined, held, head, first = TaskContext.get().partitionId(), {}, None, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if head < window:
                first.append(t.slice(0, window - head))
                head += min(t.num_rows, window - head)
            old = 0 if held is None else held.num_rows
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            ids, step = t.column("id").to_pylist(), t.column("pass").to_pylist()
            links = [(ids[i], ids[j]) for i, j in _pairs(t, old, window, threshold) if joined.setdefault(step[i], Joined()).join(ids[i], ids[j])]
            if links:
                yield edges(links)
            held = t.slice(max(0, t.num_rows - window))
        if held is not None:
            yield from border(pa.concat_tables(first), part, 1)
            yield from border(held, part, 0)

    return run


_EDGE = "a long, b long, border int, side int, pos int, label long, pass int, id long, v array<double>"
_NAMES = ["a", "b", "border", "side", "pos", "label", "pass", "id", "v"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())]


def edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    n = len(links)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64()), *[pa.nulls(n, k) for k in _KINDS[2:]]], names=_NAMES)


def border(t: pa.Table, key: int, side: int):
    n = t.num_rows
    same = lambda v: pa.array(np.full(n, v, np.int32))
    full = pa.table([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), same(key), same(side), pa.array(np.arange(n, dtype=np.int32)), *[t.column(c).cast(k) for c, k in zip(("label", "pass", "id", "v"), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)]], names=_NAMES)
    yield from full.combine_chunks().to_batches()


def borders(heads: dict[int, int], window: int) -> list[tuple[int, int, int, int]]:
    """(part, side, border, turn): the last rows of every part that has rows meet the first rows of the parts after it,
    of as many as it takes to have ``window`` rows; ``heads`` has min(rows, window) of each part."""
    parts, out = sorted(heads), []
    for k, p in enumerate(parts):
        out.append((p, 0, p, 0))
        have = 0
        for turn, q in enumerate(parts[k + 1 :], 1):
            if have >= window:
                break
            out.append((q, 1, p, turn))
            have += heads[q]
    return out


def _across(window: int, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("turn", "ascending"), ("pos", "ascending")]).combine_chunks()
        new = int((t.column("side").to_numpy() == 0).sum())
        ids, joined = t.column("id").to_pylist(), Joined()
        links = [(ids[i], ids[j]) for i, j in _pairs(t, new, window, threshold) if j < new and joined.join(ids[i], ids[j])]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _count(threshold: float):
    """Links of each vector of a tile with the tile's other chunk, copies counted."""

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
        x = unit(matrix(t.column("v")))
        if (side == 0).all():
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            got = hit @ n
        else:
            l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            hit = x[l] @ x[r].T >= threshold
            got = np.zeros(len(ids), np.int64)
            got[l], got[r] = hit @ n[r], n[l] @ hit
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(got, pa.int64())})

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per input row.

    Only vectors of equal, non-null labels and equal dimension are compared, by cosine in double precision. A row whose
    vector is null, empty, zero or has null or non-finite components, or whose label or id is null, links with nothing
    and is its own component. Rows that repeat an id are vectors of their own that share it. An empty table gives no
    rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    root = work_dir(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # classes of equal vectors are told apart by 128 bits of hash; the first 64 name them among links
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64("v", F.lit(3))))
    classes = rows.where("ok").groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = settle(classes.withColumnRenamed("k1", "id"), f"{root}/classes")
    count = classes.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count * passes // (16 * window)))
    hashed = classes.select("label", "id", "v").mapInArrow(_hash(passes), _ROW)
    order = ["pass", "label", "bits", "id"]
    scanned = settle(hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_scan(window, threshold), _EDGE), f"{root}/scan")
    edge = scanned.where("border is not null").withColumnRenamed("border", "part")
    heads = {r["part"]: r["count"] for r in edge.where("side = 1").groupBy("part").count().collect()}  # a row a part
    met = spark.createDataFrame(borders(heads, window), "part int, side int, border int, turn int")
    across = edge.join(met, ["part", "side"]).groupBy("border").applyInArrow(_across(window, threshold), "a long, b long")
    found = settle(connected_components(scanned.where("a is not null").select("a", "b").union(across), f"{root}/cc"), f"{root}/joined")

    members = found.join(classes, found["node"] == classes["id"]).select("id", "component", "n", "v")
    size = members.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("k"))
    c = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    tile = lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j"), F.when(F.col("c") <= j, 0).otherwise(1).alias("side"))
    tiles = members.join(size, "component").withColumn("c", c).select("id", "component", "n", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), tile)).alias("t")).select("id", "component", "n", "v", "t.*")
    tiles = tiles.repartition("component", "i", "j")  # a component's tiles go to many tasks
    counted = tiles.groupBy("component", "i", "j").applyInArrow(_count(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    placed = classes.select("label", "id", "k2", "rep", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    first = placed.where("component is not null").groupBy("component").agg(F.min("rep").alias("component_id"))
    least = placed.join(first, "component", "left").join(counted, "id", "left")
    least = least.select("label", F.col("id").alias("k1"), "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.drop("v").join(least, ["label", "k1", "k2"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
