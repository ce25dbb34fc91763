import numpy as np
from pyspark.sql import functions as F

from quillmill.llm.ann import RERANK, build_index, nearest, search
from quillmill.llm.embedding_dedup import borders, embedding_near_dedup

ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [], 1)]


def brute_components(rows, threshold):
    ids = [r[0] for r in rows]
    ok = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    comp, links = {i: i for i in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for n, a in enumerate(ok):
        for b in ok[:n]:
            if rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                comp[p if ids[p] > ids[q] else q] = q if ids[p] > ids[q] else p
    return sorted((ids[i], links[i], ids[find(i)], find(i) == i) for i in range(len(rows)))


def clustered(rng, n, groups):
    base = rng.standard_normal((n, 16))
    rows = [(i, base[i].tolist(), int(i % 3)) for i in range(n)]
    for g, size in enumerate(groups):
        c = rng.standard_normal(16)
        rows += [(1000 + g * 1000 + i, (c + rng.standard_normal(16) * 0.03).tolist(), g % 3) for i in range(size)]
    return rows


def test_near_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 300, [2, 3, 260, 5, 2])
    rows += [(5000 + i, rows[7][1], rows[7][2]) for i in range(40)] + [(6000, rows[7][1], None), (6001, rows[7][1][:8], rows[7][2])] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit("x")).repartition(3)
    assert sorted(map(tuple, embedding_near_dedup(df, chunk=64).collect())) == brute_components(rows, 0.98)
    assert embedding_near_dedup(df.limit(0)).count() == 0


def test_every_window_across_parts_is_compared():
    rng = np.random.default_rng(6)
    for window in (1, 4, 9):
        sizes = {p: int(n) for p, n in enumerate(rng.integers(0, 12, 14)) if n}
        rows = [(p, i) for p, n in sizes.items() for i in range(n)]
        want = {(a, b) for i, a in enumerate(rows) for b in rows[i + 1 : i + 1 + window] if a[0] != b[0]}
        got = set()
        groups = {}
        for part, side, border, turn in borders({p: min(n, window) for p, n in sizes.items()}, window):
            n = sizes[part]
            mine = [(part, i) for i in (range(max(0, n - window), n) if side == 0 else range(min(n, window)))]
            groups.setdefault(border, []).append((turn, side, mine))
        for g in groups.values():
            seq = [(side, r) for _, side, mine in sorted(g) for r in mine]
            got |= {(a, b) for i, (x, a) in enumerate(seq) for y, b in seq[i + 1 : i + 1 + window] if x == 0 and y == 1}
        assert got == want


def test_near_dedup_links_across_many_small_parts(spark):
    rng = np.random.default_rng(9)
    rows = clustered(rng, 60, [3] * 60)
    rows += [(9000, rows[0][1], 0), (9000, (np.array(rows[1][1]) * 3).tolist(), 1)]  # an id with unlike vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(map(tuple, embedding_near_dedup(df, window=3, passes=24).collect()))
    assert got == brute_components(rows, 0.98)


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 16))
    rows = [(i, (centers[i % 40] + rng.standard_normal(16) * 0.4).tolist(), 1) for i in range(4000)]
    rows += [(10_000 + i, rows[100][1], 1) for i in range(50)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {}
    for r in nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ok = [r for r in rows if r[0] < 9000 or r[0] >= 10_000]
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok])
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for q, mine in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        top = np.lexsort((ids, d))[:10]
        assert sorted(mine) == list(range(1, 11))
        hits += len({v for v, _ in mine.values()} & set(ids[top].tolist()))
        total += 10
        assert all(abs(s - d[ids == v][0]) < 1e-12 for v, s in mine.values())
    assert hits >= 0.9 * total
    assert [got[100][k][0] for k in range(1, 11)] == [10_000 + k for k in range(10)]


def test_ann_reranks_a_twentieth_and_still_recalls(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    index, pivots = build_index(df, f"{tmp_path}/index")
    files = index.where("kind = 0")
    assert RERANK <= 0.05 and files.count() == 512 * index.select("block").distinct().count()
    hits = 0
    got = search(index, pivots, F.col("id") % 100 == 0).collect()
    for r in got:
        d = np.sqrt(((x - x[r.query_id]) ** 2).sum(1))
        d[r.query_id] = np.inf
        hits += r.vec_id in set(np.lexsort((np.arange(len(x)), d))[:10].tolist())
    assert len(got) == 600 and hits >= 0.9 * 600


def test_ann_indexes_every_dimension_and_asks_by_the_least_of_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (7, [2.0, 0.0]), (200, [0.0, 1.0, 0.0]), (200, [5.0, 1.0, 0.0]), (8, [0.0, 3.0, 0.0]), (300, [1.0] * 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, query_id string")
    got = sorted(map(tuple, nearest(df, F.col("id") % 100 == 0, query_block=1).collect()))
    assert got == [(100, 1, 7, 1.0), (200, 1, 8, 2.0)]


def test_ann_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert nearest(df, F.col("id") % 100 == 0).count() == 4
    assert nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0
