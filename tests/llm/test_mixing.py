import hashlib
import random

from pyspark.sql import functions as F

from quillmill.llm.mixing import mix_sources, plan_budgets


def fill(budget, kids):
    """kids: (capacity, weight); repeated passes until no child is over its capacity."""
    out, open_ = [0.0] * len(kids), [i for i, (c, w) in enumerate(kids) if c > 0 and w > 0]
    budget = min(budget, sum(kids[i][0] for i in open_))
    while open_ and budget > 1e-9:
        weight = sum(kids[i][1] for i in open_)
        over = [i for i in open_ if budget * kids[i][1] / weight >= kids[i][0] - 1e-9]
        if not over:
            for i in open_:
                out[i] = budget * kids[i][1] / weight
            break
        for i in over:
            out[i] = kids[i][0]
            open_.remove(i)
            budget -= kids[i][0]
    return out


def tree(leaves, total, epochs, weight, depth=0):
    live = [x for x in leaves if x[-1] > 0]
    groups = sorted({x[depth] for x in live}, key=str)
    parts = [[x for x in live if x[depth] == g] for g in groups]
    w = [weight[depth](g, sum(x[-1] for x in p)) for g, p in zip(groups, parts, strict=True)]
    got = fill(total, [(sum(x[-1] * epochs for x in p), v) for p, v in zip(parts, w, strict=True)])
    out = {}
    for p, b in zip(parts, got, strict=True):
        out |= {p[0]: b} if depth == len(weight) - 1 else tree(p, b, epochs, weight, depth + 1)
    return out


def test_budgets_follow_the_tree(spark):
    rng = random.Random(4)
    for total in (500, 20_000, 200_000, 10**9):
        leaves = [(f"d{d}", f"l{x}", None if s == 2 else f"s{s}", rng.randint(1, 1000) * rng.choice([0, 1, 50])) for d in range(3) for x in range(3) for s in range(3)]
        df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
        weights = {"domain": F.when(F.col("domain") == "d0", 5.0).otherwise(1.0), "lang": F.lit(1.0), "source": F.sqrt("tokens")}
        got = {tuple(r)[:4]: r.budget for r in plan_budgets(df, weights, float(total), 3).collect()}
        want = tree(leaves, total, 3, [lambda g, n: 5.0 if g == "d0" else 1.0, lambda g, n: 1.0, lambda g, n: n**0.5])
        assert len(got) == len(leaves)
        for x in leaves:
            assert abs(got[x] - want.get(x, 0.0)) <= 1, (x, got[x], want.get(x))


def test_a_node_without_weight_gets_nothing(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 10), ("b", "x", 100)], "domain string, lang string, tokens long")
    got = plan_budgets(df, {"domain": F.lit(1.0), "lang": F.when(F.col("lang") == "x", 1.0).otherwise(0.0)}, 60.0, 2).collect()
    assert {(r.domain, r.lang): r.budget for r in got} == {("a", "x"): 20, ("a", "y"): 0, ("b", "x"): 40}


def test_prefixes_of_seeded_epochs(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) or None, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b"]), 1) for i in range(200)] + [(7, "x y", "en", "a", 2), (None, "x", "en", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    weights = {"lang": F.when(F.col("lang") == "en", 1.0).otherwise(3.0), "source": F.lit(1.0)}
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mix_sources(df, levels, weights, size, 6000.0, max_epochs=5).collect()
    leaf = {}
    for r in out:
        leaf.setdefault((r.lang, r.source), []).append(r)
    assert sum(r.taken for r in out) >= 6000 - len(leaf)
    for (lang, source), got in leaf.items():
        mine = [(i, len((t or "").split())) for i, t, x, s, _ in rows if (x, s) == (lang, source) and t]
        budget, at, want, epoch = sum(r.taken for r in got), 0, [], 0
        while at < budget:
            for i, n in sorted(mine, key=lambda m: (hashlib.md5(f"17:{epoch}:{'null' if m[0] is None else m[0]}".encode()).hexdigest(), m[1])):
                if at < budget:
                    want.append((epoch, str(i), n, min(n, budget - at)))
                at += n
            epoch += 1
        assert sorted((r.epoch, str(r.doc_id), r.tokens, r.taken) for r in got) == sorted(want)
    assert mix_sources(df.limit(0), levels, weights, size).count() == 0
