"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree (domain, language, source by default). A total budget of tokens is split from the root down: each
node's budget goes to its children by weight, a child takes no more than its subtree can give (``max_epochs`` times its
tokens), and what it leaves goes to its siblings by weight. Only what a whole subtree can't take rises to its parent's
siblings, because the parent was capped by the same rule one level up. The split has a closed form, a
running-sum window over the children of each node.

Each leaf then takes the prefix of its tokens over seeded epochs: documents in an order by hash of (seed, epoch, id),
epoch after epoch, until the budget is spent; the last document is cut to what is left. The order is cut into hash
bands: sums of bands tell where the budget runs out, so a leaf with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import settle, work_dir

MAX_EPOCHS, SEED = 4, 17
#: Hexadecimal digits of a hash band. A leaf's order is summed band by band; only the band in which its budget runs out
#: is sorted, a 4096th of the leaf.
BAND_DIGITS = 3


def waterfill(nodes: DataFrame, parent: list, budget: str, weight: str, capacity: str, tie: list[str], name: str) -> DataFrame:
    """Add ``name``: each child's part of its parent's ``budget`` by weight, capped, shortages going to siblings.

    With children in order of capacity a unit of weight, the level of child i is what is left, were those before it
    full, over the weights from i on. Levels rise while children are full and fall after, so the greatest is the level
    at which the budget is spent.
    """
    by = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), *tie)
    left = F.col(budget) - F.coalesce(F.sum(capacity).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum(weight).over(by.rowsBetween(0, Window.unboundedFollowing))
    out = nodes.withColumn("_level", level).withColumn("_level", F.max("_level").over(Window.partitionBy(*parent)))
    return out.withColumn(name, F.least(F.col(capacity), F.greatest(F.col("_level") * F.col(weight), F.lit(0.0)))).drop("_level")


def _same(names: list[str], prefix: str) -> Column:
    """Null-safe equality of each column with its prefixed twin."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return out


def plan_budgets(leaves: DataFrame, weights: dict[str, Column], total: float, max_epochs: int = MAX_EPOCHS, root: str | None = None) -> DataFrame:
    """``leaves(*levels, tokens)`` plus ``budget`` (whole tokens).

    With ``root``, each level's rows are written there, which keeps the plan of the next level as short as the first's.

    ``weights`` has each level, root first, and the weight of a node there among its siblings, an expression over the
    node's path and ``tokens`` (the sum below it). Nodes whose weight is null or not above 0, or that hold no tokens,
    get nothing. Null level values are nodes of their own. All windows are over leaves, not documents.
    """
    levels = list(weights)
    kept = (lambda df, name: settle(df, f"{root}/{name}")) if root else (lambda df, name: df)
    now = kept(leaves.withColumn("_ok", F.col("tokens") > 0), "leaves")
    for k in range(len(levels), 0, -1):  # a node of no weight gives its subtree's capacity to nobody
        path = levels[:k]
        node = now.where("_ok").groupBy(*path).agg(F.sum("tokens").alias("tokens")).withColumn("_v", weights[levels[k - 1]].cast("double"))
        node = node.where(F.col("_v") > 0).select(*[F.col(c).alias(f"_k{c}") for c in path], F.col("_v").alias(f"_v{k}"))
        now = now.join(node, _same(path, "_k"), "left").drop(*[f"_k{c}" for c in path]).withColumn("_ok", F.col("_ok") & F.col(f"_v{k}").isNotNull())
        now = kept(now, f"weight{k}")
    now = now.withColumn("_cap", F.when(F.col("_ok"), F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    now = kept(now, "capacity")
    now = now.withColumn("_b", F.lit(min(float(total), now.agg(F.sum("_cap")).first()[0] or 0.0)))
    for k in range(1, len(levels) + 1):
        path, up = levels[:k], levels[: k - 1]
        kids = now.where("_cap > 0").groupBy(*path).agg(F.sum("_cap").alias("_c"), F.max(f"_v{k}").alias("_v"), F.first("_b").alias("_p"))
        kids = waterfill(kids, up or [F.lit(1)], "_p", "_v", "_c", path, "_n")
        kids = kids.select(*[F.col(c).alias(f"_k{c}") for c in path], "_n")
        now = now.drop("_b").join(kids, _same(path, "_k"), "left").withColumn("_b", F.coalesce("_n", F.lit(0.0))).drop("_n", *[f"_k{c}" for c in path])
        now = kept(now, f"budget{k}")
    return now.withColumn("budget", F.floor(F.round("_b", 6)).cast("long")).select(*leaves.columns, "budget")


def order_key(seed: int, epoch: Column, doc: Column) -> Column:
    """The seeded order of an epoch, as hexadecimal text that any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], tokens: Column, total: float | None = None, id_col: str = "doc_id", max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once an epoch, with the levels, ``epoch`` (from 0), ``tokens`` and
    ``taken`` (tokens used; fewer than ``tokens`` only for the last row of a leaf).

    ``weights`` are as in :func:`plan_budgets`; ``total`` defaults to the tokens of all rows. Rows with no tokens are
    never taken (they add nothing); null ids and repeated rows are documents like others, in the order of a hash of the
    id and then of ``tokens``. An empty table gives no rows. Columns of ``docs`` named like an added one are replaced.
    """
    root = work_dir(docs.sparkSession)
    names = list(levels)
    added = [*names, "epoch", "tokens", "taken"]
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(*kept, *[e.alias(n) for n, e in levels.items()], F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")).where("tokens > 0")
    narrow = settle(rows.select(*names, F.col(id_col).alias("_id"), "tokens"), f"{root}/narrow")
    leaves = settle(narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")), f"{root}/sums")
    plan = plan_budgets(leaves, weights, (leaves.agg(F.sum("tokens")).first()[0] or 0) if total is None else total, max_epochs, root)
    plan = plan.where("budget > 0").select(*[F.col(n).alias(f"_{n}") for n in names], "budget", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"))
    plan = settle(plan, f"{root}/plan")  # a row a leaf, of known size: joined as Spark sees fit
    # the epoch that is cut: the band of its order in which the rest runs out, and what is left for that band
    last = narrow.join(plan.where("rest > 0"), _same(names, "_")).withColumn("_band", _band(order_key(seed, F.col("whole"), F.col("_id"))))
    keys = [f"_{n}" for n in names]
    bands = last.groupBy(*keys, "rest", "_band").agg(F.sum("tokens").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_band")) - F.col("_n")
    cut = bands.withColumn("_below", below).where((F.col("_below") < F.col("rest")) & (F.col("_below") + F.col("_n") >= F.col("rest")))
    cut = cut.select(*[F.col(k).alias(f"c{k}") for k in keys], F.col("_band").alias("cut"), (F.col("rest") - F.col("_below")).alias("left"))
    plan = settle(plan.join(cut, _same(keys, "c"), "left").drop(*[f"c{k}" for k in keys]), f"{root}/cut")

    taken = rows.join(plan, _same(names, "_"))
    taken = taken.withColumn("_lastkey", order_key(seed, F.col("whole"), F.col(id_col)))
    sure = F.col("whole") + F.when(_band(F.col("_lastkey")) < F.col("cut"), 1).otherwise(0)
    full = taken.where(sure > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), sure - 1))).withColumn("taken", F.col("tokens"))
    edge = taken.where(_band(F.col("_lastkey")) == F.col("cut")).withColumn("epoch", F.col("whole"))
    w = Window.partitionBy(*keys).orderBy("_lastkey", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("taken", F.least(F.col("tokens"), F.col("left") - F.coalesce(F.sum("tokens").over(w), F.lit(0)))).where("taken > 0")
    return full.select(*kept, *added).union(edge.select(*kept, *added))


def _band(key: Column) -> Column:
    return F.substring(key, 1, BAND_DIGITS)
