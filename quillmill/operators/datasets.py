"""Shaping of preference, reward, process and packed training rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import segment as S
from quillmill.sources.durable import settle, work_dir

IGNORE = -100
STD_FLOOR = 1e-4


def completion_mask(prompt: Column, whole: Column) -> Column:
    """V1: 0 for each prompt token, 1 for the rest."""
    n = F.least(F.size(prompt), F.size(whole))
    return F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(whole) - n))


def truncated(ids: Column, limit: int) -> Column:
    return F.slice(ids, 1, limit)


def keep_tail(ids: Column, limit: int) -> Column:
    """V3: the last ``limit`` tokens."""
    return F.when(F.size(ids) > limit, F.slice(ids, -limit, limit)).otherwise(ids)


def single_bos(ids: Column, bos: int) -> Column:
    """V1: one leading BOS where there are two."""
    return F.when((F.try_element_at(ids, F.lit(1)) == bos) & (F.try_element_at(ids, F.lit(2)) == bos), F.slice(ids, 2, F.size(ids))).otherwise(ids)


def with_eos(ids: Column, eos: int) -> Column:
    """V4: EOS at the end unless it is there."""
    return F.when(F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False)), ids).otherwise(F.array_append(ids, F.lit(eos)))


def preference_row(df: DataFrame, eos: int, max_prompt: int, max_completion: int, prompt: str = "prompt_ids", chosen: str = "chosen_ids", rejected: str = "rejected_ids") -> DataFrame:
    """Prompts keep their tail; completions get EOS and keep their head."""
    end = lambda c: truncated(F.array_append(F.col(c), F.lit(eos)), max_completion)
    return df.withColumn(prompt, keep_tail(F.col(prompt), max_prompt)).withColumn(chosen, end(chosen)).withColumn(rejected, end(rejected))


def reward_row(df: DataFrame, eos: int, limit: int, prompt: str = "prompt_ids", chosen: str = "chosen_ids", rejected: str = "rejected_ids") -> DataFrame:
    """V4: prompt and completion in one, with EOS; rows of which either is too long are out."""
    out = df
    for c in (chosen, rejected):
        out = out.withColumn(c, with_eos(F.concat(F.col(prompt), F.col(c)), eos))
    return out.where((F.size(chosen) <= limit) & (F.size(rejected) <= limit))


def unpaired(df: DataFrame, key: str = "id") -> DataFrame:
    """V5: a row a completion with its label."""
    both = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    return df.select(key, "prompt", F.explode(both).alias("x")).select(key, "prompt", "x.*")


def mispaired(df: DataFrame, batch: int, order: str = "ord") -> DataFrame:
    """V5: beside each completion, the one before it in its batch (the first gets the last): ``kl_completion``."""
    b = F.floor((F.col(order) - 1) / batch)
    w = Window.partitionBy("_b").orderBy(order)
    last = F.last("completion").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("_b", b).withColumn("kl_completion", F.coalesce(F.lag("completion").over(w), last)).drop("_b")


def balance(df: DataFrame, label: str = "label") -> DataFrame:
    """V6: desirable and undesirable counts, and the range of weights that keeps their ratio between 1 and 1.33."""
    n = df.agg(F.sum(F.col(label).cast("int")).alias("desirable"), F.sum((~F.col(label)).cast("int")).alias("undesirable"))
    d, u = F.greatest("desirable", F.lit(1)), F.greatest("undesirable", F.lit(1))
    return n.select("*", F.round(u / d, 2).alias("des_low"), F.round(u * 1.33 / d, 2).alias("des_high"), F.round(d / 1.33 / u, 2).alias("und_low"), F.round(d / u, 2).alias("und_high"))


def split_by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """V7."""
    return df.where(F.col(label)), df.where(~F.col(label))


def step_labels(steps: Column, labels: Column, separator: Column, last_only: bool = False) -> tuple[Column, Column]:
    """V8: (tokens, labels): each step and its separator; the label stands on a step's last token, else ignored. With
    ``last_only``, only the last step is labelled."""
    full = F.transform(steps, lambda s: F.concat(s, separator))
    n = F.size(steps)
    lab = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_repeat(F.lit(IGNORE), F.size(F.element_at(full, i)) - 1), F.array(F.when(F.lit(not last_only) | (i == n), F.element_at(labels, i)).otherwise(F.lit(IGNORE)))))
    some = n > 0
    none = F.array().cast("array<int>")
    return F.when(some, F.flatten(full)).otherwise(none), F.when(some, F.flatten(lab)).otherwise(none)


def total_reward(rewards: list[Column], weights: list[float]) -> Column:
    """V9: the weighted sum, nulls and NaN counting nothing."""
    return sum(F.coalesce(F.nanvl(r.cast("double"), F.lit(None)), F.lit(0.0)) * w for r, w in zip(rewards, weights, strict=True))


def group_advantage(df: DataFrame, group: str, reward: str, scale: str = "group") -> DataFrame:
    """V9: adds ``group_mean, advantage``; scaled by the group's deviation, all rows', or not at all."""
    g = Window.partitionBy(group)
    out = df.withColumn("group_mean", F.avg(reward).over(g)).withColumn("advantage", F.col(reward) - F.avg(reward).over(g))
    if scale == "group":
        return out.withColumn("advantage", F.col("advantage") / (F.coalesce(F.stddev_samp(reward).over(g), F.lit(0.0)) + STD_FLOOR))
    if scale == "batch":
        std = df.agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_s"))
        return out.crossJoin(F.broadcast(std)).withColumn("advantage", F.col("advantage") / (F.col("_s") + STD_FLOOR)).drop("_s")  # one row
    return out


def rloo(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Each row's baseline is the mean of the others of its group (none: 0)."""
    g = Window.partitionBy(group)
    n, s = F.count(reward).over(g), F.sum(reward).over(g)
    base = F.when(n > 1, (s - F.col(reward)) / (n - 1)).otherwise(0.0)
    return df.withColumn("baseline", base).withColumn("advantage", F.col(reward) - F.col("baseline"))


def repeated(df: DataFrame, key: str, generations: int, seed: int, batch: int = 1, repeats: int = 1, by: Column | None = None) -> DataFrame:
    """Rows in a seeded order, in batches of ``batch``; each batch ``repeats`` times in a row, each of its rows
    ``generations`` times in a row; a last batch that isn't full is left out. Adds ``place``, from 0, and ``copy``. The
    order is by a hash of seed and key, or else by ``by``."""
    order = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)) if by is None else by)
    at = S.global_index(order, ["_h", key]).withColumn("_i", F.col("index") - 1).drop("index", "_h")
    full = df.agg((F.floor(F.count("*") / batch) * batch).alias("_full"))
    at = at.crossJoin(F.broadcast(full)).where(F.col("_i") < F.col("_full"))  # one row
    at = at.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(generations - 1))))
    place = ((F.floor(F.col("_i") / batch) * repeats + F.col("_r")) * batch + F.col("_i") % batch) * generations + F.col("copy")
    return at.withColumn("place", place.cast("long")).drop("_i", "_full", "_r")


def with_bos(ids: Column, bos: int) -> Column:
    """BOS at the head unless it is there."""
    return F.when(F.coalesce(F.try_element_at(ids, F.lit(1)) == bos, F.lit(False)), ids).otherwise(F.concat(F.array(F.lit(bos)), ids))


def prompt_row(df: DataFrame, bos: int, prompt: str = "prompt_ids") -> DataFrame:
    """What online trainers take of a row: ``prompt_input_ids, prompt_attention_mask``."""
    ids = with_bos(F.col(prompt), bos)
    return df.withColumn("prompt_input_ids", ids).withColumn("prompt_attention_mask", F.transform(ids, lambda _: F.lit(1)))


def left_pads(ids: Column, pad: int) -> Column:
    """How many pads lead."""
    real = F.transform(ids, lambda x: x != pad)
    at = F.array_position(real, F.lit(True))
    return F.when(at == 0, F.size(ids)).otherwise(at - 1).cast("int")


def left_packed(ids: Column, pad: int) -> Column:
    """Pads moved to the end."""
    real = F.filter(ids, lambda x: x != pad)
    return F.concat(real, F.array_repeat(F.lit(pad), F.size(ids) - F.size(real)))


def routing_counts(df: DataFrame, expert: str, order: str) -> DataFrame:
    """Rows by expert in stable order with their place, and each expert's count."""
    w = Window.partitionBy(expert)
    return df.withColumn("place", F.row_number().over(w.orderBy(order))).withColumn("expert_tokens", F.count("*").over(w))


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over sizes and their counts: ``(size, first, stop, bin, each, used)``, by which the rows of a
    size numbered ``first`` to ``stop`` go, ``each`` of them to a bin, into bins from ``bin`` on, behind ``used``.

    Bins in the same state are kept as runs, so the work depends on the number of sizes, not of rows. A row goes to the
    bin with the least space that holds it, of equal ones to the first; it then has the least space for the next row of
    that size too, so a bin takes all it can before another does. A size over capacity has bins of its own; rows of size
    0 share a bin.
    """
    runs: list[list[int]] = []  # [space left, first bin, number of bins], bins with space only
    plan, bins = [], 0
    for size in sorted(histogram, reverse=True):
        left, at = histogram[size], 0
        runs.sort()
        kept: list[list[int]] = []
        for k, (space, first, n) in enumerate(runs):
            if space < size or not left:
                kept.append(runs[k])
                continue
            each = space // size if size else left
            used = min(n, -(-left // each))
            take = min(left, used * each)
            plan.append((size, at, at + take, first, each, capacity - space))
            whole = take // each
            kept += [[rest, b, m] for rest, b, m in ((space - each * size, first, whole), (space - (take - whole * each) * size, first + whole, used - whole), (space, first + used, n - used)) if m and rest > 0]
            at, left = at + take, left - take
        if left:
            each = max(1, capacity // size) if size else left
            used = -(-left // each)
            plan.append((size, at, at + left, bins, each, 0))
            whole = left // each
            kept += [[rest, b, m] for rest, b, m in ((capacity - each * size, bins, whole), (capacity - (left - whole * each) * size, bins + whole, used - whole)) if m and rest > 0]
            bins += used
        runs = kept
    return plan


def pack_best_fit(df: DataFrame, key: str, size: str, capacity: int, parts: int | None = None) -> DataFrame:
    """V2: best-fit-decreasing packing: ``key, part, bin, offset``, the same for every number of tasks: what a sequential
    pass over the rows by falling size, then key, would give. ``part`` is 0.

    The bins are solved on the histogram of sizes (at most ``capacity`` classes and one for each size beyond it, which
    are counted as one); rows are numbered within their size by ranges of (size, key), and take their place from that
    plan. Rows over capacity have a bin of their own; null sizes are 0; rows that share a size and a key are told apart
    as read.
    """
    spark = df.sparkSession
    root = work_dir(spark)
    whole = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    base = df.select(F.col(key).alias("_k"), whole.alias("_z"), F.least(whole, F.lit(capacity + 1)).alias("_s"), F.monotonically_increasing_id().alias("_i"))
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = settle(base.repartitionByRange(n, F.desc("_z"), "_k", "_i").withColumn("_p", F.spark_partition_id()), f"{root}/sizes")
    count = dealt.groupBy("_s", "_p").agg(F.count("*").alias("_n"))
    plan = best_fit_plan({r["_s"]: r["n"] for r in count.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}, capacity)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_p", "_s").orderBy(F.desc("_z"), "_k", "_i")) - 1
    ranked = dealt.withColumn("_r", inside).join(count.select("_s", "_p", before.alias("_b")), ["_s", "_p"]).select("_k", "_s", (F.col("_r") + F.col("_b")).alias("_r"))
    held = spark.sparkContext.broadcast(np.array(sorted(plan), np.int64).reshape(-1, 6))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = held.value
        low, step = np.searchsorted(steps[:, 0], np.arange(capacity + 3)), steps[:, 1]
        for rows in frames:
            s, r = rows["_s"].to_numpy(), rows["_r"].to_numpy()
            at = np.empty(len(s), np.int64)
            for v in np.unique(s):
                k = s == v
                at[k] = low[v] + np.searchsorted(step[low[v] : low[v + 1]], r[k], side="right") - 1
            _, first, _, start, each, used = steps[at].T
            yield pd.DataFrame({key: rows["_k"], "part": np.zeros(len(s), np.int32), "bin": start + (r - first) // each, "offset": used + (r - first) % each * np.minimum(s, capacity)})

    return ranked.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, part int, bin long, offset long")
