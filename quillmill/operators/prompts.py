"""Prompt assembly, model calls and caches."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.sources.durable import discard, hadoop_path, settle, work_dir

#: A model: a prompt in, a text out. The default is deterministic and offline.
ModelFn = Callable[[str], str]


def mock_model(prompt: str) -> str:
    return "{}"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def numbered(items: Column, cap: int, show: Callable[[Column, Column], Column]) -> Column:
    """Items shown with their numbers from 1; null where there are none."""
    some = F.slice(F.coalesce(items, F.array()), 1, cap)
    return F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda x, i: show(x, i + 1)), "\n\n"))


def titled(title: str, body: Column, note: str = "") -> Column:
    """A block under its title; null where the body is null or empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"【{title}】\n{note}"), body))


def build_prompt(rows: DataFrame, system: str, recent: str = "recent", bible: str = "bible", prior: str = "prior", summary: str = "summary", grep: str = "grep", instruction: str = "instruction") -> DataFrame:
    """Adds ``messages``: five cards of 400 characters, earlier summaries and the session's of 500, three passages of
    700, the instruction, and last the text to go on from; an assistant turn that begins the next sentence."""
    cards = numbered(F.col(bible), 5, lambda x, i: F.format_string("【相关设定%d：%s】\n%s", i, F.coalesce(x["source"], F.lit("未知来源")), X.clip(x["text"], 400)))
    hits = numbered(F.col(grep), 3, lambda x, i: F.format_string("【原文命中段落%d】\n%s", i, X.clip(x, 700)))
    ask = X.strip(F.coalesce(instruction, F.lit("")))
    blocks = [
        titled("相关设定", cards),
        titled("前情提要", X.clip(F.col(prior), 500)),
        titled("剧情摘要", X.clip(F.col(summary), 500)),
        titled("原文命中段落", hits),
        F.when(ask != "", F.concat(F.lit("续写方向："), ask)),
        F.concat(F.lit("【当前上文】\n"), X.strip(F.coalesce(recent, F.lit("")))),
    ]
    user = F.array_join(F.array_compact(F.array(*blocks)), "\n\n")
    begun = X.prefill(F.coalesce(recent, F.lit("")))
    base = F.array(message("system", F.lit(system)), message("user", user))
    return rows.withColumn("messages", F.when(begun != "", F.array_append(base, message("assistant", begun))).otherwise(base))


def summary_prompt(text: Column, system: str) -> Column:
    """Two messages that ask for a summary."""
    return F.array(message("system", F.lit(system)), message("user", X.strip(text)))


def flat(messages: Column) -> Column:
    """A chat as one text, by role."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n")


def training_row(messages: Column, completion: Column) -> Column:
    """The first system and user messages and the completion as the assistant's; a begun sentence is dropped."""
    first = lambda role: F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]
    return F.array(message("system", first("system")), message("user", first("user")), message("assistant", completion))


def training_text(messages: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """A chat in the template's form: each message between marks, its role on the first line."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), m["content"], F.lit(f"{end}\n"))), "")


#: Marks that open the sections of a prompt (fixed values).
MARKS = ("【相关设定】", "【前情提要】", "【剧情摘要】", "【原文命中段落】", "续写方向：", "【当前上文】")


def sections(c: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The sections of a prompt in order: array<struct<at, mark, body>>; a mark counts where it stands first."""
    found = F.array_sort(F.filter(F.array(*[F.struct(F.locate(m, c).alias("at"), F.lit(m).alias("mark")) for m in marks]), lambda x: x["at"] > 0))
    end = lambda i: F.coalesce(F.try_element_at(found, i + 2)["at"], F.length(c) + 1)
    body = lambda x, i: F.substring(c, x["at"] + F.length(x["mark"]), F.greatest(end(i) - x["at"] - F.length(x["mark"]), F.lit(0)))
    return F.transform(found, lambda x, i: F.struct(x["at"].alias("at"), x["mark"].alias("mark"), X.strip(body(x, i)).alias("body")))


def context_of(c: Column) -> Column:
    """The text to go on from, out of a prompt as :func:`flat` writes it; empty where there is none."""
    return F.coalesce(section(c, "【当前上文】\n", ("\n[ASSISTANT]",)), F.lit(""))


def section(c: Column, start: str, ends: tuple[str, ...]) -> Column:
    """What stands after a marker and before the first of the ends; null without the marker."""
    has = F.contains(c, F.lit(start))
    body = F.substring(c, F.locate(start, c) + len(start), F.length(c))
    for e in ends:
        body = F.substring_index(body, e, 1)
    return F.when(has, X.strip(body))


def call_model(rows: DataFrame, prompt: str, model: ModelFn = mock_model, parse: Callable[[str], object] | None = None, attempts: int = 3, out: str = "response", wait: float = 2.0, most: float = 5.0, default: str = "") -> DataFrame:
    """Adds ``response, attempts, failed``. A call that raises, or whose answer ``parse`` rejects, is tried
    again after ``wait`` seconds, then twice that and so on, at most ``most``. A failure leaves ``default``: an empty
    response, or the label that stands for an unclear one."""

    def run(text: str) -> tuple[str, int, bool]:
        for n in range(1, attempts + 1):
            try:
                answer = model(text)
                if parse is not None:
                    parse(answer)
                return answer, n, False
            except Exception:  # noqa: BLE001 - any failure of a model counts as one attempt
                if n < attempts:
                    time.sleep(min(wait * n, most))
        return default, attempts, True

    @F.pandas_udf(f"{out} string, attempts int, failed boolean")
    def ask(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run(t or "") for t in texts], columns=[out, "attempts", "failed"])

    return rows.withColumn("_m", ask.asNondeterministic()(F.col(prompt))).select(*rows.columns, "_m.*")  # else a filter calls again


def cache_key(version: str, *parts: Column) -> Column:
    """The hash of a prompt's version and all that went into it."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


#: Calls of a committed batch, and hash classes of keys into which a batch is laid out.
BATCH_CALLS, KEY_CLASSES = 20_000, 64


def _class_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(KEY_CLASSES)).cast("int")


def _batches(spark, path: str) -> list[tuple[int, str]]:
    """The batches that were committed, in order."""
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("batch=")]
    done = [p for p in found if fs.exists(hadoop_path(spark, f"{p.toString()}/_SUCCESS")[1])]
    return sorted((int(p.getName().removeprefix("batch=")), p.toString()) for p in done)


def read_cache(spark, path: str, key: str, kind: str) -> DataFrame:
    """``key, response, class`` of all answers kept: of those that share a key the newest, in whole, by its batch."""
    paths = [p for _, p in _batches(spark, path)]
    if not paths:
        return spark.createDataFrame([], f"{key} {kind}, response string, class int")
    all_ = spark.read.schema(f"{key} {kind}, response string, status string, batch int, class int").option("basePath", path).parquet(*paths)
    newest = all_.where("status = 'ok'").groupBy(key).agg(F.max(F.struct("batch", "response")).alias("m"), F.first("class").alias("class"))
    return newest.select(key, F.col("m.response").alias("response"), "class")


def _commit(made: DataFrame, path: str, number: int, key: str) -> None:
    made.select(key, "response", F.lit("ok").alias("status"), _class_of(key).alias("class")).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("class").parquet(f"{path.rstrip('/')}/batch={number}")


def cached_calls(rows: DataFrame, path: str, key: str, prompt: str, model: ModelFn = mock_model, force: bool = False, parse: Callable[[str], object] | None = None, attempts: int = 3, wait: float = 2.0, batch: int = BATCH_CALLS) -> DataFrame:
    """Every row with its response, read through a cache at ``path``; null where no call was answered.

    A distinct key is called once, with the least of its prompts. Calls are made in batches of about ``batch`` keys, by
    hash, and each batch is committed as a whole, so a run that is cut short keeps those it finished. Only answers are
    kept: a key whose calls failed is called again by the next run. ``force`` calls all keys again; the newest answer
    counts. A null key is never kept or called and has no response. Batches are laid out by a class of the key.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    held = read_cache(spark, path, key, kind)
    asked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(prompt).alias(prompt))
    missing = settle(asked if force else asked.join(held.select(key), key, "left_anti"), f"{work_dir(spark)}/missing")
    n = missing.count()
    number = max([k for k, _ in _batches(spark, path)], default=0)
    shares = -(-n // batch)
    for k in range(shares):
        some = missing.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(shares)) == k)
        made = settle(call_model(some, prompt, model, parse, attempts, wait=wait).where("not failed"), f"{work_dir(spark)}/made")
        number += 1
        _commit(made, path, number, key)
    return rows.join(read_cache(spark, path, key, kind).select(key, "response"), key, "left")


def compact_cache(spark, path: str, key: str, kind: str) -> None:
    """One batch of all batches. It is committed before they go, so readers find every answer at any time."""
    old = _batches(spark, path)
    if len(old) > 1:
        _commit(read_cache(spark, path, key, kind), path, old[-1][0] + 1, key)
        for _, p in old:
            discard(spark, p)
