"""Sources and sinks: text in several encodings, Markdown cards, JSON lines, fact files, reports, snapshots."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.functions import text as X
from quillmill.sources.durable import hadoop_path, open_uri, qualified

# ---- fixed values (file names, kinds, versions and patterns of the data model)
AGGREGATES = ("characters", "relationships", "timeline", "plot_threads", "chapter_summaries")
ALWAYS_VISIBLE = {"world": "worldbuilding", "style": "style", "glossary": "glossary"}
CARD_KINDS = {"人物": "character", "地点": "location", "场景氛围": "scene", "场景": "scene", "物件": "prop", "道具": "prop", "势力": "faction", "组织": "faction", "功法": "ability", "法宝": "item"}
ALIAS_LABEL = r"\*\*别名[/／]称呼"
BAD_OUTPUT = {
    "switch": "/no_think",
    "think": "</?think>",
    "switch_rest": r"(?m)^/no\b",
    "filler_line": r"(?m)^好的[。，：]?\s*$",
    "filler": "好的，|接下来我将|以下是",
    "list": r"\p{Nd}+[.．、]",
    "latin": "[A-Za-z]{4,}",
}
HEADER = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n"
SCHEMA_VERSION = "system_b.v1"


class SourceError(ValueError):
    """A source that can't be used as it is."""


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files; one that isn't UTF-8 is an error."""
    raw = spark.read.format("binaryFile").load(path)
    if bad := raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path").limit(1).collect():
        raise SourceError(f"not UTF-8: {bad[0][0]}")
    return raw.select("path", F.col("content").cast("string").alias("text"))


@F.pandas_udf(StringType())
def _gb18030(raw: pd.Series) -> pd.Series:
    def one(b: bytes) -> str | None:
        try:
            return b.decode("gb18030")
        except UnicodeDecodeError:
            return None

    return raw.map(one)


def read_any(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``path, text`` of all files below a folder, by path: UTF-8 with or without a mark, else GB18030; null
    text where none fits. Only files that aren't UTF-8 reach Python."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    t = F.col("content").cast("string")
    ok = raw.where(F.is_valid_utf8(t)).select("path", F.regexp_replace(t, "^﻿", "").alias("text"))
    rest = raw.where(~F.is_valid_utf8(t)).select("path", _gb18030("content").alias("text"))
    return ok.union(rest).orderBy("path")


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first candidate that is there; each is looked at once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in dict.fromkeys(candidates):
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None


def only_file(files: DataFrame) -> str:
    """The one path of a source."""
    found = [r[0] for r in files.select("path").limit(2).collect()]
    if len(found) != 1:
        raise SourceError(f"{len(found)} files where one is expected")
    return found[0]


def header(c: Column) -> Column:
    return F.regexp_extract(c, HEADER, 1)


def body(c: Column) -> Column:
    return F.regexp_replace(c, HEADER, "")


def header_int(c: Column, field: str) -> Column:
    """An integer field of a header; quoted, fractional or absent values are null, true and false are 1 and 0."""
    v = F.regexp_extract(header(c), rf"(?m)^{field}:[ \t]*(-?\d{{1,9}}|true|false)[ \t]*$", 1)
    return F.when(v == "true", 1).when(v == "false", 0).when(v != "", F.try_to_number(v, F.lit("S999999999")).cast("int"))


def header_map(c: Column) -> Column:
    """A flat header as a map of strings; lines that aren't ``key: value`` are left out."""
    pairs = F.filter(F.split(header(c), r"\r?\n"), lambda x: x.rlike(r"^[^\s:#][^:]*:"))
    one = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^[\"'](.*)[\"']$", "$1").alias("v"))
    return F.map_from_entries(F.transform(pairs, one))


def read_cards(spark: SparkSession, root: str) -> DataFrame:
    """Cards below a folder in path order, without the aggregates at its root: ``doc_ord, path, source, text,
    depth_class, revealed_in, valid_from, valid_to``."""
    from quillmill.operators.retrieval import path_class

    raw = read_any(spark, root, "*.md")
    base = "^(?:file:)?/*" + root.replace("file:", "").strip("/") + "/"
    rel = F.regexp_replace("path", base, "")
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    cards = raw.where(~((F.instr(rel, "/") == 0) & stem.isin(*AGGREGATES)))
    t = F.col("text")
    out = cards.select("path", stem.alias("source"), body(t).alias("text"), path_class(rel, "").alias("depth_class"), *[header_int(t, f).alias(f) for f in ("revealed_in", "valid_from", "valid_to")])
    from quillmill.functions.segment import global_index

    return global_index(out, ["path"]).withColumn("doc_ord", F.col("index") - 1).drop("index")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Blank lines skipped; a line that isn't JSON is an error that shows it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if bad := lines.where(F.try_parse_json("value").isNull()).limit(1).collect():
        raise SourceError(f"invalid JSON in {path}: {bad[0][0][:80]}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, characters as they are; ``append`` for summaries that arrive one by one."""
    df.write.mode(mode).json(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """``ord, fact`` (VARIANT) of a list, or of an object's facts or entries."""
    v = F.parse_json(F.col("value"))
    raw = spark.read.text(path, wholetext=True).select(v.alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.facts", "array<variant>"), F.try_variant_get("v", "$.entries", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    out = raw.select(F.posexplode(items).alias("ord", "fact"))
    if out.where(~F.schema_of_variant("fact").startswith("OBJECT")).limit(1).count():
        raise SourceError("a fact is not an object")
    return out


def fact_columns(facts: DataFrame) -> DataFrame:
    """Typed columns of VARIANT facts, for validation."""
    get = lambda f, t: F.try_variant_get("fact", f"$.{f}", t).alias(f)
    whole = lambda f: F.when(F.schema_of_variant(F.try_variant_get("fact", f"$.{f}", "variant")).isin("BIGINT", "BOOLEAN"), F.try_variant_get("fact", f"$.{f}", "int")).alias(f)
    one = F.try_variant_get("fact", "$.entities", "string")
    ents = F.coalesce(F.try_variant_get("fact", "$.entities", "array<string>"), F.when(one.isNotNull(), F.array(one))).alias("entities")
    return facts.select("ord", get("id", "string"), get("type", "string"), get("title", "string"), get("summary", "string"), whole("chapter"), ents, whole("valid_from"), whole("valid_to"), whole("revealed_in"), get("confidence", "double"), get("created_at", "string"))


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fact table, empty where there is none; of another schema version: an error."""
    if first_existing(spark, [path]) is None:
        return spark.createDataFrame([], schema)
    out = spark.read.parquet(path)
    if bad := out.where(F.col("schema_version") != SCHEMA_VERSION).limit(1).count():
        raise SourceError(f"{bad} rows of another schema version")
    return out.drop("schema_version")


def write_store(df: DataFrame, path: str) -> None:
    """A new snapshot; give each its own path, since a table can't be read and overwritten at once."""
    df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.parquet(path)


def read_config(path: str) -> dict:
    """A YAML mapping, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if not isinstance(data, dict):
        raise SourceError(f"{path}: not a mapping")
    return data


def write_cards(cards: DataFrame, root: str, prune: bool = False) -> None:
    """``rel_path, content`` as files below ``root``, by executors, through Arrow's file systems. With ``prune`` the
    folder is emptied of cards first."""
    spark = cards.sparkSession
    target = qualified(spark, root)
    if prune:
        for child in ("facts", "entities"):
            fs, p = hadoop_path(spark, f"{target}/{child}")
            fs.delete(p, True)

    def write(rows) -> None:
        store, base = open_uri(target)
        for r in rows:
            path = PurePosixPath(base) / r["rel_path"]
            store.create_dir(str(path.parent), recursive=True)
            with store.open_output_stream(str(path)) as f:
                f.write(r["content"].encode())

    cards.select("rel_path", "content").foreachPartition(write)


def write_report(report: DataFrame, path: str) -> None:
    """A report, one row, as pretty JSON in one file."""
    report.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text, such as a draft, to one file by the driver; its full URI."""
    uri = qualified(spark, path)
    store, at = open_uri(uri)
    store.create_dir(str(PurePosixPath(at).parent), recursive=True)
    with store.open_output_stream(at) as f:
        f.write(text.encode())
    return uri


def write_draft(spark: SparkSession, folder: str, texts: list[str], stamp: str) -> str:
    """Accepted texts under the time ``stamp``; its full URI."""
    return write_text(spark, f"{folder.rstrip('/')}/draft_{stamp}.txt", "\n\n".join(texts))


def write_last_call(spark: SparkSession, folder: str, request: dict, thinking: str, content: str) -> list[str]:
    """The last call to a model, for a look at it: the request as JSON, its messages as text, and the answer."""
    prompt = "\n\n".join(f"[{m['role'].upper()}]\n{m['content']}" for m in request.get("messages", []))
    files = {"last_request.json": json.dumps(request, ensure_ascii=False, indent=2), "last_prompt.txt": prompt, "last_response.txt": f"[THINKING]\n{thinking}\n[CONTENT]\n{content}"}
    return [write_text(spark, f"{folder.rstrip('/')}/{name}", text) for name, text in files.items()]


def json_context(files: DataFrame, text: str = "text") -> DataFrame:
    """``path, characters, plots`` of JSON files: a line for each named character that develops, and for each plot
    that isn't empty; null where a file isn't a JSON object."""
    v = X.parse_json_object(F.col(text))
    people = F.coalesce(F.try_variant_get(v, "$.characters", "array<map<string,string>>"), F.expr("cast(array() as array<map<string,string>>)"))
    field = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    some = F.filter(people, lambda m: (field(m, "name") != "") & (field(m, "dev") != ""))
    lines = F.transform(some, lambda m: F.concat(F.lit("- "), field(m, "name"), F.lit("（"), field(m, "role"), F.lit("）："), field(m, "dev")))
    plots = F.filter(F.coalesce(F.try_variant_get(v, "$.plots", "array<string>"), F.array().cast("array<string>")), lambda p: p != "")
    shown = lambda c: F.when(v.isNotNull(), F.array_join(c, "\n"))
    return files.select("path", shown(lines).alias("characters"), shown(F.transform(plots, lambda p: F.concat(F.lit("- "), p))).alias("plots"))


def advert_free(lines: DataFrame, column: str = "line") -> DataFrame:
    """F13."""
    return lines.where(~F.col(column).rlike("soushu|Download|www[.]"))


def bad_output(c: Column) -> Column:
    """names of the patterns that a generated text shows."""
    return F.array_compact(F.array(*[F.when(c.rlike(r), F.lit(n)) for n, r in BAD_OUTPUT.items()]))


def aggregated(c: Column) -> Column:
    """F2 for a stem at the root."""
    return c.isin(*AGGREGATES)


def _header(title: Column, kind: Column, start: Column, names: Column | None, chapters: Column | None) -> Column:
    """A card's header; lists only where they hold something."""
    quoted = F.when(title.rlike(r"[:{}\[\]|>&*!,#?@`']"), F.concat(F.lit('"'), title, F.lit('"'))).otherwise(title)
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x.cast("string"))), "\n")))
    at = start.cast("string")
    lines = [F.lit("---"), F.concat(F.lit("title: "), quoted), F.concat(F.lit("type: "), kind), *([] if names is None else [listed("aliases", names)]), F.concat(F.lit("revealed_in: "), at), F.concat(F.lit("valid_from: "), at), F.lit("valid_to: null"), *([] if chapters is None else [listed("source_chapters", chapters)]), F.lit("---")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def enriched(cards: DataFrame, rel: str = "rel_path", text: str = "text") -> DataFrame:
    """``rel_path, action, content`` of cards below a folder. Hidden cards and those of other folders are left out;
    aggregates at the root and cards with a header stay as they are; the world, style and glossary cards at the root are
    visible from chapter 1, other cards at the root too, by the type they name; generated cards from the first chapter
    that they name, with their aliases. Running it again changes nothing; writing the contents is the caller's."""
    t, path = F.col(text), F.col(rel)
    stem = F.regexp_extract(path, r"([^/]+)\.md$", 1)
    root, made = F.instr(path, "/") == 0, path.startswith("generated/")
    chapters = X.chapter_refs(t)
    first = F.coalesce(F.try_element_at(chapters, F.lit(1)), F.lit(1).cast("long"))
    one = F.array(F.lit(1).cast("long"))
    fixed = root & stem.isin(*ALWAYS_VISIBLE)
    kind = X.handwritten_type(X.strip(F.regexp_extract(t, r"##\s*类型\s*\n+([^\n]+)", 1)), CARD_KINDS)
    head = F.when(fixed, _header(stem, F.try_element_at(X.lit_map(ALWAYS_VISIBLE), stem), F.lit(1), None, None))
    head = head.when(made, _header(stem, F.lit("character"), first, X.aliases(t, ALIAS_LABEL), F.when(F.size(chapters) > 0, chapters).otherwise(one)))
    head = head.otherwise(_header(stem, kind, F.lit(1), None, one))
    has = t.rlike(HEADER)
    start = F.when(made, first).otherwise(1).cast("string")
    action = F.when(root & stem.isin(*AGGREGATES), "skip:aggregate").when(has, "skip:header").otherwise(F.concat(F.lit("add:"), start))
    kept = cards.where(~stem.startswith(".") & (root | made))
    return kept.select(path.alias(rel), action.alias("action"), F.when(action.startswith("add:"), F.concat(head, t)).otherwise(t).alias("content"))
