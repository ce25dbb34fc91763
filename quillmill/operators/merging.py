"""Merges of extracted records: by name, by unordered pair, timelines, glossaries, and the shape repair before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as X

UNKNOWN = "未明确"


def ordered(value: Column, order: str) -> Column:
    """Values in order of appearance."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def merge_named(records: DataFrame, name: str, order: str, lists: tuple[str, ...] = (), texts: tuple[str, ...] = (), conflicts: tuple[str, ...] = ()) -> DataFrame:
    """One row a normalised name: the first spelling; list fields united, text fields joined by ``；`` (each
    distinct, in order, missing values out); ``conflicts`` names text fields that hold several values. Sorted by key."""
    keyed = records.withColumn("_key", X.normalized_key(F.col(name))).where("_key <> ''")
    # values are made distinct by a partial aggregate first, so what is gathered for a name is its distinct values
    text = lambda c: F.array(F.struct(F.lit(c).alias("field"), F.lit(0).alias("at"), X.strip(F.col(c)).alias("v")))
    many = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(c).alias("field"), i.alias("at"), X.strip(v).alias("v")))
    out = keyed.groupBy("_key").agg(F.min_by(name, order).alias(name))
    if lists or texts:
        each = keyed.select("_key", F.col(order).alias("o"), F.explode(F.concat(*map(many, lists), *map(text, texts))).alias("x")).select("_key", "o", "x.*")
        first = each.where(~X.is_missing(F.col("v"))).groupBy("_key", "field", "v").agg(F.min(F.struct("o", "at")).alias("at"))
        pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("at", "v")))), lambda x: x["v"]).alias(c)
        out = out.join(first.groupBy("_key").agg(*map(pick, (*lists, *texts))), "_key", "left")
        out = out.select("_key", name, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in (*lists, *texts)])
    found = F.array_compact(F.array(*[F.when(F.size(c) > 1, F.concat(F.lit(f"{c}: "), F.array_join(c, " / "))) for c in conflicts])) if conflicts else F.array().cast("array<string>")
    out = out.withColumn("conflicts", found)
    for c in texts:
        out = out.withColumn(c, F.when(F.size(c) == 0, F.lit(UNKNOWN)).otherwise(F.array_join(c, "；")))
    return out.withColumnRenamed("_key", "key").orderBy("key")


def merge_relationships(records: DataFrame, a: str, b: str, kind: str, order: str, texts: tuple[str, ...] = ()) -> DataFrame:
    """By unordered pair and type; the direction seen first stays; in order of first appearance."""
    pair = F.array_join(F.array_sort(F.array(X.normalized_key(F.col(a)), X.normalized_key(F.col(b)))), "||")
    kids = records.withColumn("_key", F.concat_ws("||", pair, X.normalized_key(F.col(kind))))
    aggs = [F.min_by(F.struct(a, b, kind), order).alias("_f"), F.min(order).alias("first_ord")]
    aggs += [F.array_join(X.unique_strings(ordered(F.col(c), order)), "；").alias(c) for c in texts]
    return kids.groupBy("_key").agg(*aggs).select("_f.*", *texts, "first_ord").orderBy("first_ord")


def merge_timeline(events: DataFrame, event: str, source: str, order: str, evidence: str | None = None) -> DataFrame:
    """The first of equal events of a source; at most three pieces of evidence."""
    w = Window.partitionBy(X.normalized_key(F.concat(F.col(event), F.coalesce(source, F.lit(""))))).orderBy(order)
    out = events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return out.withColumn(evidence, F.slice(evidence, 1, 3)) if evidence else out


def merge_style(records: DataFrame, fields: tuple[str, ...], order: str, cap: int = 30) -> DataFrame:
    """The first ``cap`` distinct values of each style field over all records, in order, as one row: values are
    made distinct where they lie, and only the first ones of each field are gathered."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), X.strip(F.col(c)).alias("v")) for c in fields])).alias("x")
    seen = records.select(order, each).select(F.col(order).alias("o"), "x.*").where(~X.is_missing(F.col("v"))).groupBy("field", "v").agg(F.min("o").alias("o"))
    by = Window.partitionBy("field").orderBy("o", "v")
    kept = seen.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= cap)
    pick = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("_r", "v")))), lambda x: x["v"]), "；").alias(c)
    return kept.agg(*map(pick, fields))


def merge_summaries(records: DataFrame, order: str) -> DataFrame:
    """Chapter summaries in order of their chunks."""
    return records.orderBy(order)


def merge_results(sections: dict[str, DataFrame], order: str, style: DataFrame | None = None, summaries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every section of the merged extraction, from the record streams of :func:`streams` (``order, rec``) and the
    style fields and chapter summaries beside them."""
    field = lambda df, *names: df.select(order, *[F.try_element_at("rec", F.lit(n)).alias(n) for n in names])
    out = {}
    for name in ("characters", "locations", "organizations", "sub_threads"):
        if name in sections:
            out[name] = merge_named(field(sections[name], "name", "description", "source"), "name", order, texts=("description", "source"))
    if "relationships" in sections:
        out["relationships"] = merge_relationships(field(sections["relationships"], "a", "b", "type", "description"), "a", "b", "type", order, ("description",))
    if "timeline" in sections:
        out["timeline"] = merge_timeline(field(sections["timeline"], "event", "source"), "event", "source", order)
    if "glossary" in sections:
        out["glossary"] = glossary(field(sections["glossary"], "category", "term"), "category", "term")
    if style is not None:
        out["style"] = merge_style(style, tuple(c for c in style.columns if c != order), order)
    if summaries is not None:
        out["chapter_summaries"] = merge_summaries(summaries, order)
    return out


def glossary(records: DataFrame, category: str, term: str) -> DataFrame:
    """Terms by category, categories sorted, missing ones together."""
    c = F.when(X.is_missing(F.col(category)), "未分类").otherwise(X.strip(F.col(category)))
    return records.groupBy(c.alias("category")).agg(F.array_sort(F.collect_list(term)).alias("terms")).orderBy("category")


#: An extraction; lists are empty where nothing was found.
EXTRACTION = (
    "struct<characters:array<map<string,string>>,"
    "world:struct<locations:array<map<string,string>>,organizations:array<map<string,string>>,rules:array<map<string,string>>>,"
    "timeline:array<map<string,string>>,relationships:array<map<string,string>>,glossary:array<map<string,string>>,"
    "plot_threads:struct<main_thread:array<string>,consistency_points:array<string>,sub_threads:array<map<string,string>>,foreshadowing_planted:array<map<string,string>>,foreshadowing_resolved:array<map<string,string>>,unresolved_conflicts:array<map<string,string>>,character_motives:array<map<string,string>>>,"
    "style:map<string,string>,chapter_summary:map<string,string>>"
)
_RECORDS = "array<map<string,string>>"


def _objects(v: Column, path: str, label: Column, field: str = "source") -> Column:
    """The objects of a list (or a single one) at ``path``, with ``field`` filled; other items are dropped."""
    many = F.try_variant_get(v, path, "array<variant>")
    one = F.try_variant_get(v, path, "variant")
    items = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.expr("cast(array() as array<variant>)"))
    maps = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$", "map<string,string>")), lambda m: m.isNotNull())
    return F.transform(maps, lambda m: _fill(m, field, label))


def _fill(m: Column, field: str, value: Column) -> Column:
    has = ~X.is_missing(F.try_element_at(m, F.lit(field)))
    rest = F.map_filter(m, lambda k, _v: k != field)
    return F.when(has, m).otherwise(F.map_concat(rest, F.create_map(F.lit(field), value)))


def _strings(v: Column, path: str) -> Column:
    many, one = F.try_variant_get(v, path, "array<string>"), F.try_variant_get(v, path, "string")
    return X.unique_strings(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")))


def _threads(v: Column, path: str, label: Column) -> Column:
    """Plot items: objects as they are, anything else wrapped as a description."""
    many, one = F.try_variant_get(v, path, "array<variant>"), F.try_variant_get(v, path, "variant")
    items = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.expr("cast(array() as array<variant>)"))

    def item(x: Column) -> Column:
        m, s = F.try_variant_get(x, "$", "map<string,string>"), F.try_variant_get(x, "$", "string")
        return F.when(m.isNotNull(), _fill(m, "source", label)).when(~X.is_missing(s), F.create_map(F.lit("description"), X.strip(s), F.lit("source"), label))

    return F.filter(F.transform(items, item), lambda m: m.isNotNull())


def normalize_extraction(chunks: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``extraction`` to chunks (``chapter_title, file_name, start_char, end_char, chapter_number,
    chunk_number, index``) from a model's JSON; what doesn't parse gives the empty one."""
    read = F.coalesce(X.parse_json_object(F.col(response)), F.parse_json(F.lit("{}")))
    chunks = chunks.withColumn("_v", read).withColumn("_label", X.source_label(F.col("chapter_title"), F.col("file_name"), F.col("start_char"), F.col("end_char")))
    v, label = F.col("_v"), F.col("_label")
    obj = lambda p, f="source": _objects(v, p, label, f).alias(p.split(".")[-1])
    events = F.when(F.try_variant_get(v, "$.timeline.events", "variant").isNotNull(), _objects(v, "$.timeline.events", label)).when(F.try_variant_get(v, "$.timeline", "array<variant>").isNotNull(), _objects(v, "$.timeline", label)).otherwise(_objects(v, "$.events", label))
    terms = F.when(F.try_variant_get(v, "$.glossary.terms", "variant").isNotNull(), _objects(v, "$.glossary.terms", label)).otherwise(F.when(F.try_variant_get(v, "$.glossary", "array<variant>").isNotNull(), _objects(v, "$.glossary", label)).otherwise(F.expr(f"cast(array() as {_RECORDS})")))
    plot = F.struct(_strings(v, "$.plot_threads.main_thread").alias("main_thread"), _strings(v, "$.plot_threads.consistency_points").alias("consistency_points"), *[_threads(v, f"$.plot_threads.{k}", label).alias(k) for k in ("sub_threads", "foreshadowing_planted", "foreshadowing_resolved", "unresolved_conflicts", "character_motives")])
    style = F.try_variant_get(v, "$.style", "map<string,string>")
    none = F.create_map().cast("map<string,string>")
    number = F.coalesce("chapter_number", "chunk_number").cast("string")
    cs = F.coalesce(F.try_variant_get(v, "$.chapter_summary", "map<string,string>"), none)
    for field, value in (("chapter_title", F.col("chapter_title")), ("chapter_number", number), ("source", label)):
        cs = _fill(cs, field, value)
    cs = _fill(_fill(cs, "_order", F.col("index").cast("string")), "_file_name", F.col("file_name"))
    out = F.struct(obj("$.characters", "source_chapters"), F.struct(obj("$.world.locations"), obj("$.world.organizations"), obj("$.world.rules")).alias("world"), events.alias("timeline"), obj("$.relationships"), terms.alias("glossary"), plot.alias("plot_threads"), F.when(style.isNotNull(), _fill(F.map_filter(style, lambda k, _v: k != "source"), "source", label)).otherwise(none).alias("style"), cs.alias("chapter_summary"))
    return chunks.withColumn("extraction", out).drop("_v", "_label")


def streams(extracted: DataFrame, order: str = "index") -> dict[str, DataFrame]:
    """A frame of records (``order, rec``) for each section of the extraction."""
    paths = {"characters": "characters", "locations": "world.locations", "organizations": "world.organizations", "rules": "world.rules", "timeline": "timeline", "relationships": "relationships", "glossary": "glossary", "sub_threads": "plot_threads.sub_threads", "foreshadowing_planted": "plot_threads.foreshadowing_planted", "unresolved_conflicts": "plot_threads.unresolved_conflicts"}
    return {k: extracted.select(order, F.explode(f"extraction.{p}").alias("rec")) for k, p in paths.items()}


def record_cards(records: DataFrame, folder: str, name: str, fields: tuple[str, ...]) -> DataFrame:
    """``rel_path, content`` of merged records, a card each: its name and the fields that say something. Names
    whose file names are equal have their key's hash behind them."""
    same = Window.partitionBy("_slug")
    slugged = records.withColumn("_slug", X.slug(F.col(name))).withColumn("_n", F.count("*").over(same))
    file = F.when(F.col("_n") > 1, F.concat("_slug", F.lit("_"), F.left(F.sha1(F.col(name)), F.lit(8)))).otherwise(F.col("_slug"))
    line = lambda c: F.when(~X.is_missing(F.col(c)) & (F.col(c) != UNKNOWN), F.concat(F.lit(f"- {c}: "), X.strip(F.col(c))))
    body = F.concat_ws("\n", F.concat(F.lit("# "), X.strip(F.col(name))), F.lit(""), *map(line, fields))
    return slugged.select(F.concat(F.lit(f"generated/{folder}/"), file, F.lit(".md")).alias("rel_path"), F.concat(body, F.lit("\n")).alias("content"))
