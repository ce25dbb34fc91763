"""Segmentation of texts into paragraphs, sentences, lines, chapters and chunks: arrays first, rows where asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import NUMERAL, chapter_number, chinese_int, strip
from quillmill.sources.durable import settle, work_dir

# ---- fixed values
ENDERS = "。！？!?；;"
CLOSERS = r"”’」』\"'\)\]）】》"
#: A sentence: the least run up to a terminator (a dot between digits is none; an ellipsis is one only before space, a
#: closer, a terminator or the end), further terminators, closers and space; what is left at the end is one too.
_DOT = r"(?<![0-9])\.|\.(?![0-9])"
SENTENCE = rf"(?s).*?(?:[{ENDERS}]|{_DOT}|…++(?=\s|[{CLOSERS}]|[{ENDERS}.]|$))(?:…++|[{ENDERS}]|{_DOT})*+[{CLOSERS}]*+\s*+|(?s).+$"
#: Sentences as the SQL of overlaps cuts them: an ellipsis ends none, and a dot between digits is a letter of its own.
DECIMAL, INNER_DOT = r"\.(?<=[0-9]\.)(?=[0-9])", "\ue000"
PLAIN = rf"(?s).*?[{ENDERS}.]++[{CLOSERS}]*+|(?s).+"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
#: Bits of a row's place below those of its part, in monotonically_increasing_id.
PLACE_BITS = 33
HEADING = rf"(?im)^[ \t]*(?:第[ \t]*[{NUMERAL}]{{1,8}}[ \t]*(?:章|章节|节|卷|回)|Chapter[ \t]+[0-9]{{1,8}})[^\r\n]{{0,80}}$"


def unix(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def paragraphs(c: Column) -> Column:
    """Split at blank lines, stripped, without empty ones."""
    parts = F.split(strip(unix(c)), r"\n[ \t\f\x0B]*\n(?:[ \t\f\x0B]*\n)*")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Sentences, stripped, without empty ones."""
    found = F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def plain_sentences(c: Column) -> Column:
    """Sentences of overlaps, stripped, without empty ones; dots between digits are ``INNER_DOT``."""
    found = F.regexp_extract_all(F.regexp_replace(c, DECIMAL, INNER_DOT), F.lit(PLAIN), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def all_lines(c: Column) -> Column:
    """lines at every kind of break, with the empty one that a break at the end opens; an empty text is one line."""
    return F.split(c, LINE_BREAK, -1)


def lines(c: Column) -> Column:
    """Lines at every kind of break; a break at the end opens no further line."""
    parts = all_lines(c)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def cut_at(c: Column, pattern: str) -> Column:
    """Pieces of a text, each beginning with a match of ``pattern`` but for the first: array<struct<start, piece>>."""
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    pieces = F.zip_with(F.split(c, pattern, -1), heads, lambda g, h: F.concat(F.coalesce(h, F.lit("")), g))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,piece:string>>)").alias("out"))
    return F.aggregate(pieces, zero, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), p.alias("piece"))).alias("out")), lambda s: s["out"])


def chapters_by_position(docs: DataFrame, text: str = "text") -> DataFrame:
    """T4: chapters after headings on a line of their own, numbered by position from 1. A heading on the first line has
    no break before it and opens none; what precedes the first is dropped. Adds ``chapter, heading, body``."""
    parts = F.split(unix(F.col(text)), r"\n(?=第[^\n]{1,20}章[^\n]*\n)")
    kids = docs.select("*", F.posexplode(parts).alias("chapter", "_p")).where("chapter > 0")
    return kids.withColumn("heading", strip(F.substring_index("_p", "\n", 1))).withColumn("body", strip(F.expr("substring(_p, instr(_p, '\n') + 1)"))).drop("_p")


def chapters_by_number(docs: DataFrame, text: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """T5: chapters by the numeral in the heading; unreadable ones are skipped. Adds ``chapter, heading, body``."""
    parts = cut_at(unix(F.col(text)), rf"(?m)^第[{NUMERAL}]+章[^\n]*$")
    kids = docs.select("*", F.explode(parts).alias("_p")).withColumn("_h", F.regexp_extract("_p.piece", rf"^第([{NUMERAL}]+)章", 1))
    kids = kids.withColumn("chapter", F.when(F.col("_h") != "", chinese_int(F.col("_h")))).where("chapter is not null")
    out = kids.withColumn("heading", strip(F.substring_index("_p.piece", "\n", 1))).withColumn("body", strip(F.regexp_replace("_p.piece", r"^[^\n]*\n?", "")))
    return out.drop("_p", "_h").orderBy(*order, "chapter") if order else out.drop("_p", "_h")


def section_of(offset: Column, ranges: list[tuple[str, int, int]]) -> Column:
    """The section whose half-open range holds an offset; null outside all."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(ranges):
        out = F.when((offset >= lo) & (offset < hi), F.lit(name)).otherwise(out)
    return out


def section_slices(docs: DataFrame, ranges: list[tuple[str, int, int]], headings: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """Chapter slices of each section by its own heading pattern, as offsets into the text: adds ``section,
    section_index, heading, heading_start, body_start, body_end``. A section's prelude has index 0."""
    out = None
    for name, lo, hi in ranges:
        part = F.substring(text, lo + 1, hi - lo)
        kids = docs.select("*", F.posexplode(cut_at(part, headings[name])).alias("section_index", "_p"))
        kids = kids.withColumn("section", F.lit(name)).withColumn("heading_start", F.col("_p.start") + lo)
        head = F.when(F.col("section_index") > 0, F.regexp_extract("_p.piece", headings[name], 0)).otherwise(F.lit(""))
        kids = kids.withColumn("heading", strip(head)).withColumn("body_start", F.col("heading_start") + F.length(head))
        kids = kids.withColumn("body_end", F.col("heading_start") + F.length("_p.piece")).drop("_p")
        out = kids if out is None else out.unionByName(kids)
    return out


def chunks(docs: DataFrame, key: list[str], text: str = "text", size: int = 3000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters with ``overlap``, within chapters (and the preface before the first), or over
    the whole text where no heading is found. Blank windows are skipped; ``part_number`` only where a segment is cut.

    Returns ``*key, chapter_number, chapter_title, chunk_number, part_number, start_char, end_char, text``.
    """
    step = max(1, size - overlap)
    seg = docs.select(*key, F.posexplode(cut_at(F.col(text), HEADING)).alias("_i", "_s"), (F.size(F.regexp_extract_all(text, F.lit(HEADING), F.lit(0))) > 0).alias("_has"))
    piece, n = F.col("_s.piece"), F.length("_s.piece")
    title = F.when(~F.col("_has"), F.lit("按字数切分")).when(F.col("_i") == 0, F.lit("前言/开篇")).otherwise(strip(F.regexp_extract(piece, HEADING, 0)))
    seg = seg.where(F.length(strip(piece)) > 0).withColumn("chapter_title", title)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    win = seg.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_w")).withColumn("_lo", F.col("_w") * step)
    win = win.withColumn("_t", strip(F.substring(piece, F.col("_lo") + 1, F.lit(size)))).where("_t <> ''")
    here = Window.partitionBy(*key, "_i").orderBy("_w")
    return win.select(
        *key,
        F.when(F.col("_has") & (F.col("_i") > 0), chapter_number(F.col("chapter_title"))).alias("chapter_number"),
        "chapter_title",
        F.row_number().over(Window.partitionBy(*key).orderBy("_i", "_w")).alias("chunk_number"),
        F.when(n > size, F.row_number().over(here)).alias("part_number"),
        (F.col("_s.start") + F.col("_lo")).alias("start_char"),
        (F.col("_s.start") + F.least(F.col("_lo") + size, n)).alias("end_char"),
        F.col("_t").alias("text"),
    )


def global_index(chunked: DataFrame, order: list[str]) -> DataFrame:
    """``index`` from 1 in path and chunk order, by counts of range parts: no single task holds all rows. Each row's
    part and place are written with it, since a plan run twice, for counts and for rows, may cut its parts elsewhere."""
    spark = chunked.sparkSession
    placed = chunked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(placed, f"{work_dir(spark)}/placed").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    before = placed.groupBy("_part").count()
    before = before.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.col("_at") - F.shiftleft("_part", PLACE_BITS) + 1
    return placed.join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + inside).drop("_at", "_part", "_before")  # a row a part


def split_cards(docs: DataFrame, text: str = "text") -> DataFrame:
    """One card a ``### name`` section, without what stands in brackets; of equal names the last stays."""
    kids = docs.select(F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=### )")).alias("_i", "content")).where("content like '### %'")
    name = strip(F.regexp_replace(F.regexp_extract("content", r"^###\s+([^\n]+)", 1), "[（(].*$", ""))
    kids = kids.withColumn("name", name)
    return kids.groupBy("name").agg(F.max_by("content", "_i").alias("content"))


def chapter_summaries(docs: DataFrame, text: str = "text") -> DataFrame:
    """``chapter, title, summary`` of every section with a chapter number and a summary that isn't a placeholder."""
    kids = docs.select(F.explode(F.split(text, r"\n(?=## )")).alias("_s")).withColumn("_s", strip(F.col("_s"))).where("_s like '##%'")
    num = F.regexp_extract("_s", r"\*\*章节编号\*\*\s*[:：]\s*(\d{1,9})", 1)
    summary = strip(F.regexp_extract("_s", r"(?s)\*\*本章概要\*\*\s*[:：]\s*(.+?)(?=\n\s*-\s*\*\*|\z)", 1))
    title = strip(F.regexp_extract("_s", r"^##\s+([^\n]+)", 1))
    out = kids.select(chinese_int(F.when(num != "", num)).cast("int").alias("chapter"), title.alias("title"), summary.alias("summary"))
    return out.where("chapter is not null and summary <> '' and summary <> '未明确'").withColumn("title", F.when(F.col("title") == "", F.format_string("第%d章", "chapter")).otherwise(F.col("title")))


def tokens(c: Column) -> Column:
    """The default tokenizer: runs of letters and digits of two or more, and Han bigrams. Any expression from a
    string to an array of strings can stand in its place."""
    latin = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0)), lambda w: F.length(w) > 1)
    runs = F.regexp_extract_all(c, F.lit(r"[\p{IsHan}]{2,}"), F.lit(0))
    han = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin, han)


def tokens_with(names: list[str]):
    """The default tokenizer with a dictionary: names of a list that the caller bounds are tokens where they occur."""
    held = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return lambda c: F.concat(tokens(c), F.filter(held, lambda n: F.contains(c, n)))
