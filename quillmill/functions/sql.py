"""T1-T10, T13 in SQL text: segmentation as temporary SQL functions, those of rows as table functions for ``LATERAL``:

    SELECT doc_id, c.* FROM documents, LATERAL chunks_of(text, 3000, 200) AS c

Catalyst inlines a function's body, so the plan is a generator over the scan: no Python worker, no shuffle and no self-join
of the table. Rows equal those of the DataFrame forms in :mod:`quillmill.functions.segment`; where such a form looks at
other rows too (the last card of a name, the order of all chunks), the query says so by itself.

A null text gives null arrays and no rows; an empty text gives empty arrays and no rows, but for ``pieces_of`` and
``section_slices_of``, which give one empty piece. Texts of any length are one value each, as in the DataFrame forms. Equal
rows stay equal rows, and columns of the caller's table never meet those of a function, which has a name of its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillmill.functions import segment as S
from quillmill.functions.text import CN_DIGITS, CN_UNITS, NUMERAL, WS


def _lit(s: str) -> str:
    """A string literal, as read without ``spark.sql.parser.escapedStringLiterals``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {_lit(f'^{WS}+|{WS}+$')}, '')"


def _unix(e: str) -> str:
    return f"regexp_replace({e}, {_lit(chr(92) + 'r' + chr(92) + 'n?')}, {_lit(chr(10))})"


def _first_line(e: str) -> str:
    return f"substring_index({e}, {_lit(chr(10))}, 1)"


def _map(pairs: dict) -> str:
    return f"map({', '.join(f'{_lit(k)}, {v}L' for k, v in pairs.items())})"


def _number(e: str) -> str:
    """X10 of an expression that has no white space at its ends."""
    state = "named_struct('total', {}, 'section', {}, 'number', {}, 'bad', {})".format
    digit, unit = f"try_element_at({_map(CN_DIGITS)}, ch)", f"try_element_at({_map(CN_UNITS)}, ch)"
    step = (
        f"CASE WHEN {digit} IS NOT NULL THEN {state('s.total', 's.section', digit, 's.bad')}"
        f" WHEN {unit} = 10000L THEN {state('s.total + (s.section + s.number) * 10000L', '0L', '0L', 's.bad')}"
        f" WHEN {unit} IS NOT NULL THEN {state('s.total', f's.section + greatest(s.number, 1L) * {unit}', '0L', 's.bad')}"
        f" ELSE {state('s.total', 's.section', 's.number', '1L')} END"
    )
    walked = f"aggregate(split({e}, ''), {state('0L', '0L', '0L', '0L')}, (s, ch) -> {step}, s -> CASE WHEN s.bad = 0L THEN s.total + s.section + s.number END)"
    return f"CASE WHEN {e} RLIKE '^[0-9]{{1,18}}$' THEN try_cast({e} AS BIGINT) WHEN length({e}) > 0 THEN {walked} END"


def _chapter_number(e: str) -> str:
    """X11."""
    cn = f"regexp_extract({e}, {_lit(f'第{WS}*([{NUMERAL}]{{1,8}}){WS}*(?:章|章节|节|卷|回)')}, 1)"
    en = f"regexp_extract({e}, {_lit(f'(?i)Chapter{WS}+([0-9]{{1,8}})')}, 1)"
    return f"CASE WHEN {cn} <> '' THEN {_number(cn)} WHEN {en} <> '' THEN {_number(en)} END"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once: a lambda computes its inner expressions anew each time."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pieces(e: str, pattern: str) -> str:
    heads, gaps = f"concat(array(''), regexp_extract_all({e}, {pattern}, 0))", f"split({e}, {pattern}, -1)"
    pieces = f"zip_with({gaps}, {heads}, (g, h) -> concat(coalesce(h, ''), g))"
    zero = "named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRUCT<start: INT, piece: STRING>>))"
    step = "named_struct('at', a.at + length(p), 'out', array_append(a.out, named_struct('start', a.at, 'piece', p)))"
    return f"aggregate({pieces}, {zero}, (a, p) -> {step}, a -> a.out)"


def _chapters() -> str:
    parts = f"split({_unix('t')}, {_lit(r'\n(?=第[^\n]{1,20}章[^\n]*\n)')}, -1)"
    rest = f"substring(p, instr(p, {_lit(chr(10))}) + 1)"
    return f"filter(transform({parts}, (p, i) -> named_struct('chapter', i, 'heading', {_strip(_first_line('p'))}, 'body', {_strip(rest)})), c -> c.chapter > 0)"


def _numbered() -> str:
    number = f"regexp_extract(x.piece, {_lit(f'^第([{NUMERAL}]+)章')}, 1)"
    body = f"regexp_replace(x.piece, {_lit('^[^' + chr(92) + 'n]*' + chr(92) + 'n?')}, '')"
    each = f"named_struct('chapter', CASE WHEN {number} <> '' THEN {_number(number)} END, 'heading', {_strip(_first_line('x.piece'))}, 'body', {_strip(body)})"
    return f"filter(transform({_pieces(_unix('t'), _lit(rf'(?m)^第[{NUMERAL}]+章[^\n]*$'))}, x -> {each}), c -> c.chapter IS NOT NULL)"


def _sections() -> str:
    head = "CASE WHEN i > 0 THEN regexp_extract(x.piece, pattern, 0) ELSE '' END"
    start = "x.start + lo"
    each = f"named_struct('section_index', i, 'heading', {_strip(head)}, 'heading_start', {start}, 'body_start', {start} + length({head}), 'body_end', {start} + length(x.piece))"
    return f"transform({_pieces('substring(t, lo + 1, hi - lo)', 'pattern')}, (x, i) -> {each})"


def _chunks() -> str:
    head, step = _lit(S.HEADING), "greatest(1, size - overlap)"
    has = "size(ps) > 1"
    title = f"CASE WHEN NOT ({has}) THEN '按字数切分' WHEN i = 0 THEN '前言/开篇' ELSE {_strip(f'regexp_extract(x.piece, {head}, 0)')} END"
    last = f"CAST(greatest(0, ceil((length(x.piece) - size) / {step})) AS INT)"
    windows = f"transform(sequence(0, {last}), w -> named_struct('lo', w * {step}, 'text', {_strip(f'substring(x.piece, w * {step} + 1, size)')}))"
    row = (
        "named_struct('chapter_number', number, 'chapter_title', title, 'part_number', CASE WHEN length(x.piece) > size THEN k + 1 END,"
        " 'start_char', x.start + y.lo, 'end_char', x.start + least(y.lo + size, length(x.piece)), 'text', y.text)"
    )
    rows = f"transform(filter({windows}, y -> y.text <> ''), (y, k) -> {row})"
    named = _let(title, "title", _let(f"CASE WHEN {has} AND i > 0 THEN {_chapter_number('title')} END", "number", rows))
    segments = _let(_pieces("t", head), "ps", f"transform(ps, (x, i) -> CASE WHEN length({_strip('x.piece')}) > 0 THEN {named} ELSE array() END)")
    numbered = "named_struct('chapter_number', c.chapter_number, 'chapter_title', c.chapter_title, 'chunk_number', n + 1, 'part_number', c.part_number, 'start_char', c.start_char, 'end_char', c.end_char, 'text', c.text)"
    return f"transform(flatten({segments}), (c, n) -> {numbered})"


def _cards() -> str:
    parts = f"filter(split(concat({_lit(chr(10))}, t), {_lit(r'\n(?=### )')}, -1), p -> p LIKE '### %')"
    heading = f"regexp_extract(p, {_lit(r'^###\s+([^\n]+)')}, 1)"
    name = _strip(f"regexp_replace({heading}, '[（(].*$', '')")
    return f"transform({parts}, (p, i) -> named_struct('ord', i, 'name', {name}, 'content', p))"


def _summaries() -> str:
    parts = f"filter(transform(split(t, {_lit(r'\n(?=## )')}, -1), p -> {_strip('p')}), p -> p LIKE '##%')"
    number = f"regexp_extract(p, {_lit(r'\*\*章节编号\*\*\s*[:：]\s*(\d{1,9})')}, 1)"
    text = _strip(f"regexp_extract(p, {_lit(r'(?s)\*\*本章概要\*\*\s*[:：]\s*(.+?)(?=\n\s*-\s*\*\*|\z)')}, 1)")
    title = _strip(f"regexp_extract(p, {_lit(r'^##\s+([^\n]+)')}, 1)")
    chapter = f"CAST({_number(number)} AS INT)"
    each = f"named_struct('chapter', {chapter}, 'title', CASE WHEN {title} = '' THEN format_string('第%d章', {chapter}) ELSE {title} END, 'summary', {text})"
    return f"filter(transform({parts}, p -> {each}), c -> c.chapter IS NOT NULL AND c.summary <> '' AND c.summary <> '未明确')"


def _lines() -> str:
    parts = f"split(t, {_lit(S.LINE_BREAK)}, -1)"
    return f"CASE WHEN length(t) = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN element_at({parts}, -1) = '' THEN slice({parts}, 1, size({parts}) - 1) ELSE {parts} END"


def _stripped_parts(parts: str) -> str:
    return f"filter(transform({parts}, p -> {_strip('p')}), p -> p <> '')"


def _tokens() -> str:
    latin = f"filter(regexp_extract_all(lower(t), {_lit(r'[\p{L}\p{N}&&[^\p{IsHan}]]+')}, 0), w -> length(w) > 1)"
    runs = f"regexp_extract_all(t, {_lit(r'[\p{IsHan}]{2,}')}, 0)"
    return f"concat({latin}, flatten(transform({runs}, r -> transform(sequence(1, length(r) - 1), i -> substring(r, i, 2)))))"


_CHUNK = "chapter_number BIGINT, chapter_title STRING, chunk_number INT, part_number INT, start_char INT, end_char INT, text STRING"
_SECTION = "section_index INT, heading STRING, heading_start INT, body_start INT, body_end INT"


def definitions() -> dict[str, tuple[str, str | None, str]]:
    """By name: the parameters, the columns of a table function (none for an array), and the expression."""
    return {
        "paragraphs_of": ("t STRING", None, _stripped_parts(f"split({_strip(_unix('t'))}, {_lit(r'\n[ \t\f\x0B]*\n(?:[ \t\f\x0B]*\n)*')}, -1)")),
        "sentences_of": ("t STRING", None, _stripped_parts(f"regexp_extract_all(t, {_lit(S.SENTENCE)}, 0)")),
        "lines_of": ("t STRING", None, _lines()),
        "tokens_of": ("t STRING", None, _tokens()),
        "pieces_of": ("t STRING, pattern STRING", "start INT, piece STRING", _pieces("t", "pattern")),
        "chapters_of": ("t STRING", "chapter INT, heading STRING, body STRING", _chapters()),
        "numbered_chapters_of": ("t STRING", "chapter BIGINT, heading STRING, body STRING", _numbered()),
        "section_slices_of": ("t STRING, pattern STRING, lo INT, hi INT", _SECTION, _sections()),
        "chunks_of": ("t STRING, size INT, overlap INT", _CHUNK, _chunks()),
        "cards_of": ("t STRING", "ord INT, name STRING, content STRING", _cards()),
        "summaries_of": ("t STRING", "chapter INT, title STRING, summary STRING", _summaries()),
    }


def register(spark: SparkSession) -> list[str]:
    """Define the functions for the session; their names."""
    for name, (parameters, columns, body) in definitions().items():
        result = "RETURN" if columns is None else f"RETURNS TABLE({columns}) RETURN SELECT * FROM inline"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) {result} ({body})")
    return list(definitions())
