"""Document fingerprints: Merkle trees over pieces, paragraphs and sections.

A paragraph is a line; a section ends at a blank line, or, so that long runs of lines have branches too, after a line
whose last word's hash says so. A paragraph's leaves are pieces of a few words that end at a sentence's end or after a
word whose hash says so: where a text is cut depends on the words there alone, so an edit changes the pieces it touches
and no others. Leaves hash their bytes, white space included; nodes hash their children; equal roots are equal texts.

A fingerprint is the tree written out: the root, then for each section ``/`` and its hash, for each of its paragraphs
``:`` and its hash followed by the hashes of its pieces. Roots test equality; where they differ, :func:`likeness` goes
down the branches that differ and :func:`first_difference` names the first.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import in_steps, mix, powers, tidy

#: A word in so many ends a piece, and a line in so many ends a section.
PIECE, SECTION = 8, 16
#: Hex digits of a node in a fingerprint, and bytes of its digest in the tree.
DIGITS, BYTES = 8, 8
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _digest(level: int, content: bytes, size: int = BYTES) -> bytes:
    return hashlib.blake2b(content, digest_size=size, person=bytes([level])).digest()


def pieces(texts: list[str]) -> tuple[bytes, list[int], list[int], list[int], list[int]]:
    """(all bytes, begin, end, level, pieces before each text): the pieces of all texts; level 1 ends a paragraph, 2 a
    section. A text's pieces join up to its bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    buf = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[buf].view(np.int8), prepend=np.int8(1)))
    begin, end = edge[0::2], edge[1::2]
    first = np.searchsorted(begin, at)  # a text's first word
    lines = np.cumsum(buf == 10)
    h = np.cumsum(_VALUE[buf] * powers(_P, len(buf)), dtype=np.uint64)
    word = mix((h[end - 1] - np.where(begin > 0, h[begin - 1], np.uint64(0))) * powers(_INVERSE, len(buf))[begin])
    after = np.concatenate((begin[1:], [len(buf)]))
    breaks = lines[after - 1] - lines[end - 1]
    level = np.where((breaks > 1) | ((breaks > 0) & (word // np.uint64(PIECE) % np.uint64(SECTION) == 0)), 2, (breaks > 0).astype(np.int64))
    cut = (level > 0) | _STOP[buf[end - 1]] | (word % np.uint64(PIECE) == 0)
    final = first[1:][first[1:] > first[:-1]] - 1  # the last word of a text ends all of it
    cut[final] = False
    ends = np.flatnonzero(cut)
    some = np.flatnonzero(np.diff(at) > 1)  # texts with a byte
    starts, levels = np.concatenate((at[some], begin[ends + 1])), np.concatenate((np.zeros(len(some), np.int64), level[ends]))
    order = np.argsort(starts, kind="stable")
    starts, levels = starts[order], levels[order]
    before = np.searchsorted(starts, at)
    stops = np.concatenate((starts[1:], [0]))[: len(starts)]
    last = before[1:][some] - 1
    stops[last] = at[some + 1] - 1
    level = np.concatenate((levels[1:], [2]))[: len(starts)]  # a piece's level is that of the cut behind it
    level[last] = 2
    return data, starts.tolist(), stops.tolist(), level.tolist(), before.tolist()


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text, a step of them at a time."""
    out = []
    for a, b in in_steps(texts):
        data, begin, end, level, before = pieces(texts[a:b])
        for i in range(b - a):
            sections, paragraphs, leaves, written, section = [], [], [], [], []
            for k in range(before[i], before[i + 1]):
                leaves.append(_digest(0, data[begin[k] : end[k]]))
                if level[k]:
                    paragraphs.append(_digest(1, b"".join(leaves)))
                    section.append(":" + paragraphs[-1].hex()[:DIGITS] + "".join([x.hex()[:DIGITS] for x in leaves]))
                    leaves = []
                    if level[k] > 1:
                        sections.append(_digest(2, b"".join(paragraphs)))
                        written.append("/" + sections[-1].hex()[:DIGITS] + "".join(section))
                        paragraphs, section = [], []
            out.append(_digest(3, b"".join(sections), 16).hex() + "".join(written))
    return out


def tree(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """(root, [(section, [(paragraph, [pieces])])]) of a fingerprint."""
    root, *sections = fingerprint.split("/")
    out = []
    for s in sections:
        own, *paragraphs = s.split(":")
        out.append((own, [(p[:DIGITS], [p[k : k + DIGITS] for k in range(DIGITS, len(p), DIGITS)]) for p in paragraphs]))
    return root, out


def _unmatched(a: list, b: list) -> tuple[list, list]:
    """What is left of the nodes of each side without those that are equal."""
    both = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    rest = []
    for side in (a, b):
        left, out = Counter(both), []
        for x in side:
            if left[x[0]] > 0:
                left[x[0]] -= 1
            else:
                out.append(x)
        rest.append(out)
    return rest[0], rest[1]


def likeness(a: str, b: str) -> float:
    """Pieces that two fingerprints share, over the mean of what they have: 1 for equal roots, else 0 if one has none.
    Equal sections, then equal paragraphs, count whole; only branches that differ are gone down."""
    (x, left), (y, right) = tree(a), tree(b)
    if x == y:
        return 1.0
    size = lambda sections: sum(len(p[1]) for s in sections for p in s[1])
    total = size(left) + size(right)
    if not left or not right:
        return 0.0
    left, right = _unmatched(left, right)
    left, right = _unmatched([p for s in left for p in s[1]], [p for s in right for p in s[1]])
    c, d = Counter(k for p in left for k in p[1]), Counter(k for p in right for k in p[1])
    return (total - (c.total() + d.total() - 2 * (c & d).total())) / total


def first_difference(a: str, b: str) -> str | None:
    """Where ``a`` first differs from ``b``: ``section.paragraph.piece``, each from 0; null for equal trees. One that ends
    where the other goes on differs there."""
    (x, left), (y, right) = tree(a), tree(b)
    if x == y:
        return None
    for i, (s, t) in enumerate(zip(left, right, strict=False)):
        if s[0] != t[0]:
            for j, (p, q) in enumerate(zip(s[1], t[1], strict=False)):
                if p[0] != q[0]:
                    same = next((k for k, (u, v) in enumerate(zip(p[1], q[1], strict=False)) if u != v), min(len(p[1]), len(q[1])))
                    return f"{i}.{j}.{same}"
            return f"{i}.{min(len(s[1]), len(t[1]))}.0"
    return f"{min(len(left), len(right))}.0.0"


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of each row, where it lies. A null text is empty; an empty text's tree is its root alone; a
    text of any length is taken whole; repeated rows have equal fingerprints; extra columns are ignored."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(texts), pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with the later half of its code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, differs_at string"
_KEYS = ["id", "tie", "place"]


def _compared(ids: list, texts: list[str], following: list[str], own: list[str], next_own: list[str]) -> pa.RecordBatch:
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new_own = fingerprints(new)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
        pa.array(own, pa.string()),
        pa.array(new_own, pa.string()),
        pa.array([likeness(x, y) for x, y in zip(own, new_own, strict=True)], pa.float64()),
        pa.array([likeness(x, y) for x, y in zip(own, next_own, strict=True)], pa.float64()),
        pa.array([first_difference(x, y) for x, y in zip(own, new_own, strict=True)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])


def _inside(batches):
    """Each row of a part, in order, with the one after it; the last of a part isn't among them."""
    ids, texts, own = [], [], []
    for batch in batches:
        here = [t or "" for t in batch.column("text").to_pylist()]
        ids, texts, own = ids + batch.column("id").to_pylist(), texts + here, own + fingerprints(here)
        if len(ids) > 1:
            yield _compared(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
        ids, texts, own = ids[-1:], texts[-1:], own[-1:]


def _ends(batches):
    """The least and the greatest row of a part."""
    least = greatest = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _KEYS), strict=True))
        for i, k in enumerate((x is not None, x or 0, *rest) for x, *rest in keys):
            if least is None or k < least[0]:
                least = (k, batch.slice(i, 1).to_pylist()[0])
            if greatest is None or k > greatest[0]:
                greatest = (k, batch.slice(i, 1).to_pylist()[0])
    rows = [r[1] | {"last": last} for r, last in ((least, False), (greatest, True)) if r]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("last", pa.bool_()), ("id", pa.int64()), ("text", pa.string())]))


def _between(batches):
    for batch in batches:
        texts, following = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text", "following"))
        yield _compared(batch.column("id").to_pylist(), texts, following, fingerprints(texts), fingerprints(following))


def parts_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its text with the later half replaced by the beginning of the next row's (the first
    row follows the last), and how alike its fingerprint is to that and to the next row's: ``_OUT``'s columns.
    ``differs_at`` is the first branch that the edit changed.

    Rows are in order of id: null ids first, those that repeat an id by their text's hash, equal rows as read. Null texts
    are empty; a text of any length is taken whole; a single row follows itself; an empty table gives no rows; extra
    columns are ignored. The texts are range-partitioned once; neighbours meet as a part is read in order, and the two
    rows at the ends of each part meet those of the next by a join.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse", "true") != "true":
        raise ValueError("both readers of the dealt texts must see the same parts: leave spark.sql.exchange.reuse on")
    dealt = base.repartitionByRange(parts_of(spark), *_KEYS)
    inner = dealt.sortWithinPartitions(*_KEYS).select("id", "text").mapInArrow(tidy(_inside), _OUT)
    ends = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(tidy(_ends), "part int, last boolean, id long, text string")
    opens = ends.where("not last").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    all_ = Window.orderBy("part")  # one row a part, without its text
    after = ends.where("not last").select("part").withColumn("_n", F.lead("part").over(all_)).withColumn("_f", F.min("part").over(Window.partitionBy()))
    after = after.select("part", F.coalesce("_n", "_f").alias("next_part"))
    met = ends.where("last").join(after, "part").join(opens, "next_part").select("id", "text", "following")
    return inner.unionByName(met.mapInArrow(tidy(_between), _OUT))
