"""Words and their CRCs straight from the UTF-8 buffers of Arrow string columns.

A byte automaton with two states: a table says of every byte whether it belongs to a word (all bytes of a multi-byte
character do), and words begin and end where that answer changes. CRC-32 is advanced by its table for all words at
once, byte by byte, the words in order of falling length, so that those still running are a prefix.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmill.llm.common import in_steps

_ALL = 0xFFFFFFFF
#: Bytes of a word that are advanced along with those of other words; the few longer ones go on by themselves.
TOGETHER = 48


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of letters and digits, and of letters alone, once A-Z are lower-cased.
ALNUM, LETTERS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)), byte_class((0x61, 0x7A), (0x80, 0xFF))


def crc_table() -> np.ndarray:
    """The CRC-32 table of the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


def steps(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, lower-cased bytes, offsets of the rows among them) of about ``size`` bytes; null is empty
    and a longer text is a step of its own. Nothing is decoded."""
    text = pc.fill_null(column, "") if column.null_count else column
    if not len(text):
        return
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    for a, b in in_steps(np.diff(offsets).tolist(), size):
        yield a, b, LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first): the words, and the number of the first word of each text (one more than there are texts)."""
    inside = word[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # words don't run on from one text to the next
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return begin, end, np.searchsorted(begin, offsets)


def advance(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers (not inverted) after the bytes from ``begin`` to ``end``, for all starts at once."""
    length = end - begin
    order = np.argsort(-length, kind="stable")
    s, at, n = state[order], begin[order], length[order]
    running = np.searchsorted(-n, -np.arange(TOGETHER + 1), side="left")  # words with more than j bytes
    for j in range(TOGETHER):
        k = running[j]
        if not k:
            break
        x = s[:k]
        s[:k] = CRC[(x ^ data[at[:k] + j]) & 255] ^ (x >> 8)
    for i in range(running[TOGETHER]):
        rest = data[at[i] + TOGETHER : at[i] + n[i]].tobytes()
        s[i] = zlib.crc32(rest, int(s[i]) ^ _ALL) ^ _ALL
    out = np.empty_like(s)
    out[order] = s
    return out


def run_crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... ``longest`` words: (the first word of each run that lies in one text, its CRC-32), the words joined by
    a space. A run's register is that of the run without its last word, taken on."""
    last = np.repeat(first[1:], np.diff(first))  # the end of each word's text
    start = np.arange(len(begin))
    state = np.full(len(begin), _ALL, np.uint32)
    for k in range(longest):
        if k:
            stay = start + k < last[start]
            start, state = start[stay], state[stay]
            state = CRC[(state ^ 32) & 255] ^ (state >> 8)
        state = advance(state, data, begin[start + k], end[start + k])
        yield start, state ^ np.uint32(_ALL)
