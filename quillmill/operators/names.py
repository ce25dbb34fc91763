"""Many names in many texts, by an Aho-Corasick automaton: one pass a text, whatever the number of names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillmill.operators.blocks import BLOCK, HELD, meet


def automaton(names: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for n in names:
        out.add_word(n, (len(n), n))
    out.make_automaton()
    return out


def counted(index, text: str) -> dict[str, int]:
    """How often each name occurs, its occurrences taken from the left without overlaps of their own."""
    free: dict[str, int] = {}
    n: dict[str, int] = {}
    for end, (size, name) in index.iter(text):
        if end - size + 1 >= free.get(name, 0):
            n[name] = n.get(name, 0) + 1
            free[name] = end + 1
    return n


def _use(index, texts: list) -> tuple[np.ndarray, list]:
    rows, names, freq = [], [], []
    for i, t in enumerate(texts if len(index) else []):
        for name, n in counted(index, t).items() if t else ():
            rows.append(i)
            names.append(name)
            freq.append(n)
    return np.array(rows, np.int64), [pa.array(names, pa.string()), pa.array(freq, pa.int32())]


def occurring(rows: DataFrame, text: str, names: DataFrame, name: str, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """``rows`` with each of ``names``'s names that occurs in ``text``, once, and ``freq``, how often. Null and empty
    texts and names find nothing; repeated names count once; repeated rows each find theirs."""
    out = StructType([StructField(name, StringType()), StructField("freq", IntegerType())])
    return meet(rows, text, names.select(name), automaton, _use, out, held, block)
