"""Segmentation by a dictionary: a lattice of the words that occur, and its best path by unigram log frequency.

:func:`dictionary_tokens` is a column and holds the whole dictionary in every task; :func:`cut_texts` joins the pieces of
texts with a dictionary of any size, and a task holds the words of one text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.sources.durable import settle, work_dir

#: Characters that a dictionary may have in all: it is held by every task. The weight of a card's name.
MOST, NAME_WEIGHT = 64_000_000, 10_000
#: What no word of the dictionary covers: a run of letters and digits of alphabetic scripts, or else a character.
_RUN = re.compile(r"[^\W_⺀-鿿가-힯豈-﫿]+")


class Lattice:
    """Words and their weights; ``cut(text)`` gives the text's best path. With ``runs`` a run of letters and digits of an
    alphabetic script may stand whole, as one piece outside the dictionary; without, all scripts are cut alike. A path scores the sum of ln(weight / total);
    a piece outside the dictionary weighs 1. Of equal paths the one whose first word is longer is taken. ``total`` is the
    weight of the dictionary that ``weights`` are a part of, if they aren't all."""

    def __init__(self, weights: dict[str, float], runs: bool = True, total: float | None = None):
        import ahocorasick

        self.runs = runs
        self.total = math.log(max(sum(weights.values()) if total is None else total, 1.0))
        self.trie = ahocorasick.Automaton()
        for word, weight in weights.items():
            if word and weight > 0:
                self.trie.add_word(word, (len(word), math.log(weight) - self.total))
        self.trie.make_automaton()

    def cut(self, text: str) -> list[str]:
        n = len(text)
        edges: list[list] = [[] for _ in range(n)]
        if len(self.trie):
            for end, (size, score) in self.trie.iter(text):
                edges[end - size + 1].append((end + 1, score))
        stop = list(range(1, n + 1))
        for m in _RUN.finditer(text) if self.runs else ():
            stop[m.start() : m.end()] = [m.end()] * (m.end() - m.start())
        best, step = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            score, to = best[stop[i]] - self.total, stop[i]
            for end, own in edges[i]:
                if (own + best[end], end) > (score, to):
                    score, to = own + best[end], end
            best[i], step[i] = score, to
        out, at = [], 0
        while at < n:
            out.append(text[at : step[at]])
            at = step[at]
        return out


def _weighed(words: DataFrame | None, names: DataFrame | None, name_weight: float) -> DataFrame | None:
    """``word, weight``, each word once; None if neither is given."""
    parts = []
    if words is not None:
        parts.append(words.select(F.col("word"), F.col("weight").cast("double").alias("weight"), F.lit(0).alias("named")))
    if names is not None:
        parts.append(names.select(F.col("name").alias("word"), F.lit(float(name_weight)).alias("weight"), F.lit(1).alias("named")))
    if not parts:
        return None
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return both.where("length(word) > 0 and weight > 0").groupBy("word").agg(F.max(F.struct("named", "weight")).alias("m")).select("word", F.col("m.weight").alias("weight"))


def weights_of(words: DataFrame | None, names: DataFrame | None, name_weight: float = NAME_WEIGHT) -> dict[str, float]:
    """The dictionary ``words(word, weight)`` and ``names(name)``, which weigh ``name_weight`` whatever else they weigh.
    It must have at most ``MOST`` characters, which is checked before it is gathered."""
    both = _weighed(words, names, name_weight)
    if both is None:
        return {}
    size = both.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("n")).first()["n"]
    if size > MOST:
        raise ValueError(f"a dictionary of {size} characters is more than tasks may hold ({MOST})")
    return {r["word"]: r["weight"] for r in both.toLocalIterator()}


def _pieces(sizes: list[int]):
    """(text, word): each text's distinct pieces of the lengths that words have, the text by its number."""

    def run(batches):
        for batch in batches:
            for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for size in sizes:
                    if size > len(text):
                        break
                    found = list({text[i : i + size] for i in range(len(text) - size + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array(found, pa.string())], names=["number", "word"])

    return run


def cut_texts(rows: DataFrame, text: str, words: DataFrame | None, names: DataFrame | None = None, least: int = 2, runs: bool = True, name_weight: float = NAME_WEIGHT) -> DataFrame:
    """``rows`` with ``tokens``, as :func:`dictionary_tokens` cuts their ``text``, by a dictionary of any size.

    A text's pieces of every length that some word has are joined with the words; only those found are gathered, for one
    text. Equal texts are cut once; null and empty texts have no tokens.
    """
    spark, root = rows.sparkSession, work_dir(rows.sparkSession)
    texts = rows.select(F.col(text).alias("text")).where("length(text) > 0").distinct()
    texts = settle(texts.withColumn("number", F.monotonically_increasing_id()), f"{root}/texts")
    both = _weighed(words, names, name_weight)
    both = spark.createDataFrame([], "word string, weight double") if both is None else settle(both, f"{root}/words")
    total = both.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("n")).first()["n"]
    longest = texts.agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    sizes = sorted(r["n"] for r in both.select(F.length("word").alias("n")).where(F.col("n") <= longest).distinct().collect())  # numbers, a few for each order of size
    met = texts.mapInArrow(_pieces(sizes), "number long, word string").join(both, "word")
    found = met.groupBy("number").agg(F.collect_list("word").alias("words"), F.collect_list("weight").alias("weights"))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, words: pd.Series, weights: pd.Series) -> pd.Series:
        own = lambda t, w, n: Lattice(dict(zip(w, n, strict=True)) if w is not None else {}, runs, total).cut(t)
        return pd.Series([[w.lower() for w in own(*x) if len(w) >= least and w.strip()] for x in zip(texts, words, weights, strict=True)])

    done = texts.join(found, "number", "left").select(F.col("text").alias("_t"), cut("text", "words", "weights").alias("tokens"))
    return rows.join(done, F.col(text) == F.col("_t"), "left").drop("_t").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


_lattices: dict[str, Lattice] = {}


def dictionary_tokens(weights: dict[str, float], sc, least: int = 2, runs: bool = True) -> Callable[[Column], Column]:
    """A tokenizer over a dictionary, to stand wherever ``segment.tokens`` does: the best path's pieces, lower-cased,
    without those of white space or of fewer than ``least`` characters. Null is an empty list."""
    import uuid

    held, key = sc.broadcast(weights), uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        if key not in _lattices:
            _lattices.clear()
            _lattices[key] = Lattice(held.value, runs)
        lattice = _lattices[key]
        return pd.Series([[w.lower() for w in lattice.cut(t) if len(w) >= least and w.strip()] if t else [] for t in texts])

    return lambda c: cut(c)
