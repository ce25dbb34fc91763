"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. A word that training never saw falls back to its longest
character n-grams that training did see, then to shorter ones. The model is fitted on a sample of labelled rows of
about ``DOCS_PER_LANG`` a language, chosen by hash; it keeps every word and n-gram of that sample, so its size follows
the sample and not the corpus. Prediction covers every row and every word.

Words are runs of letters, lower-cased. A batch is split by Arrow, and each distinct word of it is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import in_steps, leave, mix, release, string_hashes, tidy

DOCS_PER_LANG, LONGEST = 4000, 4
#: Words whose evidence sets the score; more words don't make it surer.
EVIDENCE = 20
#: Letters or words that one vectorised step takes at once; bounds the scratch arrays, not the words or texts.
STEP = 1 << 18
UNDETERMINED = "und"
_SLOTS = np.random.default_rng(71).integers(1, 1 << 63, LONGEST, dtype=np.uint64) | np.uint64(1)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of its word for every word of all texts in order, the distinct words, each text's first word and the end)."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+")
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    coded = split.flatten().dictionary_encode()
    index, at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), split.offsets.to_numpy()
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # texts begin or end with no letter
    keep = real[index] if len(index) else np.zeros(0, bool)
    at = np.concatenate(([0], np.cumsum(keep)))[at - at[0]]
    new = np.cumsum(real) - 1
    return new[index[keep]], coded.dictionary.filter(pa.array(real)), at


def _count_words(batches):
    """(lang, word, n) of each batch."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        index, words, at = words_of(batch.column("text"))
        code = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at)) * max(1, len(words)) + index
        pair, n = np.unique(code, return_counts=True)
        names = lang.dictionary.take(pa.array(pair // max(1, len(words))))
        yield pa.RecordBatch.from_arrays([names.cast(pa.string()), words.take(pa.array(pair % max(1, len(words)))), pa.array(n, pa.int64())], names=["lang", "word", "n"])


class Letters:
    """The letters of words, each put between ^ and $, end to end."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32)
        self.size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))

    def grams(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(64-bit hash, word) of every n-gram, in steps."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        for a in range(0, len(self.codes), STEP):
            z = min(a + STEP, len(self.codes) - n + 1)
            if z <= a:
                break
            h = np.full(z - a, n, np.uint64)
            for k in range(n):
                h += self.codes[a + k : z + k].astype(np.uint64) * _SLOTS[k]
            inside = word[a:z] == word[a + n - 1 : z + n - 1]
            yield mix(h[inside]), word[a:z][inside]


class Table:
    """Counts by 64-bit key, a column a language, added in parts; then rows of log frequencies, found by key."""

    def __init__(self, columns: int):
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, columns))
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append(summed(keys, counts))
        if sum(len(k) for k, _ in self.parts) > max(4 * STEP, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        self.keys, self.rows = summed(np.concatenate([self.keys, *[k for k, _ in self.parts]]), np.concatenate([self.rows, *[c for _, c in self.parts]]))
        self.parts = []

    def close(self) -> None:
        """From counts to log frequencies, with add-half smoothing."""
        self.merge()
        if len(self.keys):
            self.rows += 0.5
            self.rows = np.log(self.rows) - np.log(self.rows.sum(axis=0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is held, its row)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's rows."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first, axis=0)


class Model:
    """Log frequencies by language, in the order of ``langs``: of words, and of n-grams of 1, 2, ... letters. A table holds
    its keys as hashes, so a model is a few arrays, whatever words it knows."""

    def __init__(self, counts, longest: int = LONGEST):
        """From (word, language, how often), as a table or a list of rows."""
        if not isinstance(counts, pa.Table):
            columns = list(zip(*counts, strict=True)) or [[], [], []]
            counts = pa.table({"word": pa.array(columns[0], pa.string()), "lang": pa.array(columns[1], pa.string()), "n": pa.array(columns[2], pa.int64())})
        self.langs = sorted(pc.unique(counts["lang"]).to_pylist())
        self.words, self.grams = Table(len(self.langs)), [Table(len(self.langs)) for _ in range(longest)]
        for batch in counts.to_batches(max_chunksize=max(1, STEP // 8)):
            lang = pc.index_in(batch.column("lang"), value_set=pa.array(self.langs, pa.string())).to_numpy(zero_copy_only=False)
            each = np.zeros((batch.num_rows, len(self.langs)))
            each[np.arange(batch.num_rows), lang] = batch.column("n").to_numpy()
            self.words.add(string_hashes(batch.column("word")), each)
            letters = Letters(batch.column("word").to_pylist())
            for n, t in enumerate(self.grams, 1):
                for h, word in letters.grams(n):
                    t.add(h, each[word])
        for t in (self.words, *self.grams):
            t.close()

    def backed_off(self, words: list[str]) -> np.ndarray:
        """A row each: the mean over a word's longest n-grams that training saw; zeros if it saw none of any length."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for n in range(len(self.grams), 0, -1):
            t = self.grams[n - 1]
            if not len(left) or not len(t.keys):
                continue
            hits, total = np.zeros(len(left)), np.zeros((len(left), len(self.langs)))
            for h, word in Letters([words[i] for i in left]).grams(n):
                seen, at = t.find(h)
                hits += np.bincount(word[seen], minlength=len(left))
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(word[seen], t.rows[at[seen], k], len(left))
            some = hits > 0
            out[left[some]] = total[some] / hits[some, None]
            left = left[~some]
        return out

    def rows_of(self, words: pa.Array) -> np.ndarray:
        """A row of log frequencies for each distinct word."""
        known, at = self.words.find(string_hashes(words))
        out = np.zeros((len(words), len(self.langs)))
        out[known] = self.words.rows[at[known]]
        if not known.all():
            out[~known] = self.backed_off(words.filter(pa.array(~known)).to_pylist())
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and score of each text: ``und`` and 0 for no letter or no model."""
        index, words, at = words_of(texts)
        n = np.diff(at)
        if not self.langs:
            return [UNDETERMINED] * len(n), np.zeros(len(n))
        rows, total, owner = self.rows_of(words), np.zeros((len(n), len(self.langs))), np.repeat(np.arange(len(n)), n)
        for a in range(0, len(index), STEP):
            mine = owner[a : a + STEP]
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            total[mine[first]] += np.add.reduceat(rows[index[a : a + STEP]], first, axis=0)
        total = (total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
        p = np.exp(total)
        best = p.argmax(axis=1)  # ties: the first language in alphabetical order
        score = np.where(n > 0, p[np.arange(len(n)), best] / p.sum(axis=1), 0.0)
        return [self.langs[k] if some else UNDETERMINED for k, some in zip(best, n > 0, strict=True)], score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit on labelled rows that aren't held out, about ``docs_per_lang`` a language (fewer if there are fewer). Null
    ids, texts and labels take no part; rows that repeat an id are sampled or left together; no rows give a model that
    answers ``und``."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = base.where(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull())
    have = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not have:
        return Model([])
    share = F.lit(0.0)
    for lang, n in have.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / n))).otherwise(share)
    u = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    picked = train.where((u < share) & F.col("text").isNotNull()).select("lang", "text")
    counts = picked.mapInArrow(tidy(_count_words), "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return Model(counts.toArrow())  # its rows follow the sample


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, one row per input row. A text that is null or holds no letter is
    ``und`` with score 0; equal odds go to the first language in alphabetical order; repeated rows get equal answers;
    a text of any length is read whole; an empty table gives no rows. Columns of those two names are replaced; every other column stays."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def guess(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        leave()
        m = held.value
        for texts in arrays:
            lang, score = [], []
            for a, z in in_steps(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)):
                x, y = m.predict(texts.slice(a, z - a))
                lang += x
                score.append(y)
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])
        release()

    guess = F.arrow_udf(guess, "lang_pred string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_g", guess(F.col(text_col).cast("string"))).select(*kept, "_g.lang_pred", "_g.score")
