import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillmill.llm import byte_words
from quillmill.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, least=20, share=25):
    code = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(code(f) for _, t in rows for f in features(t)[1])
    t = Counter(code(f) for x in target for f in features(x)[1])
    out, able = {}, []
    for k, (i, text) in enumerate(rows):
        n, fs = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * float(s.total() + 10000) / ((s[b] + 1.0) * float(t.total() + 10000)))) for b in map(code, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[k] = (i, n, len(fs), weight, score)
        if n >= least:
            able.append((-score, i is None, i or 0, k))
    rank = {k: r + 1 for r, (*_, k) in enumerate(sorted(able)) if r < len(able) * share // 100}
    return sorted(((*v, rank.get(k)) for k, v in out.items()), key=str)


def test_words_and_crcs_of_awkward_bytes():
    texts = ["", "A1 b-é̈ c", None, "x" * 300 + " " + "日本" * 60, "end", "\x7f\x00a\x60b{", "y"]
    column = pa.array(["cut", *texts]).slice(1)
    got = []
    for _, _, data, offsets in byte_words.steps(column, 40):
        for start, crc in byte_words.run_crcs(data, *byte_words.spans(data, offsets, byte_words.ALNUM), 3):
            got += crc.tolist()
    want = [zlib.crc32(f.encode()) for t in texts for f in features(t, 3)[1]]
    assert sorted(got) == sorted(want) and len(got) > 12
    assert byte_words.CRC[1] == 0x77073096 and byte_words.CRC.dtype == np.uint32


def test_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Straße", "NAÏVE", "日本"]
    rows = [(None, "nothing"), (1, None), (2, ""), (3, "!!"), (4, "Ab " * 19), (5, "ab " * 20), (6, "z" * 5000 + " long " + "q " * 4000), (None, "same " * 25)]
    rows += [(10 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(200)]
    rows += [(400, "a b c d e f g h i j k l m n o p q r s t u")] * 3  # rows that repeat throughout, and so tie
    target = [" ".join(rng.choices(words[:40], k=50)) for _ in range(5)] + [None]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, rank int").repartition(5)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted((tuple(r) for r in got.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(r["weight"] for r in resample(some, none).collect())[1] == 0
