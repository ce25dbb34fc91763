import random
import re
from collections import Counter, defaultdict
from itertools import count
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quillmill.llm import divergence
from quillmill.llm.divergence import RadixTrie, merge_leaves, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    docs, n, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = TERM.findall(text.translate(UPPER))
        groups.add((lang, source))
        docs.update((lang, w) for w in set(words))
        n[lang, source].update(words)
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted((w for (x, w), c in docs.items() if x == lang and c >= least), key=str.encode)
        own = sorted(s for x, s in groups if x == lang)
        share = lambda c: [1 + 10**9 * (c[w] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for w in kept]
        p = {s: share(n[lang, s]) for s in own}
        q = share(sum((n[lang, s] for s in own), Counter()))
        far = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in own:
            pairs = [(sum(map(far, p[s], p[o])), o) for o in own if o != s]
            terms = [(far(a, b), w) for w, a, b in zip(kept, p[s], q, strict=True) if n[lang, s][w] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(found[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, x, s, "z", 1) for t, x, s in rows], "text string, lang string, source string, term string, value long").repartition(6)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    words = [rng.choice(["a", "ab", "abc", "Zoë", "naïve", "Été", "日本語", "ß", "x" * 400]) + rng.choice(["", "b", "c", "ü", "zz"]) for _ in range(60)] + ["Rare1", "other2word"]
    rows = [(None, None, None), ("", "en", None), ("only here", "xx", "s"), ("only here", "xx", "t"), ("1 2 !!", "yy", "s"), ("ab " * 30_000, "en", "s0")]
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = "hot" if rng.random() < 0.35 else f"s{rng.randint(0, 8)}"
        rows.append((" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 30))), lang, source))
    return rows + rows[20:30]


def test_equals_brute_force(spark):
    rows = rows_of(3)
    assert sorted(tuple(r) for r in source_divergence(frame(spark, rows)).collect()) == brute(rows)


def test_many_blocks_buckets_and_tries(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "BUCKET", 7)
    rows = rows_of(4, 200)
    assert sorted(tuple(r) for r in source_divergence(frame(spark, rows)).collect()) == brute(rows)


def test_empty_table(spark):
    assert source_divergence(frame(spark, [])).count() == 0


def test_trie_walks_in_order_of_bytes():
    rng = random.Random(1)
    terms = {bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(1, 9))) for _ in range(2000)}
    trie = RadixTrie(count())
    leaf = {t: trie.leaf(t) for t in rng.sample(sorted(terms), len(terms))}
    assert [trie.leaf(t) for t in terms] == [leaf[t] for t in terms]
    assert list(trie.walk()) == [(t, leaf[t]) for t in sorted(terms)]


def test_tries_that_are_cut_off_merge_to_the_same_leaves(monkeypatch):
    texts, langs, sources = zip(*[(t, x or "", s or "") for t, x, s in rows_of(5, 300)], strict=True)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "lang": pa.array(langs), "source": pa.array(sources)})
    monkeypatch.setattr(divergence, "STEP_BYTES", 2000)

    every = np.full(1 << divergence.FILTER_BITS >> 3, 255, np.uint8)

    def merged(leaves):
        monkeypatch.setattr(divergence, "LEAVES", leaves)
        t = pa.Table.from_batches(list(divergence._count(SimpleNamespace(value=every))([batch])))
        t = merge_leaves(t.sort_by([("lang", "ascending"), ("term", "ascending")]))
        return len(t), [(r["lang"], r["term"], r["docs"], sorted(zip(r["sources"], r["counts"], strict=True))) for r in t.to_pylist()]

    assert merged(20) == merged(1 << 30)


def test_the_filter_drops_no_term_that_is_kept(spark):
    rows = [(f"own{chr(97 + i // 26)}{chr(97 + i % 26)} shared", "en", "s") for i in range(300)] + [("ten", "en", "s")] * 10 + [("nine", "en", "s")] * 9
    df = frame(spark, rows).select("lang", "text")
    bits = divergence.often_filter(df, 10)
    terms = pa.array([b"shared", b"ten", b"nine", b"ownaa"], pa.binary())
    k = divergence.buckets_of(terms, ["en"], np.arange(4))
    assert [int(bits[x >> 3] >> (7 - (x & 7)) & 1) for x in k.tolist()] == [1, 1, 0, 0]
