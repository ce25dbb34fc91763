import hashlib
import random

from quillmill.llm import merkle
from quillmill.llm.merkle import compare_edits, edited, fingerprint_texts, fingerprints, first_difference, likeness, pieces, tree


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "é", "日本", "x.", "y!", "\n", "\n\n", "\t"] + [f"w{i}" for i in range(400)]
    out = ["", " ", "\n\n \n", "a", "ab", "\nlead", "trail \n\n", "one two\nthree\n\nfour. five"]
    return out + [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(n)]


def plain(text):
    """The tree built a word at a time over one text alone."""
    raw = text.encode()
    if not raw:
        return []
    white = b" \t\n\x0b\x0c\r"
    cuts, i = [], 0
    data, begin, end, level, _ = pieces([text])
    while i < len(raw):
        while i < len(raw) and raw[i] in white:
            i += 1
        while i < len(raw) and raw[i] not in white:
            i += 1
        stop = i
        while i < len(raw) and raw[i] in white:
            i += 1
        cuts.append((i, raw[stop:i].count(b"\n"), raw[stop - 1 : stop] in (b".", b"!", b"?")))
    must = {at for at, lines, stop in cuts if lines or stop} | {len(raw)}
    assert must <= set(end) <= {at for at, _, _ in cuts}
    return [raw[a:b] for a, b in zip(begin, end, strict=True)]


def test_pieces_join_up_and_depend_on_their_text_alone():
    texts = texts_of(2)
    data, begin, end, level, before = pieces(texts)
    for i, t in enumerate(texts):
        here = slice(before[i], before[i + 1])
        assert b"".join(data[a:b] for a, b in zip(begin[here], end[here], strict=True)) == t.encode()
        alone = pieces([t])
        assert level[here] == alone[3] and [data[a:b] for a, b in zip(begin[here], end[here], strict=True)] == plain(t)
        assert not t or level[here][-1] == 2


def test_roots_test_equality_and_children_add_up():
    texts = list(dict.fromkeys(texts_of(3)))
    prints = fingerprints(texts)
    assert len(set(prints)) == len(texts) and fingerprints(texts[::-1]) == prints[::-1]
    assert len({tree(p)[0] for p in prints}) == len(texts)
    for t, p in zip(texts, prints, strict=True):
        found = pieces([t])
        assert sum(len(x[1]) for s in tree(p)[1] for x in s[1]) == len(found[1])
        assert likeness(p, p) == 1.0 and first_difference(p, p) is None


def test_an_edit_is_located_and_leaves_the_rest_alike():
    rng = random.Random(8)
    lines = [" ".join(f"v{rng.randint(0, 5000)}" for _ in range(30)) for _ in range(40)]
    text = "\n".join(lines[:20]) + "\n\n" + "\n".join(lines[20:])
    a, b, c = fingerprints([text, text.replace(lines[25], lines[25] + " changed"), text.replace(lines[3], "", 1)])
    at = first_difference(a, b)
    where = [s for s, x in enumerate(tree(a)[1]) for _ in x[1]]
    assert at.split(".")[0] == str(where[25]) and 0.97 < likeness(a, b) < 1 and 0.94 < likeness(a, c) < 1
    assert likeness(a, fingerprints(["nothing of the kind"])[0]) == 0.0 and likeness(a, fingerprints([""])[0]) == 0.0
    flat = lambda p: [k for s in tree(p)[1] for x in s[1] for k in x[1]]
    both = sum(min(flat(a).count(k), flat(b).count(k)) for k in set(flat(a)))
    assert abs(likeness(a, b) - 2 * both / (len(flat(a)) + len(flat(b)))) < 1e-12


def check(spark, rows, parts):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(tuple(r) for r in compare_edits(df).collect())
    rows = sorted(rows)
    want = []
    for k, (i, t) in enumerate(rows):
        t, f = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = edited(t, f)
        own, new_own, next_own = (fingerprints([x])[0] for x in (t, new, f))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), own, new_own, likeness(own, new_own), likeness(own, next_own), first_difference(own, new_own)))
    assert got == sorted(want)
    return got


def test_neighbours_across_parts_equal_brute_force(spark):
    rows = [(3 * i, t) for i, t in enumerate(texts_of(4, 150))]
    rows += [(1000, rows[40][1]), (1001, rows[40][1]), (1002, None), (1003, "w " * 40_000)]
    got = check(spark, rows, 5)
    same = next(r for r in got if r[0] == 1000)
    assert same[6] == 1.0
    long = [r for r in got if r[1] > 600 and len({r[3], r[4]}) == 2]
    assert sum(0.25 < r[5] < 0.75 for r in long) > 0.8 * len(long)


def test_one_row_follows_itself_and_empty_tables(spark):
    check(spark, [(7, "a b c d")], 1)
    check(spark, [(7, None), (9, "b c. d e")], 2)
    assert compare_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "p q"), (None, "p q"), (None, None), (1, "z")], "doc_id long, text string")
    assert compare_edits(odd).count() == 4
    assert {r["fingerprint"] for r in fingerprint_texts(odd).collect() if r["id"] is None} == set(fingerprints(["p q", ""]))


def test_edited_takes_code_points():
    assert edited("日本語é", "x") == "日本x" and edited("abcde", "uvwxyz") == "abcuv" and edited("a", "b") == "a"
    assert merkle.edited("", "b") == ""
