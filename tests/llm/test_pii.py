import hashlib
import random
import re

from pyspark.sql import functions as F

from quillmill.llm.pii import digest, find_pii, fit_votes, redact

KIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def brute(text):
    out = []
    for o, (k, p) in enumerate(KIND.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), o, f"{k}:{m.start()}:{m.end()}", k))
    return sorted(out)


CASES = [
    None, "", "a@b.c_d@e.f x..y@z.w.. a@b..c@d.e q@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4 1.1.1.999999999999999999999 é9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 5500005555555559 5500005555555558", "+1 (743) 555-3824 +1+2 345 678 90 12 +12 +44.20.7946.0958x +123456789012345678",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" end", "9" * 30000, "7 " * 9000, "a." * 9000 + "@b" + ".c" * 9000, "a" * 200000, "1." * 9000, "😀 é a@b.co 😀 10.0.0.1 ß +49 30 1234567",
]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    bits = ["a", "@", ".", "-", " ", "1", "25", "255", "4", "+", "(", ")", "_", "é", "😀", "\n", "b.c", "a@b.co", "10.0.0.1", "4111111111111111", "+1 743 555 3824"]
    texts = CASES + ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in digest(find_pii(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in want).encode()).hexdigest(), (t or "")[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in KIND]
        assert {x[2] for x in want} <= set(r.spans.split(","))


def test_secrets_are_added_and_redacted(spark):
    texts = [f"the auth of token = \"{random.Random(i).getrandbits(160):040x}\" is here with mail x{i}@ex.org" for i in range(60)]
    texts += [f"plain words number {i} and the weather report" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = find_pii(df, keep=("doc_id",)).select("row.*", "added", redact(F.col("row.text"), F.array_sort(F.concat("base", "added"))).alias("clean")).orderBy("doc_id").collect()
    assert all(len(r.added) == 1 and r.added[0].kind == "secret" for r in out[:60])
    assert all(r.added == [] and r.clean == r.text for r in out[60:])
    assert out[3].clean == "the auth of token = \"<SECRET>\" is here with mail <EMAIL>"


def test_votes_recover_reliabilities():
    rng = random.Random(1)
    counts = {}
    for _ in range(20000):
        y = rng.random() < 0.4
        p = tuple(None if rng.random() < 0.2 else int(y if rng.random() < a else not y) for a in (0.95, 0.85, 0.75, 0.6))
        counts[p] = counts.get(p, 0) + 1
    prior, rel, _ = fit_votes(list(counts.items()))
    assert abs(prior - 0.4) < 0.05 and abs(rel[0][0] - 0.95) < 0.05 and abs(rel[1][0] - 0.85) < 0.05


def test_empty_table(spark):
    assert digest(find_pii(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def planted(seed, n):
    """(text, spans that are secrets or account numbers) with decoys: long words, dates, prices, years, versions."""
    rng, out = random.Random(seed), []
    hexed = lambda k: f"{rng.getrandbits(4 * k):0{k}x}"
    mixed = lambda k: "".join(rng.choices("abcdefghijkmnpqrstuvwxyz", k=k // 2)) + "".join(rng.choices("0123456789", k=k - k // 2))
    secrets = [lambda: f'token = "{hexed(40)}"', lambda: f"api_key: {hexed(32)}", lambda: f'password="{mixed(20)}"', lambda: f"secret={mixed(24)};"]
    decoys = ["counterrevolutionary thoughts", "in the year 2024 and 1999", "it cost 1500 or 23000 coins", "version 1.20.300 came", "Donaudampfschifffahrtsgesellschaft", "room 101, floor 12", "see pages 100 to 2000"]
    for _ in range(n):
        words, want = [], []
        for _ in range(rng.randint(2, 6)):
            words.append(rng.choice(decoys))
            if rng.random() < 0.3:
                s = rng.choice(secrets)()
                core = re.search(r"[0-9a-z]{16,}", s)[0]
                want.append(core)
                words.append(s)
        out.append((" and then ".join(words) + f" mail q{rng.randrange(999)}@ex.org, 10.1.2.{rng.randrange(255)}", want))
    return out


def test_added_spans_find_planted_secrets_and_little_else(spark):
    docs = planted(7, 400)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    found = {r.id: [t[a.s : a.e] for a in r.added] for r in find_pii(df).select("id", "added").collect() for t in [docs[r.id][0]]}
    hit = sum(len(set(found[i]) & set(w)) for i, (_, w) in enumerate(docs))
    total, said = sum(len(set(w)) for _, w in docs), sum(len(set(x)) for x in found.values())
    assert total > 300
    assert hit >= 0.95 * total, (hit, total)
    assert hit >= 0.95 * said, (hit, said)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a@b.co", "x"), (None, None, "x"), (3, "a@b.co", "y"), (3, "a@b.co", "y"), (3, "", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kind string, base int")
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in digest(find_pii(df)).collect()), key=str)
    assert got == sorted([(None, 1, "email:0:6"), (None, 0, ""), (3, 1, "email:0:6"), (3, 1, "email:0:6"), (3, 0, "")], key=str)
