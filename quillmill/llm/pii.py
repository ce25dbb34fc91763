"""Personal data by weak supervision, in DataFrame operations only.

Four exact patterns (email, ip, card, phone) with checks give the base spans. Candidates beyond them are opaque strings
("secret") and digit runs ("number") that no base span covers. Labelers vote on each candidate from its shape (regex),
the word before it (gazetteer) and the signs around it (context), or abstain. Votes form a table of at most
``3**labelers`` patterns a kind, counted over all documents; expectation-maximisation on those counts estimates each
labeler's reliability, and the posteriors train a naive-Bayes span classifier on coarse features, again from counts.
Its positives are added to the base spans. Only those two bounded count tables reach the driver.

Patterns are written so that Java's matcher loops rather than recurses and tries no start twice: possessive repeats,
and a start only after the previous match or where no character of the class precedes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import settle, work_dir

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?:\G|(?<![0-9A-Za-z_]))(?=[A-Za-z_]*+[0-9])[0-9A-Za-z_]{16,}+",
}
#: Cheap tests without which the full pattern can't match.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "secret": r"[0-9A-Za-z_]{16}"}
#: Words that announce an identifier or a secret.
GAZETTEER = ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "apikey", "api", "auth", "credential", "account", "iban", "ssn", "card", "passport", "id", "tel", "phone", "mobile", "customer", "clave", "contraseña", "konto", "passwort", "schlüssel", "compte", "cuenta", "jeton")
#: Characters of context that labelers see on either side.
CONTEXT = 24
LABELERS = ("regex", "gazetteer", "context", "company")
EM_ROUNDS = 60
PLACEHOLDER = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>", "number": "<NUMBER>"}


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m>>: code points from 0, end exclusive."""
    p = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, p, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    gaps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("n"), m.alias("m")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<s:bigint,e:bigint,m:string>>)").alias("out"))
    walked = F.aggregate(gaps, zero, lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["n"]).alias("e"), x["m"].alias("m"))).alias("out")))
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint,m:string>>)")
    return F.when(text.rlike(GATES[kind]), walked["out"]).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: F.expr("0") + F.coalesce(F.try_to_number(x, F.lit("9")).cast("int"), F.lit(0)))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(F.left(_digits(m), F.lit(19)))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, order: int) -> Column:
    kept = F.filter(matches(text, kind), lambda x: valid(kind, x["m"]))
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _candidates(text: Column, base: Column) -> Column:
    """Spans that no base span overlaps, with votes and features: array<struct<s, e, kind, votes, f>>."""

    def of(kind: str, found: Column) -> Column:
        free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.transform(free, lambda x: _judged(text, base, kind, x))

    secret = F.filter(matches(text, "secret"), lambda x: x["m"].rlike("[A-Za-z]"))
    number = F.filter(matches(text, "card"), lambda x: F.length(_digits(x["m"])) >= 7)
    alone = F.filter(number, lambda x: ~F.exists(secret, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.concat(of("secret", secret), of("number", alone))


def _judged(text: Column, base: Column, kind: str, x: Column) -> Column:
    """A candidate with its labelers' votes (1 yes, 0 no, null abstains) and its coarse features."""
    m = x["m"]
    left = F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(x["s"], F.lit(CONTEXT)).cast("int"))
    right = F.substring(text, x["e"].cast("int") + 1, F.lit(2))
    n, digits = F.length(m), F.length(_digits(m))
    word = F.lower(F.regexp_extract(left, r"([\p{L}]+)[^\p{L}0-9]{0,4}$", 1))
    sign = F.regexp_extract(left, r"([=:#\"'(])\s?$", 1)
    if kind == "secret":
        hexed = m.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & n.isin(32, 40, 48, 56, 64, 96, 128)
        shape = F.when(hexed | ((digits >= 4) & (n - digits >= 4)), 1).when(digits < 3, 0)
    else:
        shape = F.when(digits.between(12, 19), 1).when(digits > 34, 0)
    votes = F.struct(
        shape.alias("v_regex"),
        F.when(word.isin(*GAZETTEER), 1).when(word != "", 0).alias("v_gazetteer"),
        F.when((sign != "") & right.rlike(r"^[\"'\s;,)]|^$"), 1).when(left.rlike(r"\p{L}[ ,.]+$"), 0).alias("v_context"),
        F.when(F.size(base) >= 2, 1).alias("v_company"),
    )
    features = F.struct(
        F.least(F.floor(F.log2(n)), F.lit(7)).cast("string").alias("f_size"),
        F.floor(F.lit(4) * digits / n).cast("string").alias("f_digits"),
        F.when(sign != "", sign).otherwise(F.lit("-")).alias("f_sign"),
        F.when(word.isin(*GAZETTEER), word).otherwise(F.lit("-")).alias("f_word"),
    )
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), votes.alias("votes"), features.alias("f"))


VOTES = [f"v_{x}" for x in LABELERS]
FEATURES = ["f_size", "f_digits", "f_sign", "f_word"]


def fit_votes(counts: list[tuple[tuple, int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[float, float]], dict]:
    """Expectation-maximisation over (vote pattern, count): the prior, each labeler's (P(1|yes), P(1|no)) among its
    votes, and the posterior of each pattern. Plain arithmetic on at most a few hundred patterns."""
    n = len(LABELERS)
    prior, rel = 0.5, [(0.8, 0.2)] * n
    post: dict = {}
    for _ in range(rounds):
        for p, _c in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (a, b) in zip(p, rel, strict=True):
                if v is not None:
                    yes += math.log(a if v else 1 - a)
                    no += math.log(b if v else 1 - b)
            post[p] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(c for _, c in counts)
        prior = min(0.95, max(0.05, (sum(c * post[p] for p, c in counts) + 1) / (total + 2)))
        rel = []
        for k in range(n):
            one = [sum(c * w(p) for p, c in counts if p[k] == 1) for w in (lambda p: post[p], lambda p: 1 - post[p])]
            all_ = [sum(c * w(p) for p, c in counts if p[k] is not None) for w in (lambda p: post[p], lambda p: 1 - post[p])]
            a, b = (one[0] + 4) / (all_[0] + 5), (one[1] + 1) / (all_[1] + 5)
            rel.append((max(a, b), min(a, b)))  # a labeler is taken to be no worse than chance
    return prior, rel, post


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``(id, base, added)``: spans as array<struct<s, o, e, kind>> in order of start, then kind.

    One row per input row. A null text counts as empty and has no spans; ids may be null or repeated, and
    repeated rows each get the same spans; a text of any length is searched whole; an empty table gives no rows. With ``keep``, the text and those columns of ``docs`` come along as struct ``row``; other columns
    are ignored.
    """
    root = work_dir(docs.sparkSession)
    along = [] if keep is None else [F.struct(F.col(text_col).alias("text"), *[F.col(c) for c in keep if c != "text"]).alias("row")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *along)
    rows = rows.withColumn("base", F.array_sort(F.concat(*[_spans(F.col("t"), k, i) for i, k in enumerate(KINDS)])))
    rows = rows.withColumn("cand", _candidates(F.col("t"), F.col("base"))).drop("t")
    found = settle(rows, f"{root}/found")

    cands = found.select(F.explode("cand").alias("c")).select("c.kind", "c.votes.*", "c.f.*")
    table = settle(cands.groupBy("kind", *VOTES, *FEATURES).count(), f"{root}/votes")
    votes: dict = {}
    for r in table.groupBy("kind", *VOTES).agg(F.sum("count").alias("n")).collect():
        votes.setdefault(r[0], []).append((tuple(r[1:-1]), r["n"]))
    posterior = {f"{kind}|{p}": q for kind, mine in votes.items() for p, q in fit_votes(mine)[2].items()}
    key = F.concat(F.col("kind"), F.lit("|("), F.array_join(F.array(*[F.coalesce(F.col(v).cast("string"), F.lit("None")) for v in VOTES]), ", "), F.lit(")"))
    soft = table.withColumn("yes", _lookup(posterior, key) * F.col("count")).withColumn("no", F.col("count") - F.col("yes"))
    values = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])
    seen = soft.select("kind", F.explode(values).alias("x"), "yes", "no").groupBy("kind", "x.f", "x.v").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    weights = naive_bayes([tuple(r) for r in seen])

    def score(c: Column) -> Column:
        parts = [_lookup(weights, F.concat(c["kind"], F.lit(f"|{f}|"), c["f"][f])) for f in FEATURES]
        return sum(parts, _lookup(weights, F.concat(c["kind"], F.lit("|"))))

    good = F.filter("cand", lambda c: score(c) > 0)
    added = F.array_sort(F.transform(good, lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS)).alias("o"), c["e"].alias("e"), c["kind"].alias("kind"))))
    return found.withColumn("added", added).drop("cand")


def _lookup(table: dict[str, float], key: Column) -> Column:
    """table[key], or 0: a literal map, bounded by the patterns and feature values there are."""
    if not table:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(0.0))


def naive_bayes(seen: list[tuple[str, str, str, float, float]]) -> dict[str, float]:
    """Log odds: ``kind|`` for the prior, ``kind|feature|value`` for each value, from soft counts of yes and no."""
    out: dict[str, float] = {}
    for kind in {r[0] for r in seen}:
        for f in FEATURES:
            mine = [r for r in seen if r[:2] == (kind, f)]
            y, n, k = sum(r[3] for r in mine), sum(r[4] for r in mine), len(mine)
            out[f"{kind}|"] = math.log((y + 1) / (n + 1))
            for r in mine:
                out[f"{kind}|{f}|{r[2]}"] = math.log((r[3] + 0.5) / (y + 0.5 * k)) - math.log((r[4] + 0.5) / (n + 0.5 * k))
    return out


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *map(n, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span (sorted by start) replaced by its kind's placeholder; overlapping spans become the
    first one's. A null text stays null."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    mark = lambda k: _mark(k)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, F.greatest(x["s"] - acc["at"], F.lit(0)).cast("int"))
        new = F.when(x["s"] >= acc["at"], F.concat(acc["out"], gap, mark(x["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), new.alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))


def _mark(kind: Column) -> Column:
    out = F.lit("<PII>")
    for k, v in PLACEHOLDER.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out
