"""Queries against their SQL on texts that the test data doesn't have: empty ones, breaks at the end, rare characters."""

import duckdb

from quillmill.plans import registry, text_queries  # noqa: F401

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\f", "\x1c", "\x85", " ", " "]


def against_sql(spark, root, name, docs, bench=()):
    """The query's rows and its SQL's, sorted."""
    for table, key, texts in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").write.parquet(f"{root}/{table}.parquet")
        duckdb.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(root)).collect()
    return sorted(map(tuple, got)), sorted(duckdb.execute(registry.ORACLE_SQL[name]).fetchall())


def test_lines_without_adverts_count_an_empty_last_line(spark, tmp_path):
    texts = ["", None, "one line", *[f"one{b}" for b in BREAKS], *[f"one{b}{b}two{b}" for b in BREAKS], "a\nb\nc\nd\n", "see www.x\n\n", "\r\n\n\r"]
    got, want = against_sql(spark, tmp_path, "advert_free_lines", texts)
    assert got == want and (0, 0) in got and (3, 0) in got


ODD = ["end… yes and no more", "v1.2.34.", "a 3.5 b 4.5.", "10.0.0.12 is up.", "price 35 euros", "price 3.5 euros", "ΟΔΥΣΣΕΥΣ ΑΣ", "οδυσσευσ ασ.", "Izmir İİİİ", "izmir iiii!", "İİİİ!", "wait…… what…”he said", "1.2.3.4.5.6.7", "x y\x85z 1.5 abc", "", None, "\n", "....", "\U0001f600 four. \U00010400 DESERET one"]


def overlaps(spark, root, name):
    got, want = against_sql(spark, root, name, [*ODD, " ".join(t for t in ODD if t), "Before that. " + ODD[0]], [t for i, t in enumerate(ODD) if i % 2 == 0])
    assert len(want) > 8 and any(r[2] for r in want)
    return got, want


def test_exact_overlap_cuts_sentences_as_its_sql(spark, tmp_path):
    got, want = overlaps(spark, tmp_path, "exact_overlap")
    assert got == want


def test_normalized_overlap_cuts_and_lowers_as_its_sql(spark, tmp_path):
    got, want = overlaps(spark, tmp_path, "normalized_overlap")
    assert got == want
