"""A card store: whole versions or nothing, attempts apart, older versions until they are swept."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmill.sources import cardstore

SCHEMA = "rel_path string, content string"


def rows(spark, *pairs, parts=3):
    return spark.createDataFrame(list(pairs), SCHEMA).repartition(parts)


def held(spark, root, version=None):
    return {r.rel_path: (r.content, r.version) for r in cardstore.load(spark, root, version).collect()}


def parts_of(root):
    folder = root / "parts"
    return sorted(p.name for p in folder.iterdir()) if folder.exists() else []


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert held(spark, root) == {}
    cardstore.save(rows(spark, ("facts/a.md", "甲\n"), ("facts/b.md", None), ("own.md", "x")), root)
    assert held(spark, root) == {"facts/a.md": ("甲\n", 1), "facts/b.md": ("", 1), "own.md": ("x", 1)}
    cardstore.save(rows(spark, ("facts/a.md", "new"), ("facts/a.md", "and"), ("facts/c.md", "c")), root)
    assert held(spark, root) == {"facts/a.md": ("new", 2), "facts/b.md": ("", 1), "own.md": ("x", 1), "facts/c.md": ("c", 2)}
    cardstore.save(rows(spark, ("z.md", "z")), root, "overwrite")
    assert held(spark, root) == {"z.md": ("z", 3)}
    assert held(spark, root, 1)["facts/a.md"] == ("甲\n", 1)
    cardstore.export(spark, root, str(tmp_path / "tree"))
    assert [p.name for p in (tmp_path / "tree").rglob("*.md")] == ["z.md"]
    assert cardstore.vacuum(spark, root) > 0
    assert len(parts_of(tmp_path / "store")) == 1 and held(spark, root) == {"z.md": ("z", 3)}
    cardstore.save(spark.createDataFrame([], SCHEMA), root, "overwrite")
    assert held(spark, root) == {}


def test_a_job_that_fails_half_way_leaves_the_former_cards(spark, tmp_path):
    root = str(tmp_path / "store")
    cardstore.save(rows(spark, ("a.md", "a")), root)
    before = parts_of(tmp_path / "store")
    ids = spark.range(40).repartition(4)
    bad = ids.select(F.concat(F.lit("n"), "id", F.lit(".md")).alias("rel_path"), F.when(F.col("id") == 37, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        cardstore.save(bad, root, "overwrite")
    assert held(spark, root) == {"a.md": ("a", 1)} and parts_of(tmp_path / "store") == before
    with pytest.raises(Exception, match="not a path below"):
        cardstore.save(rows(spark, ("ok.md", "x"), ("../out.md", "x")), root, "overwrite")
    assert not (tmp_path / "store/parts/out.md").exists()
    assert held(spark, root) == {"a.md": ("a", 1)} and parts_of(tmp_path / "store") == before


def test_an_attempt_that_is_tried_again_leaves_no_stray_file(spark, tmp_path):
    root = f"file:{tmp_path}/store"
    writer = cardstore._Writer(root, False)

    def broken():
        yield Row(rel_path="stray.md", content="x")
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(broken())
    twice = [writer.write(iter([Row(rel_path="a.md", content="a")])) for _ in range(2)]  # the second one speculative
    assert len(parts_of(tmp_path / "store")) == 3
    writer.commit([twice[1], None])
    assert parts_of(tmp_path / "store") == [twice[1].part]
    assert held(spark, root) == {"a.md": ("a", 1)}


def test_a_writer_that_comes_late_is_refused(spark, tmp_path):
    root = f"file:{tmp_path}/store"
    slow = cardstore._Writer(root, True)
    note = slow.write(iter([Row(rel_path="slow.md", content="s")]))
    cardstore.save(rows(spark, ("fast.md", "f")), root)
    with pytest.raises(cardstore.StoreChanged):
        slow.commit([note])
    assert held(spark, root) == {"fast.md": ("f", 1)} and note.part not in parts_of(tmp_path / "store")


def test_a_large_part_is_read_in_shares(spark, tmp_path, monkeypatch):
    root = f"file:{tmp_path}/store"
    cardstore.save(spark.range(50).select(F.concat(F.lit("d/"), "id", F.lit(".md")).alias("rel_path"), F.col("id").cast("string").alias("content")).coalesce(1), root)
    monkeypatch.setattr(cardstore, "CARDS_PER_TASK", 7)
    reader = cardstore._Reader(root, None)
    shares = reader.partitions()
    assert len(shares) >= 8
    assert sorted(int(c) for p in shares for _, c, _ in reader.read(p)) == list(range(50))
