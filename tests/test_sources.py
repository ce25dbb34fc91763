"""Files in and out: what is written is read back, and what can't be read is said."""

import json
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmill.operators import facts, prompts
from quillmill.sources import io


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_texts_in_several_encodings(spark, tmp_path):
    put(tmp_path / "a/one.txt", "第一章 起")
    put(tmp_path / "a/b/two.txt", b"\xef\xbb\xbfmark")
    put(tmp_path / "a/three.txt", "湖水".encode("gb18030"))
    put(tmp_path / "a/bad.txt", b"\xff\xff\xff")
    put(tmp_path / "a/other.md", "no")
    got = [(r.path.rpartition("/")[2], r.text) for r in io.read_any(spark, str(tmp_path / "a")).collect()]
    assert got == [("two.txt", "mark"), ("bad.txt", None), ("one.txt", "第一章 起"), ("three.txt", "湖水")]
    assert [r.text for r in io.read_strict(spark, str(tmp_path / "a/one.txt")).collect()] == ["第一章 起"]
    with pytest.raises(io.SourceError):
        io.read_strict(spark, str(tmp_path / "a/three.txt"))


def test_paths_and_configuration(spark, tmp_path):
    put(tmp_path / "x/new.txt", "t")
    assert io.first_existing(spark, [f"{tmp_path}/gone", f"{tmp_path}/x", f"{tmp_path}"]) == f"{tmp_path}/x"
    assert io.first_existing(spark, [f"{tmp_path}/gone"]) is None
    assert io.only_file(io.read_any(spark, f"{tmp_path}/x")).endswith("x/new.txt")
    put(tmp_path / "x/second.txt", "u")
    with pytest.raises(io.SourceError):
        io.only_file(io.read_any(spark, f"{tmp_path}/x"))
    put(tmp_path / "c.yaml", "model:\n  top_k: 3\n")
    put(tmp_path / "l.yaml", "- 1\n")
    assert io.read_config(str(tmp_path / "c.yaml")) == {"model": {"top_k": 3}}
    with pytest.raises(io.SourceError):
        io.read_config(str(tmp_path / "l.yaml"))


def test_cards_of_a_folder(spark, tmp_path):
    put(tmp_path / "bible/timeline.md", "left out")
    put(tmp_path / "bible/style.md", "---\nrevealed_in: 2\nvalid_from: 1\nvalid_to: null\ntitle: 'S'\n---\n\nbody")
    put(tmp_path / "bible/generated/characters/li.md", "---\nrevealed_in: 4\nvalid_from: x\n---\nLi")
    put(tmp_path / "bible/notes/timeline.md", "stays")
    got = [(r.doc_ord, r.source, r.text.strip(), r.depth_class, r.revealed_in, r.valid_from, r.valid_to) for r in io.read_cards(spark, str(tmp_path / "bible")).orderBy("doc_ord").collect()]
    assert got == [(0, "li", "Li", 1, 4, None, None), (1, "timeline", "stays", 2, None, None, None), (2, "style", "body", 0, 2, 1, None)]
    meta = spark.createDataFrame([("---\ntitle: 'S: x'\nkind: a\n# note\n- item\n---\nrest",)], ["t"]).select(io.header_map(F.col("t")).alias("m")).first().m
    assert meta == {"title": "S: x", "kind": "a"}


def test_json_lines_and_facts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "甲"), (2, None)], "n long, t string")
    io.write_jsonl(rows, f"{tmp_path}/j")
    io.write_jsonl(rows.where("n = 1"), f"{tmp_path}/j", mode="append")
    assert sorted(r.n for r in io.read_jsonl(spark, f"{tmp_path}/j", "n long, t string").collect()) == [1, 1, 2]
    put(tmp_path / "bad.jsonl", '{"n": 1}\n\n{oops\n')
    with pytest.raises(io.SourceError):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"))
    fact = {"id": "f1", "type": "event", "summary": "s", "chapter": 3, "entities": "one", "valid_from": "4", "confidence": 1}
    for body in ([fact], {"facts": [fact]}, {"entries": [fact]}):
        put(tmp_path / "facts.json", json.dumps(body))
        r = io.fact_columns(io.read_facts(spark, str(tmp_path / "facts.json"))).first()
        assert (r.id, r.chapter, r.entities, r.valid_from, r.confidence) == ("f1", 3, ["one"], None, 1.0)
    put(tmp_path / "facts.json", "[1]")
    with pytest.raises(io.SourceError):
        io.read_facts(spark, str(tmp_path / "facts.json"))


def test_the_fact_store_and_its_cards(spark, tmp_path):
    schema = "id string, title string, type string, chapter int, valid_from int, valid_to int, revealed_in int, confidence double, entities array<string>, summary string"
    assert io.read_store(spark, f"{tmp_path}/none", schema).count() == 0
    rows = spark.createDataFrame([("f/1", "T", "event", 1, 1, None, 1, 0.7, ["a"], "s")], schema)
    io.write_store(rows, f"{tmp_path}/store")
    assert io.read_store(spark, f"{tmp_path}/store", schema).collect() == rows.collect()
    rows.withColumn("schema_version", F.lit("else")).write.parquet(f"{tmp_path}/old")
    with pytest.raises(io.SourceError):
        io.read_store(spark, f"{tmp_path}/old", schema)
    put(tmp_path / "cards/facts/stale.md", "x")
    put(tmp_path / "cards/own.md", "x")
    io.write_cards(facts.fact_card(rows), f"{tmp_path}/cards", prune=True)
    assert sorted(str(p.relative_to(tmp_path / "cards")) for p in (tmp_path / "cards").rglob("*.md")) == ["facts/f_1.md", "own.md"]
    assert "kg_id: \"f/1\"" in (tmp_path / "cards/facts/f_1.md").read_text()


def test_reports_drafts_and_the_last_call(spark, tmp_path):
    io.write_report(spark.createDataFrame([Row(name="甲", n=1)]), f"{tmp_path}/r")
    files = list((tmp_path / "r").glob("part-*"))
    assert len(files) == 1 and json.loads(files[0].read_text()) == {"name": "甲", "n": 1} and "甲" in files[0].read_text()
    stamp = datetime(2024, 5, 6, 7, 8, 9).strftime("%Y%m%d_%H%M%S")
    uri = io.write_draft(spark, f"{tmp_path}/out", ["one", "二"], stamp)
    assert uri.endswith("out/draft_20240506_070809.txt") and (tmp_path / f"out/draft_{stamp}.txt").read_text() == "one\n\n二"
    io.write_last_call(spark, f"{tmp_path}/debug", {"model": "m", "messages": [{"role": "user", "content": "ask"}]}, "hm", "yes")
    assert (tmp_path / "debug/last_prompt.txt").read_text() == "[USER]\nask"
    assert json.loads((tmp_path / "debug/last_request.json").read_text())["model"] == "m"
    assert "[THINKING]\nhm" in (tmp_path / "debug/last_response.txt").read_text()
    plots = spark.createDataFrame([("p", '{"characters": [{"name": "A", "role": "r", "dev": "grows"}, {"name": "B"}], "plots": ["x", ""]}'), ("q", "none")], ["path", "text"])
    assert [tuple(r) for r in io.json_context(plots).orderBy("path").collect()] == [("p", "- A（r）：grows", "- x"), ("q", None, None)]


def test_calls_are_tried_again_and_kept(spark, tmp_path):
    log = str(tmp_path / "log")

    def model(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "never" or (prompt == "once" and open(log).read().count("once") < 2):
            raise TimeoutError
        return f"to {prompt}"

    rows = spark.createDataFrame([("k1", "plain"), ("k2", "once"), ("k3", "never")], "key string, prompt string").coalesce(1)
    got = {r.key: (r.response, r.attempts, r.failed) for r in prompts.call_model(rows, "prompt", model, attempts=2, wait=0.0).collect()}
    assert got == {"k1": ("to plain", 1, False), "k2": ("to once", 2, False), "k3": ("", 2, True)}
    open(log, "w").close()
    fine = rows.where("key <> 'k3'")
    path = f"{tmp_path}/cache"
    assert sorted(r.response for r in prompts.cached_calls(fine.where("key = 'k1'"), path, "key", "prompt", model).collect()) == ["to plain"]
    assert sorted(r.response for r in prompts.cached_calls(fine, path, "key", "prompt", model).collect()) == ["to once", "to plain"]
    assert open(log).read().count("plain") == 1  # the second run found it
    prompts.cached_calls(fine, path, "key", "prompt", model, force=True).count()
    assert open(log).read().count("plain") == 2


def test_prompts_are_read_back(spark):
    text = "【相关设定】\n甲\n续写方向：\n向前\n【当前上文】\n乙 续写方向： 丙"
    row = spark.createDataFrame([(text,)], ["t"]).select(prompts.sections(F.col("t")).alias("s"), prompts.section(F.col("t"), "【当前上文】\n", ("\n[ASSISTANT]",)).alias("c")).first()
    assert [(x.mark, x.body) for x in row.s] == [("【相关设定】", "甲"), ("续写方向：", "向前"), ("【当前上文】", "乙 续写方向： 丙")]
    assert row.c == "乙 续写方向： 丙"


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from quillmill.sources.durable import work_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_dir(fake)


def test_only_a_missing_module_is_optional(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    put(tmp_path / "corpus_pipeline.py", "import no_such_module_here\n")
    code = "import sys; sys.path[:0] = [{!r}, {!r}]; import __spark_entry__".format(str(tmp_path), str(root))
    broken = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert broken.returncode != 0 and "no_such_module_here" in broken.stderr
