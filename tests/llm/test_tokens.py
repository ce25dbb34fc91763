import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm.packing import binary_lengths, pack_power_of_two
from quillmill.llm.records import frame, open_uri, read_at, read_frame, read_token_records, write_token_records
from quillmill.llm.tokens import Encoder, default_path

TEXTS = [None, "", "\x85", "a\x1eb c", "nel\x85 in\x1d", "   ", "Hello, world! It's 2024.", "naïve CAFÉ été   x", "a" * 5000, "x <|endoftext|> y<|startoftext|>", "tab\tnew\nline\x1cfs\x85nel", "don't they'll I'D _a_b_ 12x3", "日本語 テスト", "İstanbul ΣΑΣ ß"]
ROWS = [(i * 3 - 4, t) for i, t in enumerate(TEXTS)] + [(6, "same"), (6, "same"), (None, "no id"), (900, " ".join(f"tok{i % 97}" for i in range(3000)))]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def truth(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    enc, rng = Encoder(default_path()), random.Random(1)
    chars = "abzAZ09 .,'-_é́ß中　<|>\x0b "
    for t in [*TEXTS, *("".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(1500))]:
        assert enc.ids(t or "").tolist() == truth(t)


def test_binary_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        p = binary_lengths(n)
        assert sum(p) == n and p == sorted(p, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in p)


def frame_of(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, part int").repartition(3)


def test_packing_covers_each_id_once(spark):
    out = pack_power_of_two(frame_of(spark)).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out))) and all(r.offset == 0 for r in out)
    want = sorted(((i, len(t) + 1, crc(t + [1])) for i, t in ((i, truth(t)) for i, t in ROWS)), key=str)
    got, docs = [], {}
    for r in sorted(out, key=lambda r: (str(r.id), r.doc_tokens, r.start)):
        assert r.length & (r.length - 1) == 0 and crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
        docs.setdefault((r.id, r.doc_tokens, r.start), []).append(r)
    whole = {}
    for (i, n, s), rs in docs.items():
        for k, r in enumerate(rs):
            whole.setdefault((i, n, k), b"")
            whole[i, n, k] += r.ids
    got = sorted(((i, n, zlib.crc32(b)) for (i, n, _), b in whole.items()), key=str)
    assert got == want
    by = {}
    for r in out:
        by.setdefault(r.length, []).append(r.sequence_id)
    assert all(max(v) - min(v) + 1 == len(v) for v in by.values())
    assert pack_power_of_two(frame_of(spark).limit(0)).count() == 0


def test_records_round_trip(spark):
    manifest = write_token_records(frame_of(spark), shards=4)
    out = read_token_records(spark, manifest).orderBy("record").collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.id for r in out] == [i for i, _ in want]
    at = 0
    for r, (_, t) in zip(out, want, strict=True):
        ids = truth(t) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    m = max(manifest.collect(), key=lambda r: r.records)
    i, ids = read_at(m.path, m.index_path, m.records - 1)
    assert (i, crc(ids)) == next((r.id, r.ids_crc32) for r in out if r.record == m.first + m.records - 1)
    small = read_token_records(spark, manifest, split_bytes=1).orderBy("record").collect()
    assert small == out
    assert read_token_records(spark, write_token_records(frame_of(spark).limit(0), shards=2)).count() == 0
    assert read_token_records(spark, write_token_records(frame_of(spark).limit(0))).count() == 0


def test_shards_that_no_task_finished_are_swept(spark, tmp_path):
    (tmp_path / "shard-000009-left.bin").write_bytes(b"x")
    manifest = write_token_records(frame_of(spark), str(tmp_path), shards=2)
    names = {p.rpartition("/")[2] for r in manifest.collect() for p in (r.path, r.index_path)}
    assert {p.name for p in tmp_path.glob("shard-*")} == names


def test_a_very_long_text_and_rows_that_all_tie(spark):
    long = " ".join(f"t{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(None, "same words")] * 50 + [(7, long)], "doc_id long, text string").repartition(3)
    manifest = write_token_records(df, shards=4)
    assert sum(r.records > 0 for r in manifest.collect()) > 2
    out = read_token_records(spark, manifest).orderBy("record").collect()
    assert [r.id for r in out] == [None] * 50 + [7] and np.frombuffer(out[-1].ids, "<u4").tolist() == truth(long) + [2]


def test_damage_is_noticed(tmp_path):
    data = bytearray(frame(b"some payload"))
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        (tmp_path / "x").write_bytes(bad)
        fs, p = open_uri(f"file://{tmp_path}/x")
        with fs.open_input_stream(p) as f, pytest.raises(ValueError):
            read_frame(f)


def test_a_text_longer_than_a_step(monkeypatch):
    from quillmill.llm import tokens

    monkeypatch.setattr(tokens, "STEP", 50)
    enc, text = Encoder(default_path(), memo=20), " ".join(f"word{i % 300} 世界{i}　x" for i in range(900))
    assert enc.ids(text).tolist() == truth(text)
    texts = [t for t in [*TEXTS, text, "solid" * 40]]
    assert [x.tolist() for x in enc.texts(pa.array(texts))] == [truth(t) for t in texts]
