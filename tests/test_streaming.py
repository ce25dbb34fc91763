"""The streaming forms against their batch twins."""

import random

from pyspark.sql import functions as F

from quillmill.streaming import session

SCHEMA = "session string, seq long, action string, text string"


def log(seed):
    rng, rows = random.Random(seed), []
    for s in range(6):
        for k in range(rng.randint(1, 30)):
            action = "seed" if k == 0 and s % 2 else rng.choice(["accept", "accept", "accept", "replace", "reject", "save"])
            rows.append((f"s{s}", k, action, "".join(rng.choices("abc \n", k=rng.randint(0, 700)))))
    return rows


def test_a_stream_of_events_ends_in_the_batch_state(spark, tmp_path):
    rows = log(3)
    third = len(rows) // 3
    by_time = sorted(rows, key=lambda r: r[1])
    for i in range(3):  # three batches; a session's events go on from one to the next
        part = by_time[i * third : (i + 1) * third if i < 2 else None]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    seen = []

    def keep(df, batch):
        seen.extend((batch, tuple(r)) for r in df.collect())

    q = session.stream_sessions(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    last = {}
    for batch, row in sorted(seen, key=lambda x: x[0]):
        last[row[0]] = row
    assert len({b for b, _ in seen}) == 3
    want = {r.session: tuple(r) for r in session.fold_sessions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert last == want


ROUND = "session string, seq long, text string"


def generated(seed):
    rng, rows = random.Random(seed), []
    pool = ["".join(rng.choices("abcdefgh ", k=rng.randint(3, 150))) for _ in range(40)]
    for s in range(7):
        for k in range(rng.randint(1, 11)):
            text = None if rng.random() < 0.05 else "" if rng.random() < 0.05 else "\n\n".join(rng.choices(pool, k=rng.randint(1, 6)))
            rows.append((f"s{s}", k, text))
    return rows, [(f"s{s}", "\n\n".join(rng.choices(pool, k=4))) for s in range(0, 7, 2)] + [("s0", None), ("elsewhere", "nothing follows")]


def test_a_stream_of_rounds_ends_in_the_batch_fold(spark, tmp_path):
    rows, seeds = generated(11)
    by_time = sorted(rows, key=lambda r: r[1])
    cut = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    context = spark.createDataFrame(seeds, "session string, text string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = {}

    def keep(df, batch):
        for r in df.collect():
            seen[(r.session, r.seq)] = r

    for i in range(3):  # each part is a run of its own, so the second and third start from the checkpoint
        spark.createDataFrame(by_time[cut[i] : cut[i + 1]], ROUND).coalesce(1).write.json(f"{tmp_path}/in/{i}", ignoreNullFields=False)
        events = spark.readStream.schema(ROUND).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
        q = session.stream_rounds(events, context).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    assert len(seen) == len(rows)
    want = {r.session: (r.text, r.rounds) for r in session.fold_rounds(spark.createDataFrame(rows, ROUND), context).collect() if r.session != "elsewhere"}
    got = {}
    for (s, _), r in sorted(seen.items(), key=lambda x: x[0]):
        text, _n = got.get(s, ("", 0))
        got[s] = ("\n\n".join(filter(None, [text, r.kept])), r.rounds)
    assert got == want
    assert any(r.over for r in seen.values()) and any(r.kept == "" for r in seen.values())


def test_late_rows_up_to_the_watermark_count(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:05:00", "b", 4.0), ("2024-01-01 00:59:00", "a", 8.0)]
    frame = spark.createDataFrame(rows, "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    frame.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = session.windowed(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/ev"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("late_rows").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.event_type, r.n, r.total) for r in spark.table("late_rows").collect())
    assert got == sorted((r.event_type, r.n, r.total) for r in session.windowed(frame).collect()) == [("a", 3, 11.0), ("b", 1, 4.0)]
