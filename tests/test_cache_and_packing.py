"""The cache of model calls through outages, and best-fit packing against a sequential pass."""

import random

from quillmill.operators import datasets, prompts
from quillmill.operators.datasets import best_fit_plan, pack_best_fit


def model_of(log, down=()):
    def model(prompt):
        with open(log, "a") as f:
            f.write(f"{prompt}\n")
        if any(prompt.endswith(d) for d in down):
            raise RuntimeError("out")
        return f"to {prompt}"

    return model


def test_an_outage_ends_with_answers(spark, tmp_path):
    path, log = str(tmp_path / "cache"), str(tmp_path / "log")
    rows = spark.createDataFrame([(f"k{i % 12}", f"p{i % 12}", i) for i in range(40)] + [(None, "none", 99)], "key string, prompt string, response_at int")
    run = lambda down, **kw: {(r.response_at): r.response for r in prompts.cached_calls(rows, path, "key", "prompt", model_of(log, down), attempts=1, wait=0.0, batch=5, **kw).collect()}
    first = run(("3", "11"))
    assert first[0] == "to p0" and first[3] is None and first[23] is None and first[99] is None and len(first) == 41
    assert sorted(open(log).read().split()) == sorted(f"p{i}" for i in range(12))  # a repeated key is called once
    second = run(())
    assert all(second[i] == f"to p{i % 12}" for i in range(40))
    assert len(open(log).read().split()) == 14  # the two that failed, and no other, were called again
    assert run(("0", "1", "2")) == second
    prompts.compact_cache(spark, path, "key", "string")
    assert len(prompts._batches(spark, path)) == 1 and run(("p",)) == second
    assert len(open(log).read().split()) == 14


def test_a_run_that_is_cut_short_keeps_its_batches(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "cache"), str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "key long, prompt string")
    commit, done = prompts._commit, []

    def cut(made, *rest):
        if len(done) == 2:
            made.write.parquet(f"{path}/batch=99")  # what a run that dies while it writes leaves
            (tmp_path / "cache" / "batch=99" / "_SUCCESS").unlink()
            raise KeyboardInterrupt
        done.append(rest)
        commit(made, *rest)

    monkeypatch.setattr(prompts, "_commit", cut)
    try:
        prompts.cached_calls(rows, path, "key", "prompt", model_of(log), batch=8)
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    kept = prompts.read_cache(spark, path, "key", "bigint").count()
    called = len(open(log).read().split())
    assert 0 < kept < 30
    out = prompts.cached_calls(rows, path, "key", "prompt", model_of(log), batch=8).collect()
    assert sorted(r.response for r in out) == sorted(f"to p{i}" for i in range(30))
    assert len(open(log).read().split()) - called == 30 - kept


def test_force_takes_the_newest_and_failures_may_have_a_label(spark, tmp_path):
    path, log = str(tmp_path / "cache"), str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (1, "a")], "key long, prompt string")
    prompts.cached_calls(rows, path, "key", "prompt", lambda p: "old").count()
    assert [r.response for r in prompts.cached_calls(rows, path, "key", "prompt", lambda p: "new", force=True).collect()] == ["new", "new"]
    r = prompts.call_model(rows.limit(1), "prompt", model_of(log, ("a",)), attempts=2, wait=0.0, default="mixed_or_unclear").first()
    assert (r.response, r.attempts, r.failed) == ("mixed_or_unclear", 2, True)
    none = rows.limit(0)
    assert prompts.cached_calls(none, str(tmp_path / "new"), "key", "prompt").count() == 0


def sequential(rows, capacity):
    spaces, out = [], {}
    for k, s in sorted(rows, key=lambda x: (-x[1], x[0])):
        fit = [(x, b) for b, x in enumerate(spaces) if x >= s and x > 0]
        if fit and s <= capacity:
            x, b = min(fit)
        else:
            x, b = max(capacity, s), len(spaces)
            spaces.append(x)
        out[k] = (b, 0 if s > capacity else capacity - x)
        spaces[b] = 0 if s > capacity else x - s
    return out


def test_bins_equal_a_sequential_pass_for_every_number_of_parts(spark):
    rng = random.Random(9)
    for n, capacity in ((400, 50), (300, 7), (60, 1)):
        rows = [(i, rng.choice([rng.randint(0, capacity + 3), capacity // 2, 1])) for i in range(n)]
        want = sequential(rows, capacity)
        df = spark.createDataFrame(rows, "id long, n int").repartition(5)
        for parts in (1, 4, 16) if n == 400 else (3,):
            assert {r["id"]: (r["bin"], r["offset"]) for r in pack_best_fit(df, "id", "n", capacity, parts).collect()} == want


def test_the_plan_depends_on_sizes_not_rows():
    rng = random.Random(2)
    counts = {s: rng.randint(1, 9) for s in rng.sample(range(64), 40)}
    rows = [(k, s) for k, s in enumerate(s for s, c in counts.items() for _ in range(c))]
    want = sequential(rows, 64)
    got, place = {}, {}
    for k, s in sorted(rows, key=lambda x: (-x[1], x[0])):
        r = place[s] = place.get(s, -1) + 1
        _, first, _, b, each, used = next(p for p in best_fit_plan(counts, 64) if p[0] == s and p[1] <= r < p[2])
        got[k] = (b + (r - first) // each, used + (r - first) % each * s)
    assert got == want
    assert len(best_fit_plan({s: 10**9 for s in range(1, 2049)}, 2048)) < 20_000
    assert datasets.best_fit_plan({}, 10) == []
