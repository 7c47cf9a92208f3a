"""Time-boxed runs against a plain simulation: slow, failing and hanging providers, kills."""

import time
from pathlib import Path

import pytest

from lexispark.operators import merge as M
from lexispark.operators import timebox as T

REQUEST = "chunk long, word_id long, request string"


def provider(folder):
    """A provider that does what the first request says, and notes each call."""

    def ask(requests):
        what, name = requests[0].split()[:2]
        log = Path(folder) / f"{name}.calls"
        with log.open("a") as f:
            f.write("x")
        if what == "fail" or (what == "once" and log.stat().st_size == 1):
            raise RuntimeError(f"no answer to {name}")
        if what == "few":
            return requests[1:]
        for _ in range({"slow": 20, "hang": 10_000}.get(what, 0)):
            with (Path(folder) / f"{name}.beats").open("a") as f:
                f.write("x")
            time.sleep(0.1)
        return [r.upper() for r in requests]

    return ask


def staged(spark, tmp_path, kinds, per=3):
    rows = [(c, 100 * c + i, f"{k} c{c} word{i}") for c, k in enumerate(kinds) for i in range(per)]
    T.stage(spark.createDataFrame(rows, REQUEST), f"{tmp_path}/run")
    (tmp_path / "calls").mkdir(exist_ok=True)
    return f"{tmp_path}/run", f"{tmp_path}/calls", rows


def calls(folder):
    return {p.stem: len(p.read_text()) for p in Path(folder).glob("*.calls")}


def answered(spark, path):
    return sorted(tuple(r) for r in T.answers(spark, path).collect())


def quiet(spark, folder):
    """No task runs, and no provider goes on."""
    end = time.time() + 10
    while spark.sparkContext.statusTracker().getActiveStageIds() and time.time() < end:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveStageIds()
    time.sleep(T.ALARM + 1)  # the worker's own alarm
    beats = {p: p.stat().st_size for p in Path(folder).glob("*.beats")}
    time.sleep(0.6)
    assert beats == {p: p.stat().st_size for p in Path(folder).glob("*.beats")}


def test_each_way_a_chunk_can_end(spark, tmp_path):
    kinds = ["ok", "fail", "hang", "ok", "few", "slow", "ok"]
    path, folder, rows = staged(spark, tmp_path, kinds)
    merges = []
    r = T.run(spark, path, provider(folder), T.Limits(60, 5, chunk_timeout=15, concurrency=2, merge_every=2), merge=lambda a: merges.append(a.select("chunk").distinct().count()))
    fine = [i for i, k in enumerate(kinds) if k in ("ok", "slow")]
    assert r.completed == fine and r.pending == [] and r.asked[0] == 0 and sorted(r.asked) == list(range(7))
    assert sorted((f.chunk, f.phase, f.reason.split(":")[0]) for f in r.failures) == [(1, "run", "RuntimeError"), (2, "run", "timed out after 15 seconds"), (4, "run", "ValueError")]
    assert answered(spark, path) == [(c, w, q.upper()) for c, w, q in rows if c in fine]
    assert merges == [1, 3, 4] or merges[0] == 1 and merges[-1] == 4  # after the canary, by twos, at the end
    assert calls(folder) == {f"c{i}": 1 for i in range(7)}  # Spark asks nothing twice
    quiet(spark, folder)
    counts = {x.status: x["count"] for x in r.rows(spark, 0.0).groupBy("status").count().collect()}
    assert counts == {"completed": 4, "failed": 3}


def test_deadline_and_grace(spark, tmp_path):
    path, folder, _ = staged(spark, tmp_path, ["slow", "hang", "ok", "ok"])
    r = T.run(spark, path, provider(folder), T.Limits(1, 12, chunk_timeout=60, concurrency=2), canary=False)
    assert r.completed == [0] and r.asked == [0, 1] and r.pending == [2, 3]  # the slow one ends within the grace
    assert [(f.chunk, f.phase, f.reason) for f in r.failures] == [(1, "grace", "ended after the grace period")] and "deadline reached" in r.notes
    quiet(spark, folder)
    none = T.run(spark, path, provider(folder), T.Limits(0, 0), canary=False)
    assert none.asked == [] and none.completed == r.completed


def test_killed_and_resumed(spark, tmp_path):
    """A run that dies at a checkpoint repeats no chunk, and ends with an unbroken run's table."""
    path, folder, rows = staged(spark, tmp_path, ["ok"] * 6)
    word = "id long, part long, context_definition string, etymology string, contexts array<struct<translation:string>>, forms array<struct<form:string,morphology:string>>"
    own = [(w, c % 2, None, "", [], []) for c, w, _ in rows]
    tables = [f"{tmp_path}/{n}" for n in ("broken", "whole")]
    for t in tables:
        spark.createDataFrame(own, word).write.partitionBy("part").parquet(t)

    def put(table, got):
        chunk = got.selectExpr("word_id AS id", "chunk", "word_id AS row", "response AS context_definition", "'' AS etymology", "CAST(array() AS array<struct<translation:string>>) AS contexts", "CAST(array() AS array<struct<form:string,morphology:string>>) AS forms")
        return M.merge_into(spark, table, chunk, "part")

    seen = []

    def dies(got):
        put(tables[0], got)
        seen.append(1)
        if len(seen) == 2:
            raise KeyboardInterrupt

    limits = T.Limits(120, 5, concurrency=1, merge_every=1)
    with pytest.raises(KeyboardInterrupt):
        T.run(spark, path, provider(folder), limits, merge=dies)
    spark.sparkContext.cancelAllJobs()
    time.sleep(1)
    before = set(calls(folder))
    r = T.run(spark, path, provider(folder), limits, merge=lambda got: put(tables[0], got))
    assert r.completed == list(range(6)) and 1 < len(before) < 6 and any("resumed" in n for n in r.notes)
    assert {c: n for c, n in calls(folder).items() if n > 1} == {}
    put(tables[1], T.answers(spark, path))
    read = lambda t: sorted(tuple(x) for x in spark.read.parquet(t).select("id", "context_definition").collect())
    assert read(tables[0]) == read(tables[1]) == sorted((w, q.upper()) for _, w, q in rows)


def test_canary_is_tried_again_and_chunks_are_restaged(spark, tmp_path):
    path, folder, _ = staged(spark, tmp_path, ["once", "ok"])
    r = T.run(spark, path, provider(folder), T.Limits(60, 5))
    assert r.completed == [0, 1] and [(f.chunk, f.phase, f.attempt) for f in r.failures] == [(0, "canary", 1)]
    other = tmp_path / "b"
    other.mkdir()
    path, folder, rows = staged(spark, other, ["fail", "ok"], per=5)
    first, second = T.run_restaged(spark, path, provider(folder), T.Limits(60, 5, canary_tries=2), fallback=2)
    assert first.canary_failed and first.asked == [0, 0] and first.completed == [] and first.pending == [1]
    # 5 words by twos: chunks 0, 1, 2 of the first, 3, 4, 5 of the second; the canary fails again
    assert second.canary_failed and sorted(T._numbers(spark, f"{path}-fallback2/requests")) == [0, 1, 2, 3, 4, 5]
    again = T.run(spark, f"{path}-fallback2", provider(folder), T.Limits(60, 5), canary=False)
    assert again.completed == [3, 4, 5] and {f.chunk for f in again.failures} == {0, 1, 2}
