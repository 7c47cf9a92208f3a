"""Streams that are stopped and go on in a later version, and odd saved sessions."""

import json

import pytest
from pyspark.sql import functions as F

from lexispark.plans import stores
from lexispark.streaming import restore as R

ANSWER = "session_id long, word_id long, question_id string, event_id long, ts timestamp, correct boolean, prompt string"


def fold(answers, start=None):
    out, done = {k: list(v) for k, v in (start or {}).items()}, set()
    for s, w, q, e, ts, ok, prompt in sorted(answers, key=lambda a: a[3]):
        if (s, w, q) in done:
            continue
        done.add((s, w, q))
        x = out.setdefault((s, w), [0, 0, 0, 0, 0, None])
        x[0], x[1], x[2] = x[0] + 1, x[1] + ok, x[2] + (not ok)
        x[3], x[4], x[5] = (x[3] + 1 if ok else 0), (max(x[4] - 1, 0) if ok else min(x[4] + 3, 12)), prompt
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("remember", [None, 3_600_000])
def test_restart_in_a_later_version(spark, tmp_path, remember):
    made = [(1 + i % 2, i % 3, f"q{i}", i, i % 4 != 1, f"p{i}") for i in range(40)]
    rows = [(s, w, q, e, __import__("datetime").datetime(2024, 1, 1, 0, 0, e), ok, p) for s, w, q, e, ok, p in made]
    saved = spark.createDataFrame([(9, 9, 5, 4, 1, 2, 0, None, None, ["old"]), (1, 0, 2, 2, 0, 2, 0, "x", None, None)], "session_id long, word_id long, seen int, correct int, incorrect int, streak int, urgency int, last_prompt string, last_seen timestamp, answered array<string>")

    def run(version, part):
        spark.createDataFrame(part, ANSWER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = {}

        def keep(batch, _):
            got.update({(r.session_id, r.word_id): (r.seen, r.correct, r.incorrect, r.streak, r.urgency, r.last_prompt) for r in batch.collect()})

        stream = R.word_sessions(spark.readStream.schema(ANSWER).parquet(f"{tmp_path}/in"), saved, version, remember)
        with R.settings(spark):
            q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
            q.awaitTermination()
        return got

    start = {(9, 9): (5, 4, 1, 2, 0, None), (1, 0): (2, 2, 0, 2, 0, "x")}
    first = run(1, rows[:20])
    seen = fold(rows[:20], start)
    assert {k: v[:4] for k, v in first.items()} == {k: v[:4] for k, v in seen.items() if k != (9, 9)}
    old = (9, 9, "old", 90, rows[0][4], True, "again")
    new = (9, 9, "new", 91, rows[0][4], True, "new")
    second = run(3, [*rows[15:30], old, new])  # some answers come again, before and after the restart
    # version 1 kept no urgency and no prompt: they begin anew, the counts go on
    begun = {k: (*v[:4], 0, None) for k, v in seen.items()}
    assert second == {k: v for k, v in fold([*rows[20:30], new], begun).items() if k in second} and (9, 9) in second
    third = run(3, rows[10:])
    want = fold([*rows[20:40], new], begun)
    assert {k: v for k, v in third.items()} == {k: want[k] for k in third} and len(third) == 6


def test_odd_sessions(spark):
    q = [{"id": "a"}, {}]
    cases = [None, "", "no json", "[]", "{}", {"questions": "x"}, {"questions": {}}, {"questions": []}, {"questions": q, "currentIndex": 9}, {"questions": q, "currentIndex": -1}, {"questions": q, "currentIndex": 0.5}]
    cases += [{"questions": q, "ended": x} for x in (True, False, 0, 1, "", "yes", None)]
    cases += [{"questions": q, "returnToSession": {"questions": q, "kind": "study", "returnToSession": {"questions": q}}}, {"questions": q, "returnToSession": None}, {"questions": q, "stats": None, "answersById": 3, "recentWordIds": list(range(9))}]
    d = spark.createDataFrame([(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(cases)], "i int, text string")
    got = {r.i: r.s for r in d.select("i", R.restored(F.col("text"), F.lit(77).cast("long")).alias("s")).collect()}
    assert all(got[i] is None for i in range(7)) and got[7].questions == [] and got[7].currentIndex == 0
    assert [got[i].currentIndex for i in (8, 9, 10)] == [1, 0, 0] and [x.id for x in got[8].questions] == ["a", "q2"]
    assert [got[i].ended for i in range(11, 18)] == [True, False, False, True, False, True, False]
    assert got[18].returnToSession.id == "session-77" and got[19].returnToSession is None
    assert got[20].recentWordIds == [5, 6, 7, 8] and got[20].stats.seen == 0 and got[20].answersById == {} and got[20].version == 3


def test_a_session_is_parsed_once(spark):
    d = stores.restored_records(spark, "/root/testdata/sf0.001")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
