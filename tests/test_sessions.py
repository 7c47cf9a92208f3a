"""Sessions and provider runs on small frames."""

import time

from pyspark.sql import functions as F

from lexispark.operators import runs as R
from lexispark.operators import sessions as S


def test_review_and_queue(spark):
    a = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", False), (1, 2, "c", False), (2, 0, "a", False)], "session_id int, question_index int, question_id string, correct boolean")
    q = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "question_id string, word_id int")
    s = spark.createDataFrame([(1, "study"), (2, "review")], "session_id int, kind string")
    got = sorted((r.parent_session_id, r.question_index, r.question_id) for r in S.review(a, q, s).collect())
    assert got == [(1, 0, "b"), (1, 1, "c")]
    assert [r.question_id for r in S.wrong_answers(a).collect()] == ["b", "c", "a"]
    st = spark.createDataFrame([(1, i, 1.0) for i in range(8)] + [(2, i, 1.0) for i in range(2)], "u int, w int, weight double")
    for r in S.seed_queue(st, "u", "w").collect():
        assert len(r.queue) == 5 and len(set(r.queue)) == (5 if r.u == 1 else 2)
    heavy = spark.createDataFrame([(i, j, 50.0 if j == 0 else 0.2) for i in range(200) for j in range(4)], "u int, w int, weight double").withColumn("w", F.col("u") * 4 + F.col("w"))
    firsts = [r.queue[0] % 4 for r in S.seed_queue(heavy, "u", "w", k=1).collect()]
    assert firsts.count(0) > 180
    c = spark.range(1).select(S.cursor(F.array(F.lit("x")), F.lit(0), F.lit(False)).alias("a"), S.cursor(F.array(F.lit("x")), F.lit(3), F.lit(False)).alias("b"), S.step(F.lit(4), F.lit(5), F.lit(True), F.lit(False)).alias("c"), S.step(F.lit(0), F.lit(5), F.lit(True), F.lit(False), False).alias("d")).first()
    assert tuple(c) == ("x", None, 4, 0)


def test_runs(spark):
    def provider(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    req = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "word_id long, request string").coalesce(1)
    got = {r.word_id: (r.response, r.error) for r in R.run(req, provider).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("C", None)}
    assert {r.error for r in R.run(req, provider, deadline=time.time() - 1).collect()} == {"deadline"}
    assert R.canary(req, provider) and not R.canary(req.where("word_id = 2"), provider)
    chunks = spark.createDataFrame([(0, 1), (0, 3), (1, 2), (2, 9)], "chunk int, word_id long")
    assert {r.status: r.chunks for r in R.status(chunks, R.run(req, provider)).collect()} == {"completed": 1, "failed": 1, "pending": 1}
    assert [r.chunk for r in R.pending(chunks.select("chunk").distinct(), spark.createDataFrame([(0,), (1,)], "chunk int")).collect()] == [2]
