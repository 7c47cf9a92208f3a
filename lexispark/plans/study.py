"""Study queries over events: a purchase is a correct answer, a user a session."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.functions import text as T
from lexispark.operators import study as S
from lexispark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


def answers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.pmod("event_id", F.lit(50)).alias("word_id"), (F.col("event_type").isin("purchase", "click")).alias("correct"), "value")


_A = "SELECT event_id, ts, user_id, event_id % 50 AS word_id, event_type IN ('purchase', 'click') AS correct, value FROM events"
_STREAK = f"SELECT *, sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS streak FROM (SELECT *, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM ({_A}))"


@query("answer_streaks", f"SELECT event_id, user_id, CAST(streak AS BIGINT) AS streak FROM ({_STREAK})")
def answer_streaks(spark, d):
    return S.streaks(answers(spark, d), "user_id").select("event_id", "user_id", "streak")


@query("best_streak", f"SELECT user_id, CAST(max(streak) AS BIGINT) AS best_streak FROM ({_STREAK}) GROUP BY user_id")
def best_streak(spark, d):
    return S.streaks(answers(spark, d), "user_id").groupBy("user_id").agg(F.max("streak").alias("best_streak"))


_URG = "list_reduce(list_prepend(0, list(CASE WHEN correct THEN 1 ELSE 2 END ORDER BY ts, event_id)), lambda u, c: CASE WHEN c = 1 THEN greatest(u - 1, 0) ELSE least(u + 3, 12) END)"


@query("urgency", f"SELECT user_id, word_id, CAST({_URG} AS INTEGER) AS urgency FROM ({_A}) GROUP BY ALL")
def urgency(spark, d):
    return S.urgency(answers(spark, d), "user_id", "word_id")


@query("recent_items", f"SELECT event_id, string_agg(word_id, ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, ts, user_id, CAST(word_id AS VARCHAR) AS word_id FROM ({_A}))")
def recent_items(spark, d):
    a = answers(spark, d).withColumn("w", F.col("word_id").cast("string"))
    return a.select("event_id", F.array_join(S.recent(a, "user_id", "w"), ",").alias("recent"))


_DONE = f"SELECT user_id, count(*) FILTER (WHERE correct) AS c, count(*) FILTER (WHERE NOT correct) AS i FROM ({_A}) GROUP BY user_id"


@query(
    "mastery_by_level",
    f"SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE m) AS mastered, CAST(floor(count(*) FILTER (WHERE m)::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT c_nationkey, coalesce(c >= 3 AND c::DOUBLE / (c + i) >= 0.75, false) AS m FROM customer LEFT JOIN ({_DONE}) ON c_custkey = user_id) GROUP BY c_nationkey",
)
def mastery_by_level(spark, d):
    done = S.progress(answers(spark, d), "user_id").withColumnRenamed("user_id", "c_custkey")
    return S.mastery(table(spark, d, "customer"), done, "c_custkey", "c_nationkey")


@query("dashboard_totals", f"SELECT count(*) AS users, count(*) FILTER (WHERE c + i > 0) AS seen, count(*) FILTER (WHERE c >= 3 AND c::DOUBLE / (c + i) >= 0.75) AS mastered, CAST(sum(c) AS BIGINT) AS correct FROM ({_DONE})")
def dashboard_totals(spark, d):
    p = S.progress(answers(spark, d), "user_id")
    total = F.col("correct") + F.col("incorrect")
    return p.agg(F.count("*").alias("users"), F.count_if(total > 0).alias("seen"), F.count_if(S.mastered(F.col("correct"), total)).alias("mastered"), F.sum("correct").alias("correct"))


@query("session_summary", f"SELECT user_id, count(*) AS seen, count(*) FILTER (WHERE correct) AS correct, CAST(max(streak) AS BIGINT) AS best_streak, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS duration_s, CAST(floor(count(*) FILTER (WHERE correct)::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS accuracy FROM ({_STREAK}) GROUP BY user_id")
def session_summary(spark, d):
    return S.session_summary(answers(spark, d), "user_id")


@query("first_answer_wins", f"SELECT user_id, word_id, event_id, correct FROM (SELECT *, row_number() OVER (PARTITION BY user_id, word_id ORDER BY ts, event_id) AS r FROM ({_A})) WHERE r = 1")
def first_answer_wins(spark, d):
    return S.first_answers(answers(spark, d), "user_id", "word_id").select("user_id", "word_id", "event_id", "correct")


def word_state(spark, d):
    a = answers(spark, d)
    s = S.streaks(a, "user_id").groupBy("user_id").agg(F.max_by("streak", F.struct(*S.ORDER)).alias("streak"))
    return S.progress(a, "user_id").join(S.urgency(a, "user_id"), "user_id").join(s, "user_id")


_STATE = f"SELECT user_id, c, i, u, s FROM ({_DONE}) JOIN (SELECT user_id, {_URG} AS u FROM ({_A}) GROUP BY user_id) USING (user_id) JOIN (SELECT user_id, arg_max(streak, (ts, event_id)) AS s FROM ({_STREAK}) GROUP BY user_id) USING (user_id)"
_WEIGHT = f"SELECT c_custkey, c_nationkey, CASE WHEN c IS NULL THEN 1.5::DOUBLE ELSE greatest((1::DOUBLE + 0.8::DOUBLE * u + CASE WHEN c + i = 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END) * CASE WHEN c > i THEN 0.75::DOUBLE ELSE 1::DOUBLE END * CASE WHEN i > c THEN 1.2::DOUBLE ELSE 1::DOUBLE END * CASE WHEN s >= 2 THEN 0.7::DOUBLE ELSE 1::DOUBLE END, 0.2::DOUBLE) END AS weight FROM customer LEFT JOIN ({_STATE}) ON c_custkey = user_id"


def weights(spark, d):
    st = word_state(spark, d).withColumnRenamed("user_id", "c_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(st, "c_custkey", "left")
    return c.select("c_custkey", "c_nationkey", S.weight(F.col("correct") + F.col("incorrect"), F.col("correct"), F.col("incorrect"), F.col("streak"), F.col("urgency")).alias("weight"))


@query("word_weight", f"SELECT c_custkey, round(weight, 6) AS weight FROM ({_WEIGHT})")
def word_weight(spark, d):
    return weights(spark, d).select("c_custkey", F.round("weight", 6).alias("weight"))


@query("weighted_pick", f"WITH w AS (SELECT c_custkey, c_nationkey, CAST(round(weight * 1000) AS BIGINT) AS weight FROM ({_WEIGHT})), r AS (SELECT *, sum(weight) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS cum, sum(weight) OVER (PARTITION BY c_nationkey) AS total FROM w) SELECT c_nationkey, min(c_custkey) AS c_custkey FROM r WHERE cum >= 0.37 * total GROUP BY c_nationkey")
def weighted_pick(spark, d):
    w = weights(spark, d).withColumn("weight", F.round(F.col("weight") * 1000).cast("long"))
    return S.weighted_pick(w, "c_nationkey", "c_custkey", "weight", F.lit(0.37))


@query("history_last10", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def history_last10(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type")


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
