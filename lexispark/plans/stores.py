"""Queries of merges, keyed state, time-boxed runs, and of the questions a session asks next."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.operators import merge as M
from lexispark.operators import sessions as X
from lexispark.operators import study as S
from lexispark.operators import timebox as B
from lexispark.plans import quizzes, study
from lexispark.session import saved, scratch, table
from lexispark.sources import kvstore as K
from lexispark.streaming import restore as SR

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


# -- merges: documents stand for words; three chunk tables are folded into them in order

_VALUES = "gloss root t0 t1 m0 m1 m2".split()
_START = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS gloss, CASE WHEN doc_id % 2 = 1 THEN source END AS root, CASE WHEN doc_id % 5 < 2 THEN '' ELSE source END AS t0, NULL::VARCHAR AS t1, CASE doc_id % 4 WHEN 0 THEN 'noun' WHEN 1 THEN '' WHEN 2 THEN 'noun, pl' END AS m0, '' AS m1, 'particle' AS m2 FROM documents"
_CHUNKS = [
    "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS gloss, 'toxic ' || toxic AS root, NULL AS t0, CASE WHEN toxic = 1 THEN 'bad' END AS t1, 'verb' AS m0, CASE WHEN quality = 0 THEN 'adj' ELSE 'adj, sg' END AS m1, '' AS m2 FROM labels",
    "SELECT doc_id + 5 AS id, source AS gloss, '' AS root, 'first' AS t0, lang AS t1, 'verb, past' AS m0, 'adv' AS m1, NULL AS m2 FROM documents WHERE n_chars % 2 = 0",
    "SELECT doc_id AS id, 'last' AS gloss, 'root' AS root, '' AS t0, 'second' AS t1, 'late' AS m0, 'late' AS m1, CASE WHEN n_chars % 3 = 0 THEN 'particle, old' END AS m2 FROM documents WHERE n_chars % 7 <> 0",
]


def _folded() -> str:
    sql = f"SELECT *, 0 AS n_changes FROM ({_START})"
    for chunk in _CHUNKS:
        bare = {c: f"(NOT regexp_matches(trim(coalesce(o.{c}, '')), '[ ,]'))" if c[0] == "m" else f"coalesce(o.{c}, '') = ''" for c in _VALUES}
        take = {c: f"(coalesce(c.{c}, '') <> '' AND {bare[c]})" for c in _VALUES}
        sql = f"SELECT o.doc_id, {', '.join(f'CASE WHEN {take[c]} THEN c.{c} ELSE o.{c} END AS {c}' for c in _VALUES)}, o.n_changes + CASE WHEN {' OR '.join(take.values())} THEN 1 ELSE 0 END AS n_changes FROM ({sql}) o LEFT JOIN ({chunk}) c ON c.id = o.doc_id"
    return f"SELECT doc_id, coalesce(gloss, '') AS gloss, coalesce(root, '') AS root, coalesce(t0, '') AS t0, coalesce(t1, '') AS t1, coalesce(m0, '') AS m0, coalesce(m1, '') AS m1, coalesce(m2, '') AS m2, CAST(n_changes AS BIGINT) AS n_changes FROM ({sql})"


def _word(rows, key, values, *more):
    """Rows of values as words or chunk rows: two contexts, three forms."""
    v = dict(zip(_VALUES, values, strict=True))
    text = lambda c: c.cast("string")
    contexts = F.array(*[F.struct(text(v[t]).alias("translation")) for t in ("t0", "t1")])
    forms = F.array(*[F.struct(F.lit(m).alias("form"), text(v[m]).alias("morphology")) for m in ("m0", "m1", "m2")])
    return rows.select(key.alias("id"), *more, text(v["gloss"]).alias("context_definition"), text(v["root"]).alias("etymology"), contexts.alias("contexts"), forms.alias("forms"))


def _chunks(spark, d):
    docs, lab, none, lit = table(spark, d, "documents"), table(spark, d, "labels"), F.lit(None), F.lit
    q, t, n = F.col("quality"), F.col("toxic"), F.col("n_chars")
    of = lambda i, key: (F.lit(i).alias("chunk"), key.alias("row"))
    key = F.col("doc_id")
    return (
        _word(lab, key, [F.when(q == 1, "good").otherwise(""), F.concat(lit("toxic "), t.cast("string")), none, F.when(t == 1, "bad"), lit("verb"), F.when(q == 0, "adj").otherwise("adj, sg"), lit("")], *of(0, key))
        .unionByName(_word(docs.where(n % 2 == 0), key + 5, [F.col("source"), lit(""), lit("first"), F.col("lang"), lit("verb, past"), lit("adv"), none], *of(1, key)))
        .unionByName(_word(docs.where(n % 7 != 0), key, [lit("last"), lit("root"), lit(""), lit("second"), lit("late"), lit("late"), F.when(n % 3 == 0, "particle, old")], *of(2, key)))
    )


def _start(spark, d):
    docs, key = table(spark, d, "documents"), F.col("doc_id")
    m0 = F.when(key % 4 == 0, "noun").when(key % 4 == 1, "").when(key % 4 == 2, "noun, pl")
    return _word(docs, key, [F.when(key % 3 == 0, "").otherwise(F.col("lang")), F.when(key % 2 == 1, F.col("source")), F.when(key % 5 < 2, "").otherwise(F.col("source")), F.lit(None), m0, F.lit(""), F.lit("particle")], (key % 8).alias("part"))


def _plain(words, *more):
    text = lambda c: F.coalesce(c, F.lit(""))
    own = [text(F.col("context_definition")).alias("gloss"), text(F.col("etymology")).alias("root")]
    own += [text(F.col("contexts")[i]["translation"]).alias(f"t{i}") for i in range(2)] + [text(F.col("forms")[i]["morphology"]).alias(f"m{i}") for i in range(3)]
    return words.select(F.col("id").alias("doc_id"), *own, *more)


@query("merge_chunks", _folded())
def merge_chunks(spark, d):
    return _plain(M.merge_chunks(_start(spark, d), _chunks(spark, d)), "n_changes")


@query("merge_into_table", f"SELECT * EXCLUDE (n_changes) FROM ({_folded()})")
def merge_into_table(spark, d):
    path = scratch(spark)
    _start(spark, d).write.partitionBy("part").parquet(path)
    M.merge_into(spark, path, _chunks(spark, d), "part")
    return _plain(spark.read.parquet(path))


# -- keyed state: puts, deletes by work and prefix, a compaction, and puts again


@query(
    "state_store",
    "WITH u AS (SELECT user_id AS w, count(*) AS n, max(event_id) AS m FROM events GROUP BY user_id) "
    "SELECT 'flash_progress_' || w AS key, CASE WHEN w % 9 = 0 THEN 'again' ELSE CAST(n AS VARCHAR) END AS value FROM u WHERE w % 3 <> 0 OR w % 9 = 0 "
    "UNION ALL SELECT 'flash_session_' || w, CASE WHEN w % 5 = 0 THEN 'late' ELSE CAST(m AS VARCHAR) END FROM u WHERE w % 5 = 0 OR (w % 3 <> 0 AND NOT starts_with(CAST(w AS VARCHAR), '1')) "
    "UNION ALL SELECT 'flash_settings', CAST(max(m) AS VARCHAR) FROM u",
)
def state_store(spark, d):
    store = K.Store(spark, scratch(spark))
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("w")).agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    key = lambda p: F.concat(F.lit(p), F.col("w").cast("string")).alias("key")
    store.put(users.select(key(K.PROGRESS), F.col("n").alias("value")))
    store.put(users.select(key(K.SESSION), F.col("m").alias("value")))
    store.put(users.select(F.lit(K.SETTINGS).alias("key"), F.col("m").alias("value"), F.col("m").alias("place")))  # the last of many puts
    store.delete_work(users.where("w % 3 = 0").select(F.col("w").alias("work_id")))
    store.compact()
    store.delete_prefixes(K.SESSION + "1")
    store.put(users.where("w % 9 = 0").select(key(K.PROGRESS), F.lit("again").alias("value")))
    store.put(users.where("w % 5 = 0").select(key(K.SESSION), F.lit("late").alias("value")))
    return store.read()


@query(
    "settings_over_defaults",
    "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'dark' AS theme FROM events",
)
def settings_over_defaults(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    s = K.settings(e, {"k": "none", "theme": "dark"})
    return s.select("event_id", F.col("settings")["k"].alias("k"), F.col("settings")["theme"].alias("theme"))


# -- a run in a time box


def _upper(requests: list[str]) -> list[str]:
    return [r.upper() for r in requests]


@query("timeboxed_run", "SELECT p_size AS chunk, p_partkey AS word_id, upper(p_name) AS response FROM (SELECT CAST(p_size % 12 AS BIGINT) AS p_size, p_partkey, p_name FROM part)")
def timeboxed_run(spark, d):
    path = scratch(spark)
    B.stage(table(spark, d, "part").select((F.col("p_size") % 12).alias("chunk"), F.col("p_partkey").alias("word_id"), F.col("p_name").alias("request")), path)
    report = B.run(spark, path, _upper, B.Limits(time_limit=3600.0, concurrency=4))
    if report.failures or report.pending:
        raise RuntimeError(f"chunks without an answer: {report}")
    return B.answers(spark, path)


# -- what a session asks next: nations stand for sessions, customers for words


def _states(spark, d):
    """c_nationkey, c_custkey, weight (null without statistics), recent (the last three)."""
    st = study.word_state(spark, d).withColumnRenamed("user_id", "c_custkey")
    w = S.weight(F.col("correct") + F.col("incorrect"), F.col("correct"), F.col("incorrect"), F.col("streak"), F.col("urgency"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(st, "c_custkey", "left")
    own = c.select("c_custkey", "c_nationkey", F.when(F.col("correct").isNotNull(), w).alias("weight"))
    last = W.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))
    recent = table(spark, d, "customer").select("c_nationkey", "c_custkey").withColumn("i", F.row_number().over(last)).where("i <= 3")
    return own.join(recent.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("recent")), "c_nationkey")


def _queue_sql(k: int) -> str:
    """The rule draw by draw."""
    states = f"SELECT c_nationkey AS part, c_custkey AS item, weight, NOT EXISTS (SELECT 1 FROM ({study._STATE}) s WHERE s.user_id = c_custkey) AS fresh FROM ({study._WEIGHT})"
    sql = f"WITH w AS MATERIALIZED ({states}), q0 AS (SELECT part, []::BIGINT[] AS queue, list_sort(list(item))[-3:] AS last FROM w GROUP BY part)"
    for i in range(k):
        u = f"(('0x' || substr(md5('0|' || part || '|' || item || '|{i}'), 1, 13))::BIGINT::DOUBLE + 1) / (4503599627370496::DOUBLE + 2)"
        place = f"-ln({u}) / (CASE WHEN NOT fresh THEN weight WHEN list_contains(queue, item) THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END)"
        sql += f", d{i} AS (SELECT part, arg_min(item, (list_contains(last, item), {place}, item)) AS item FROM w JOIN q{i} USING (part) GROUP BY part)"
        sql += f", q{i + 1} AS (SELECT part, list_append(queue, item) AS queue, list_append(last, item)[-3:] AS last FROM q{i} JOIN d{i} USING (part))"
    return sql


@query("question_queue", f"{_queue_sql(5)} SELECT part AS c_nationkey, array_to_string(queue, ',') AS queue FROM q5")
def question_queue(spark, d):
    return X.seed_queue(_states(spark, d), "c_nationkey", "c_custkey").select("c_nationkey", F.array_join(F.transform("queue", lambda x: x.cast("string")), ",").alias("queue"))


# words of three forms: the lemma without morphology, and two inflected ones
_LADDER = """p AS (SELECT part, item, ('0x' || substr(md5('0|' || item), 1, 8))::BIGINT AS draw, ('0x' || substr(md5('0|' || item || '|type'), 1, 8))::BIGINT % 3 AS kind, c_name AS lemma, c_mktsegment || ' ' || c_name AS def, item % 3 AS asked FROM d0 JOIN customer ON c_custkey = item),
f AS (SELECT *, CASE asked WHEN 1 THEN [lemma || 'a'] WHEN 2 THEN [lemma || 'b'] ELSE [lemma || 'a', lemma || 'b'] END AS left_over FROM p),
g AS (SELECT *, left_over[draw % len(left_over) + 1] AS form FROM f)"""


@query(
    "adaptive_question",
    f"{_queue_sql(1)}, {_LADDER} SELECT part AS c_nationkey, item AS word_id, ['greek-to-english', 'english-to-greek', 'form-id'][kind + 1] AS type, CASE WHEN kind = 1 THEN def ELSE form END AS prompt, CASE kind WHEN 0 THEN def WHEN 1 THEN lemma ELSE CASE WHEN form = lemma || 'a' THEN 'noun, pl' ELSE 'verb' END END AS correct_answer FROM g",
)
def adaptive_question(spark, d):
    c = table(spark, d, "customer")
    name, key = F.col("c_name"), F.col("c_custkey")
    form = lambda end, m: F.struct(F.concat(name, F.lit(end)).alias("form"), F.lit(m).alias("morphology"))
    words = c.select(key.alias("id"), name.alias("lemma"), F.col("c_mktsegment").alias("pos"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("definition"), F.lit("").alias("context_definition"), F.array(form("", ""), form("a", "noun, pl"), form("b", "verb")).alias("forms"))
    last = F.when(key % 3 == 1, F.concat(name, F.lit("b"))).when(key % 3 == 2, F.concat(name, F.lit("a")))
    states = _states(spark, d).join(c.select("c_custkey", last.alias("last_prompt")), "c_custkey").withColumnRenamed("c_custkey", "id")
    return X.adaptive_questions(states, words, "c_nationkey", "mixed").drop("choices")


# -- saved sessions: JSON with fields missing or odd by remainders of the key


_JSON = {
    "workId": "'w' || nk",
    "startTime": "CASE WHEN k % 11 <> 0 THEN k END",
    "id": "CASE WHEN k % 4 <> 0 THEN 's' || k END",
    "kind": "CASE WHEN k % 3 = 0 THEN 'review' END",
    "nextQuestionOrdinal": "CASE WHEN k % 6 = 0 THEN k END",
    "endedAt": "CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN k END",
}


def _saved_json(spark, d):
    """k, text: a saved session of each customer."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"))
    plain = [F.when(F.expr(e).isNotNull(), F.concat(F.lit(f'"{n}":'), F.regexp_replace(F.to_json(F.array(F.expr(e))), r"^\[|\]$", ""))) for n, e in _JSON.items()]
    k = F.col("k")
    more = [
        F.when(k % 13 == 0, F.lit('"questions":"none"')).when(k % 7 != 0, F.concat(F.lit('"questions":['), F.array_join(F.slice(F.array(F.lit('{"id":"a"}'), F.lit('{"type":"x"}'), F.lit('{"id":""}'), F.lit('{"id":"d","wordId":4}')), F.lit(1), (k % 5).cast("int")), ","), F.lit("]"))),
        F.when(k % 10 == 0, F.lit('"currentIndex":1.5')).when(k % 10 < 8, F.concat(F.lit('"currentIndex":'), (k % 9 - 2).cast("string"))),
        F.when(k % 5 != 0, F.concat(F.lit('"stats":{"seen":'), (k % 8).cast("string"), F.lit("}"))),
        F.concat(F.lit('"recentWordIds":['), F.array_join(F.slice(F.array(*map(F.lit, "123456")), F.lit(1), (k % 7).cast("int")), ","), F.lit("]")),
        F.when(k % 6 == 1, F.lit('"ended":true')).when(k % 6 == 2, F.lit('"ended":1')).when(k % 6 == 3, F.lit('"ended":false')).when(k % 6 == 4, F.lit('"ended":0')),
        F.when(k % 4 == 1, F.concat(F.lit('"returnToSession":{"workId":"p","startTime":7,"currentIndex":'), (k % 3).cast("string"), F.lit(',"questions":[{},{"id":"b"}]}'))).when(k % 4 == 2, F.lit('"returnToSession":{"x":1}')),
    ]
    return c.select("k", F.concat(F.lit("{"), F.concat_ws(",", *plain, *more), F.lit("}")).alias("text"))


@query(
    "restored_records",
    f"WITH c AS (SELECT c_custkey AS k, c_nationkey AS nk, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(least(c_custkey % 5, 4) AS BIGINT) END AS n FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 7 <> 0), j AS (SELECT *, {', '.join(f'{e} AS {n}_' for n, e in _JSON.items())} FROM c) "
    "SELECT k, 3 AS version, coalesce(id_, workId_ || '-' || coalesce(startTime_, 5000)) AS id, coalesce(kind_, 'study') AS kind, n AS n_questions, CASE WHEN n > 2 THEN 'q3' END AS third, "
    "CASE WHEN k % 10 = 0 OR k % 10 >= 8 THEN 0 ELSE greatest(0, least(k % 9 - 2, greatest(n - 1, 0))) END AS current_index, coalesce(nextQuestionOrdinal_, n) AS next_ordinal, "
    "CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE k % 8 END AS INTEGER) AS seen, array_to_string([1, 2, 3, 4, 5, 6][1:k % 7][-4:], ',') AS recent, k % 6 IN (1, 2) AS ended, nullif(endedAt_, 0) AS ended_at, "
    "CASE WHEN k % 4 = 1 THEN 'p-7' END AS parent_id, CASE WHEN k % 4 = 1 THEN least(k % 3, 1) END AS parent_index, coalesce(startTime_, 5000) AS updated FROM j",
)
def restored_records(spark, d):
    # exploded, as a filter on s would be pushed down and restore each session twice
    s = _saved_json(spark, d).select("k", F.explode(F.array_compact(F.array(SR.restored(F.col("text"), F.lit(5000).cast("long"))))).alias("s"))
    own = {"version": "s.version", "id": "s.id", "kind": "s.kind", "current_index": "s.currentIndex", "next_ordinal": "s.nextQuestionOrdinal", "seen": "s.stats.seen", "ended": "s.ended", "ended_at": "s.endedAt", "parent_id": "s.returnToSession.id", "parent_index": "s.returnToSession.currentIndex", "updated": "s.updatedAt"}
    return s.select("k", *[F.col(c).alias(n) for n, c in own.items()], F.size("s.questions").cast("long").alias("n_questions"), F.get("s.questions", F.lit(2))["id"].alias("third"), F.array_join(F.transform("s.recentWordIds", lambda x: x.cast("string")), ",").alias("recent"))


_FOLDED = f"SELECT user_id AS session_id, word_id, CAST(count(*) AS INTEGER) AS seen, CAST(count(*) FILTER (WHERE correct) AS INTEGER) AS correct, CAST(arg_max(streak, (ts, event_id)) AS INTEGER) AS streak, CAST({study._URG} AS INTEGER) AS urgency, arg_max('p' || event_id, (ts, event_id)) AS last_prompt FROM ({study._STREAK.replace('PARTITION BY user_id', 'PARTITION BY user_id, word_id')}) GROUP BY user_id, word_id"


@query("streaming_restored", _FOLDED)
def streaming_restored(spark, d):
    """The earlier half of the answers is a saved session of each user, of version 1; a stream
    goes on from there, and gets some of the earlier answers again."""
    e = table(spark, d, "events")
    ends = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi")).first()
    middle = F.timestamp_micros(F.lit((ends["lo"] + ends["hi"]) // 2))
    early = F.col("ts").cast("timestamp") < middle
    answer = lambda df: df.select(F.col("user_id").alias("session_id"), F.pmod("event_id", F.lit(50)).alias("word_id"), F.col("event_id").cast("string").alias("question_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("purchase", "click").alias("correct"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("prompt"))
    first = answer(e.where(early))
    key = ["session_id", "word_id"]
    ordered = first.withColumn("key", F.struct(*key))
    streak = S.streaks(ordered, "key").groupBy(*key).agg(F.max_by(F.struct("streak", "prompt", "ts"), F.struct(*S.ORDER)).alias("x"))
    totals = first.groupBy(*key).agg(F.count("*").alias("seen"), F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect")).join(streak, key).join(S.urgency(first, *key), key)
    stats = F.struct("seen", "correct", "incorrect", F.col("x.streak").alias("streak"), "urgency", F.col("x.prompt").alias("lastPromptText"), F.unix_millis("x.ts").alias("lastSeenAt"))
    words = totals.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("word_id").cast("string"), stats))).alias("wordStats"))
    answers = first.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("question_id", F.struct(F.col("question_id").alias("questionId"), F.col("word_id").alias("wordId"), "correct")))).alias("answersById"))
    text = F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(F.lit("q").alias("id"))).alias("questions"), "wordStats", "answersById"))
    saved_ = saved(words.join(answers, "session_id").select("session_id", text.alias("text")))
    stats = saved(SR.word_stats(saved_.select("session_id", SR.restored(F.col("text"), F.lit(1).cast("long")).alias("session"))))
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    late = answer(stream.where(~early | (F.col("event_id") % 10 == 0)))
    with SR.settings(spark):
        after = quizzes._drained(SR.word_sessions(late, stats), "update")
    last = stats.select(*after.columns).unionByName(after).groupBy(*key).agg(F.max_by(F.struct("seen", "correct", "streak", "urgency", "last_prompt"), "seen").alias("x"))
    return last.select(*key, "x.*")
