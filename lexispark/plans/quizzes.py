"""Question, highlight, quality and streaming queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import highlight as H
from lexispark.operators import quality as Q
from lexispark.operators import questions as K
from lexispark.operators import vocab as V
from lexispark.plans import study
from lexispark.session import shared_dir, table
from lexispark.streaming import answers as SA

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def part_words(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("pos"), F.concat_ws(" ", "p_name", "p_type").alias("definition"), F.col("p_name").alias("lemma"), F.lit("").alias("context_definition"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))


# the whole rule: every other word in ring order, of the own part of speech first, overlapping ones last
_BAG = "list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[ \\t,;]+'), lambda x: x <> ''))"
_RING = f"""w AS (SELECT p_partkey AS id, p_name AS lemma, p_brand AS pos, {_BAG} AS b, md5('0|' || p_partkey) AS h, p_name || ' ' || p_type AS def FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY h) AS r1, count(*) OVER (PARTITION BY pos) AS n1, row_number() OVER (ORDER BY h) AS r2, count(*) OVER () AS n2 FROM w),
o AS (SELECT x.id, y.id AS other_id, y.lemma, y.def, len(list_intersect(x.b, y.b)) > 0.5 * least(len(x.b), len(y.b)) AS overlap, CASE WHEN x.pos = y.pos THEN 0 ELSE 1 END AS far,
 CASE WHEN x.pos = y.pos THEN (y.r1 - x.r1 + x.n1) % x.n1 ELSE (y.r2 - x.r2 + x.n2) % x.n2 END AS step FROM r x JOIN r y ON x.id <> y.id),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap, far, step, other_id) AS k FROM o QUALIFY k <= 3)"""


@query("distractors", f"WITH {_RING} SELECT id, CAST(k - 1 AS INTEGER) AS k, other_id FROM best")
def distractors(spark, d):
    return K.distractors(part_words(spark, d))


@query(
    "form_choices",
    "WITH o AS (SELECT p_type AS m, count(*) AS owners, min(p_partkey) AS owner FROM part GROUP BY p_type), l AS (SELECT list({'m': m, 'owners': owners, 'owner': owner} ORDER BY md5('0|' || m), m) AS a FROM o) "
    "SELECT p_partkey AS id, array_to_string(list_transform(list_filter(a, lambda x: x.m <> p_type AND (x.owners > 1 OR x.owner <> p_partkey))[1:3], lambda x: x.m), '|') AS choices FROM part, l",
)
def form_choices(spark, d):
    w = form_words(spark, d)
    return K.morphology_choices(w, w.select("id", F.col("type").alias("morphology"))).select("id", F.array_join("choices", "|").alias("choices"))


def form_words(spark, d):
    return part_words(spark, d).withColumn("forms", F.array(F.struct(F.col("lemma").alias("form"), F.col("type").alias("morphology"))))


def _shown(questions):
    """Questions with their choices in the order of letters, which no draw decides."""
    return questions.withColumn("choices", F.array_join(F.array_sort("choices"), "|"))


_CHOICES = "array_to_string(list_sort(list_prepend(any_value({answer}), list({shown}))), '|') AS choices"


@query(
    "translation_questions",
    f"WITH {_RING} SELECT id AS word_id, 'greek-to-english' AS type, any_value(w.lemma) AS prompt, any_value(w.def) AS correct_answer, {_CHOICES.format(answer='w.def', shown='best.def')} FROM w JOIN best USING (id) GROUP BY id "
    f"UNION ALL SELECT id, 'english-to-greek', any_value(w.def), any_value(w.lemma), {_CHOICES.format(answer='w.lemma', shown='best.lemma')} FROM w JOIN best USING (id) GROUP BY id",
)
def translation_questions(spark, d):
    w = form_words(spark, d)
    return _shown(K.build(w, "greek-to-english").unionByName(K.build(w, "english-to-greek")))


@query(
    "form_questions",
    "WITH o AS (SELECT p_type AS m, count(*) AS owners, min(p_partkey) AS owner FROM part GROUP BY p_type), l AS (SELECT list({'m': m, 'owners': owners, 'owner': owner} ORDER BY md5('0|' || m), m) AS a FROM o) "
    "SELECT p_partkey AS word_id, 'form-id' AS type, p_name AS prompt, p_type AS correct_answer, array_to_string(list_sort(list_prepend(p_type, list_transform(list_filter(a, lambda x: x.m <> p_type AND (x.owners > 1 OR x.owner <> p_partkey))[1:3], lambda x: x.m))), '|') AS choices FROM part, l",
)
def form_questions(spark, d):
    return _shown(K.ask(form_words(spark, d), "form-id"))


@query(
    "highlight_span",
    r"""WITH t AS (SELECT doc_id, text, lower(text) AS l FROM documents WHERE lang = 'en' AND text IS NOT NULL), p AS (SELECT *, regexp_matches(l, '\bonon\b') AS e, regexp_matches(l, '\bonon(ingly|edly|ing|ed|es|s)\b') AS k FROM t)
SELECT doc_id, CASE WHEN e THEN 'exact_phrase' WHEN k THEN 'exact_token' ELSE 'none' END AS method, CASE WHEN e THEN 'high' WHEN k THEN 'medium' ELSE 'low' END AS confidence,
 CAST(CASE WHEN e THEN length(regexp_extract(l, '(?s)^(.*?)\bonon\b', 1)) WHEN k THEN length(regexp_extract(l, '(?s)^(.*?)\bonon(ingly|edly|ing|ed|es|s)\b', 1)) END AS INTEGER) AS start FROM p""",
)
def highlight_span(spark, d):
    gloss = spark.range(1).select(H.compiled(F.lit("onon, of (it)")).alias("gloss"))
    t = table(spark, d, "documents").where("lang = 'en'").join(F.broadcast(gloss), how="cross")  # a single row
    return t.select("doc_id", H.spot(F.col("text"), F.col("gloss")).alias("h")).select("doc_id", "h.method", "h.confidence", "h.start")


_J = "FROM documents d LEFT JOIN labels l USING (doc_id)"
_BAD = {"lang": "lang NOT IN ('en', 'de', 'fr')", "short": "length(text) < 200", "n_chars": "n_chars <> length(text)", "label": "quality IS NULL", "toxic": "toxic = 1 AND quality = 1"}


@query("dq_violations", " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code {_J} WHERE {e}" for c, e in _BAD.items()))
def dq_violations(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return Q.violations(j, ["doc_id"], {c: F.expr(e) for c, e in _BAD.items()})


@query("dq_coverage", f"SELECT lang, count(*) AS docs, count(*) FILTER (WHERE quality IS NOT NULL) AS labelled, count(*) FILTER (WHERE toxic = 1) AS toxic {_J} GROUP BY lang")
def dq_coverage(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("quality").isNotNull()).alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def _drained(df, mode: str):
    """A finite stream run to its end; its rows, written batch by batch to the shared folder
    (in complete mode only the last batch's)."""
    name = f"stream_{uuid.uuid4().hex}"
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{name}"
    out = f"{base}-rows"
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/batch=-1")

    def put(rows, batch):  # a batch that is run again replaces its own rows
        rows.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else batch}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", base).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(out)


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return e.select(F.col("user_id").alias("session_id"), F.pmod("event_id", F.lit(50)).alias("word_id"), F.col("event_id").cast("string").alias("question_id"), "event_id", "ts", F.col("event_type").isin("purchase", "click").alias("correct"), F.when(F.col("event_type") == "signup", "review").otherwise("study").alias("kind"))


@query("streaming_progress", "SELECT user_id AS session_id, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS correct, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'click')) AS incorrect FROM events WHERE event_type <> 'signup' GROUP BY user_id")
def streaming_progress(spark, d):
    return _drained(SA.progress(_stream(spark, d), "session_id"), "complete").select("session_id", "correct", "incorrect")


@query("streaming_word_state", f"SELECT user_id AS session_id, word_id, CAST(count(*) AS INTEGER) AS seen, CAST(count(*) FILTER (WHERE correct) AS INTEGER) AS correct, CAST(arg_max(streak, (ts, event_id)) AS INTEGER) AS streak, CAST({study._URG} AS INTEGER) AS urgency FROM ({study._STREAK.replace('PARTITION BY user_id', 'PARTITION BY user_id, word_id')}) GROUP BY user_id, word_id")
def streaming_word_state(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = _drained(SA.word_states(_stream(spark, d)), "update")
    last = s.groupBy("session_id", "word_id").agg(F.max_by(F.struct("seen", "correct", "streak", "urgency"), "seen").alias("x"))
    return last.select("session_id", "word_id", "x.*")
