"""Queries of the contract checks, of saved sessions and of the smaller functions. Parts
stand for words, brands for works, users for sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import enrich as E
from lexispark.operators import lexicon as L
from lexispark.operators import quality as Q
from lexispark.operators import questions as K
from lexispark.operators import runs as R
from lexispark.operators import sessions as X
from lexispark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


# Words with faults of every kind, by remainders of the key.
_WORDS = """SELECT p_brand AS work_id, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_partkey // (CASE WHEN p_partkey % 29 = 0 THEN 1000000 ELSE 1 END) END AS id,
 CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS lemma, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END AS definition, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_brand END AS pos,
 CAST(p_partkey % 5 AS INTEGER) AS level, p_size - 2 AS frequency, p_partkey % 13 AS a, p_partkey % 11 AS b, p_name AS form, p_type AS sentence FROM part"""


def words(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    key = F.when(k % 29 == 0, F.floor(k / 1_000_000)).otherwise(k)
    a, b, text = k % 13, k % 11, lambda c: F.lit(c).cast("string")
    form = F.struct(F.when(a == 1, "").otherwise(F.col("p_name")).alias("form"), F.when(a == 2, text(None)).otherwise(F.col("p_type")).alias("morphology"), F.when(a == 3, 0).otherwise(F.col("p_size")).alias("occurrences"))
    some = F.expr("cast(null as int)")
    context = F.struct(
        F.when(b == 1, "").otherwise("1a").alias("ref"), F.col("p_name").alias("form"), F.col("p_type").alias("sentence"), F.lit(0).alias("highlight_start"), F.when(b == 2, 1000).otherwise(2).alias("highlight_end"),
        F.when(b == 3, " ").when(b == 4, text(None)).otherwise(F.col("p_name")).alias("translation"), F.when(b == 5, "guess").when(b == 6, "none").otherwise("exact_phrase").alias("translation_highlight_method"),
        F.when(b == 7, "sure").otherwise("high").alias("translation_highlight_confidence"), F.when(b == 8, some).otherwise(0).alias("translation_highlight_start"), F.when(b == 8, some).otherwise(1).alias("translation_highlight_end"),
    )
    return p.select(
        F.col("p_brand").alias("work_id"), F.when(k % 31 != 0, key).cast("long").alias("id"), F.when(k % 17 == 0, " ").otherwise(F.col("p_name")).alias("lemma"), F.when(k % 19 != 0, F.col("p_type")).alias("definition"),
        F.when(k % 23 == 0, "").otherwise(F.col("p_brand")).alias("pos"), (k % 5).cast("int").alias("level"), (F.col("p_size") - 2).alias("frequency"), F.when(a == 0, F.expr(f"cast(array() as array<{_FORM}>)")).otherwise(F.array(form)).alias("forms"),
        F.when(b == 0, F.lit(None)).otherwise(F.array(context)).alias("contexts"), F.when(b == 9, " ").otherwise(F.col("p_name")).alias("context_definition"), F.when(b == 10, "").otherwise(text(None)).alias("etymology"),
    )


_FORM = "struct<form:string,morphology:string,occurrences:int>"
_FAULTS = {
    "id.missing": "id IS NULL", "id.duplicate": "id IS NOT NULL AND n > 1", "lemma": "trim(lemma) = ''", "definition": "definition IS NULL", "pos": "pos = ''", "level": "level NOT BETWEEN 1 AND 3", "frequency": "frequency <= 0",
    "forms.empty": "a = 0", "forms.form": "a = 1", "forms.morphology": "a = 2", "forms.occurrences": "a = 3", "contexts.text": "b = 1", "contexts.span": "b = 2", "translation": "b = 3", "highlight.method": "b = 5",
    "highlight.confidence": "b = 7", "highlight.bounds": "b IN (6, 8)", "context_definition": "b = 9", "etymology": "b = 10",
}
_OWN = f"(SELECT *, count(*) OVER (PARTITION BY work_id, id) AS n FROM ({_WORDS}))"
_WORD_FAULTS = " UNION ALL ".join(f"SELECT work_id, id, '{code}' AS code FROM {_OWN} WHERE {bad}" for code, bad in _FAULTS.items())


@query("dq_words", _WORD_FAULTS)
def dq_words(spark, d):
    return Q.check_words(words(spark, d))


# metadata with faults by the last digit, and a work without words
_META = "SELECT work_id, work_id AS title, CASE WHEN right(work_id, 1) = '3' THEN '' ELSE 'x' END AS author, CASE WHEN right(work_id, 1) = '4' THEN 0 ELSE sum(frequency) END AS total_words, CASE WHEN right(work_id, 1) = '5' THEN NULL ELSE count(*) FILTER (WHERE a <> 5) END AS unique_lemmas, CASE WHEN right(work_id, 1) = '1' THEN NULL ELSE 'section' END AS reference_system FROM (" + _WORDS + ") GROUP BY work_id UNION ALL SELECT 'Empty', 'Empty', 'x', 10, 5, 'section'"


def meta(spark, d):
    own = table(spark, d, "part").groupBy(F.col("p_brand").alias("work_id"))
    m = own.agg(F.sum(F.col("p_size") - 2).alias("total_words"), F.count_if(F.col("p_partkey") % 13 != 5).alias("unique_lemmas"))
    tail = F.right("work_id", F.lit(1))
    numbers = F.when(tail == "4", 0).otherwise(F.col("total_words")).alias("total_words"), F.when(tail != "5", F.col("unique_lemmas")).alias("unique_lemmas")
    known = m.select("work_id", F.col("work_id").alias("title"), F.when(tail == "3", "").otherwise("x").alias("author"), *numbers, F.when(tail != "1", "section").alias("reference_system"))
    return known.unionByName(spark.createDataFrame([("Empty", "Empty", "x", 10, 5, "section")], known.schema))


_META_FAULTS = f"SELECT work_id, 'metadata.author' AS code FROM ({_META}) WHERE author = '' UNION ALL SELECT work_id, 'metadata.total_words' FROM ({_META}) WHERE total_words IS NULL OR total_words <= 0 UNION ALL SELECT work_id, 'metadata.unique_lemmas' FROM ({_META}) WHERE unique_lemmas IS NULL OR unique_lemmas <= 0"
_WORK_FAULTS = f"SELECT work_id, 'unique_lemmas.count' AS code FROM ({_META}) m JOIN (SELECT work_id, count(*) AS n FROM ({_WORDS}) GROUP BY work_id) USING (work_id) WHERE unique_lemmas <> n UNION ALL SELECT work_id, 'levels.missing' FROM ({_WORDS}) GROUP BY work_id HAVING count(DISTINCT level) FILTER (WHERE level BETWEEN 1 AND 3) < 3 UNION ALL SELECT work_id, 'index.missing' FROM ({_META}) WHERE right(work_id, 1) = '2' UNION ALL SELECT work_id, 'words.empty' FROM ({_META}) WHERE work_id NOT IN (SELECT work_id FROM ({_WORDS}))"


@query("dq_metadata", _META_FAULTS)
def dq_metadata(spark, d):
    return Q.check_metadata(meta(spark, d))


def _works(spark, d):
    m = meta(spark, d)
    return Q.check_works(words(spark, d), m, m.where(F.right("work_id", F.lit(1)) != "2").select(F.col("work_id").alias("id")))


@query("dq_works", _WORK_FAULTS)
def dq_works(spark, d):
    return _works(spark, d)


@query("dq_verdict", f"SELECT work_id, reference_system IS NOT NULL AS has_reference_system, coalesce(n, 0) AS failures, coalesce(n, 0) = 0 AS ok FROM ({_META}) LEFT JOIN (SELECT work_id, count(*) AS n FROM (SELECT work_id FROM ({_WORD_FAULTS}) UNION ALL SELECT work_id FROM ({_META_FAULTS}) UNION ALL SELECT work_id FROM ({_WORK_FAULTS})) GROUP BY work_id) USING (work_id)")
def dq_verdict(spark, d):
    return Q.verdict(meta(spark, d), Q.check_words(words(spark, d)), Q.check_metadata(meta(spark, d)), _works(spark, d))


@query("words_coverage", f"SELECT count(*) AS words, count(*) FILTER (WHERE b <> 9) AS glossed, 0::BIGINT AS etymologies, count(*) FILTER (WHERE b <> 0) AS with_contexts, count(*) FILTER (WHERE b <> 0) AS contexts, count(*) FILTER (WHERE b NOT IN (0, 3, 4)) AS translated, 0::BIGINT AS multi_form, 0::BIGINT AS detailed FROM ({_WORDS})")
def words_coverage(spark, d):
    return Q.coverage(words(spark, d))


@query("unresolved_highlights", f"SELECT work_id, concat_ws(':', CAST(id AS VARCHAR), '0') AS context_id, CASE WHEN trim(coalesce(form, '')) <> '' AND b <> 9 THEN form ELSE definition END AS gloss FROM ({_WORDS}) WHERE b = 6")
def unresolved_highlights(spark, d):
    return E.unresolved(words(spark, d)).select("work_id", "context_id", "gloss")


@query("highlight_methods", f"SELECT CASE b WHEN 5 THEN 'guess' WHEN 6 THEN 'none' ELSE 'exact_phrase' END AS method, count(*) AS n FROM ({_WORDS}) WHERE b NOT IN (0, 3, 4) GROUP BY ALL")
def highlight_methods(spark, d):
    return E.methods(words(spark, d))


@query("request_projection", f"SELECT work_id, id, lemma, CASE WHEN a = 0 THEN '' ELSE form END AS first_form, CAST(CASE WHEN a = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_forms, CASE WHEN b = 0 THEN NULL ELSE sentence END AS first_sentence FROM ({_WORDS}) WHERE a <> 1")
def request_projection(spark, d):
    r = E.requests(words(spark, d).where(F.coalesce(F.get("forms", F.lit(0))["form"], F.lit("x")) != ""), "full")
    return r.select("work_id", "id", "lemma", F.coalesce(F.get("forms", F.lit(0))["form"], F.lit("")).alias("first_form"), F.size("forms").alias("n_forms"), F.get("contexts", F.lit(0))["sentence"].alias("first_sentence"))


@query("form_eligibility", f"SELECT work_id, id, a NOT IN (0, 2) AS eligible FROM ({_WORDS})")
def form_eligibility(spark, d):
    return words(spark, d).select("work_id", "id", K.eligible(F.col("forms")).alias("eligible"))


@query("question_metadata", f"SELECT work_id, id, CAST(CASE WHEN a = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_forms, CAST(CASE WHEN b = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_contexts FROM ({_WORDS})")
def question_metadata(spark, d):
    w = words(spark, d)
    m = K.metadata(w.withColumn("id", F.struct("work_id", "id")))
    return m.select("id.work_id", "id.id", F.size("forms").alias("n_forms"), F.size("contexts").alias("n_contexts"))


_ANSWERS = "SELECT user_id AS session_id, event_id AS question_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS question_index, event_type AS user_answer, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END AS correct_answer, user_id % 5 = 0 AS review FROM events"


def answers(spark, d):
    from pyspark.sql.window import Window as W

    e = table(spark, d, "events")
    own = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("question_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("question_index"), F.col("event_type").alias("user_answer"))
    questions = e.select(F.col("event_id").alias("question_id"), F.when(F.col("event_id") % 2 == 0, "view").otherwise("click").alias("correct_answer"))
    return K.graded(own, questions), questions


@query("graded_answers", f"SELECT session_id, question_id, user_answer = correct_answer AS correct FROM ({_ANSWERS})")
def graded_answers(spark, d):
    return answers(spark, d)[0].select("session_id", "question_id", "correct")


@query("wrong_answers", f"SELECT session_id, question_id FROM ({_ANSWERS}) WHERE user_answer <> correct_answer")
def wrong_answers(spark, d):
    return X.wrong_answers(answers(spark, d)[0]).select("session_id", "question_id")


@query("review_sessions", f"SELECT session_id AS parent_session_id, question_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY question_index) - 1 AS INTEGER) AS question_index, correct_answer, 'review' AS kind FROM ({_ANSWERS}) WHERE user_answer <> correct_answer AND NOT review")
def review_sessions(spark, d):
    a, q = answers(spark, d)
    s = a.select("session_id").distinct().withColumn("kind", F.when(F.col("session_id") % 5 == 0, "review").otherwise("study"))
    return X.review(a, q, s).select("parent_session_id", "question_id", "question_index", "correct_answer", "kind")


# One saved session a customer, with fields missing by remainders of the key.
_SAVED = "SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'review' END AS kind, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 4 END AS n, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 9 - 2 END AS i, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS ended FROM customer"


def saved(spark, d):
    k = F.col("c_custkey")
    questions = F.when(k % 7 != 0, F.slice(F.array(F.lit("q0"), F.lit("q1"), F.lit("q2")), F.lit(1), (k % 4).cast("int")))
    return table(spark, d, "customer").select(k.alias("session_id"), F.lit(1).alias("version"), F.when(k % 3 != 0, "review").alias("kind"), questions.alias("questions"), F.when(k % 5 != 0, k % 9 - 2).cast("int").alias("question_index"), F.when(k % 6 != 0, k % 6 == 1).alias("ended"))


_CLAMPED = "greatest(0, least(coalesce(i, 0), coalesce(n, 0) - 1))"


@query("restored_sessions", f"SELECT session_id, 3 AS version, coalesce(kind, 'study') AS kind, CAST(coalesce(n, 0) AS INTEGER) AS n_questions, CAST({_CLAMPED} AS INTEGER) AS question_index, coalesce(ended, false) AS ended FROM ({_SAVED})")
def restored_sessions(spark, d):
    return X.restored(saved(spark, d)).select("session_id", "version", "kind", F.size("questions").alias("n_questions"), "question_index", "ended")


@query("resumable_sessions", f"SELECT session_id FROM ({_SAVED}) WHERE n > 0 AND i IS NOT NULL AND NOT coalesce(ended, false)")
def resumable_sessions(spark, d):
    return X.resumable(saved(spark, d)).select("session_id")


@query("session_cursor", f"SELECT session_id, CASE WHEN NOT coalesce(ended, false) AND coalesce(n, 0) > 0 THEN 'q' || CAST({_CLAMPED} AS VARCHAR) END AS current, CAST(CASE WHEN coalesce(ended, false) THEN {_CLAMPED} ELSE least({_CLAMPED} + 1, coalesce(n, 0) - 1) END AS INTEGER) AS next FROM ({_SAVED})")
def session_cursor(spark, d):
    s = X.restored(saved(spark, d))
    at, ended = F.col("question_index"), F.col("ended")
    return s.select("session_id", X.cursor(F.col("questions"), at, ended).alias("current"), X.step(at, F.size("questions"), F.lit(True), ended).cast("int").alias("next"))


@query("appended_questions", "SELECT c_nationkey AS session_id, c_custkey AS question_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 2 DESC, c_custkey) - 1 AS question_index FROM customer")
def appended_questions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("question_id"))
    from pyspark.sql.window import Window as W

    odd = c.where("question_id % 2 = 1").withColumn("question_index", F.row_number().over(W.partitionBy("session_id").orderBy("question_id")).cast("long") - 1)
    return X.appended(odd, c.where("question_id % 2 = 0"), "session_id", "question_id")


_DICT = "SELECT p_brand AS headword, p_name AS gloss, p_partkey AS ord FROM part"


@query("last_entry_wins", f"SELECT headword, arg_max(gloss, ord) AS gloss FROM ({_DICT}) GROUP BY headword")
def last_entry_wins(spark, d):
    return L.last_wins(_entries(spark, d), "headword", "gloss", "ord")


def _entries(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("headword"), F.col("p_name").alias("gloss"), F.col("p_partkey").alias("ord"))


@query("joined_glosses", "SELECT c_mktsegment AS headword, string_agg(n, ', ' ORDER BY n) AS glosses FROM (SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS n FROM customer) GROUP BY c_mktsegment")
def joined_glosses(spark, d):
    names = table(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("n")).distinct()
    lists = names.groupBy("c_mktsegment").agg(F.sort_array(F.collect_list("n")).alias("g"))
    return lists.select(F.col("c_mktsegment").alias("headword"), L.join_glosses(F.concat("g", "g")).alias("glosses"))


@query("id_list_union", "SELECT o_custkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS ids FROM (SELECT o_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 2 = 0), []) AS a, list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AS b FROM orders GROUP BY o_custkey) WHERE b IS NOT NULL")
def id_list_union(spark, d):
    key = F.col("o_orderkey")
    ids = lambda keep: F.sort_array(F.collect_list(F.when(keep, key)))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(ids(key % 2 == 0).alias("a"), ids((key % 3 != 0) | (key % 2 == 0)).alias("b"))
    return lists.where(F.size("b") > 0).select("o_custkey", F.array_join(E.id_union(F.col("a"), F.col("b")), ",").alias("ids"))


@query("chunk_status", "SELECT status, count(*) AS chunks FROM (SELECT CASE WHEN NOT bool_and(p_partkey % 97 <> 0) THEN 'pending' WHEN bool_or(p_partkey % 89 = 0) THEN 'failed' ELSE 'completed' END AS status FROM part GROUP BY p_partkey // 10) GROUP BY status")
def chunk_status(spark, d):
    key = F.col("p_partkey")
    p = table(spark, d, "part").select(key.alias("word_id"), F.floor(key / 10).alias("chunk"))
    return R.status(p, p.where("word_id % 97 <> 0").select("word_id", F.when(F.col("word_id") % 89 == 0, "bad").alias("error")))


@query("pending_chunks", "SELECT DISTINCT p_partkey // 10 AS chunk FROM part WHERE (p_partkey // 10) % 3 <> 0")
def pending_chunks(spark, d):
    chunks = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("chunk")).distinct()
    return R.pending(chunks, chunks.where("chunk % 3 = 0"))


@query("escaped_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escaped_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("lemma_previews", "SELECT p_brand, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN '...' ELSE '' END AS preview FROM (SELECT p_brand, list(p_name ORDER BY p_name, p_partkey) AS l FROM part WHERE p_size > 48 GROUP BY p_brand)")
def lemma_previews(spark, d):
    some = table(spark, d, "part").where("p_size > 48").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_name", "p_partkey"))).alias("l"))
    return some.select("p_brand", T.preview(F.transform("l", lambda x: x["p_name"])).alias("preview"))


@query("label_maps", "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'Beginner' WHEN 2 THEN 'Intermediate' WHEN 3 THEN 'Advanced' ELSE 'Level 0' END AS level_label, lower(p_brand) || ', ' || p_name AS morphology FROM part")
def label_maps(spark, d):
    return table(spark, d, "part").select("p_partkey", T.level_label(F.col("p_size") % 4).alias("level_label"), T.morphology(F.col("p_brand"), F.array(F.lit(""), F.col("p_name"), F.lit(None))).alias("morphology"))


@query("form_lemmas", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM documents WHERE text IS NOT NULL), f AS (SELECT DISTINCT w AS form, left(w, k) AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), (SELECT unnest([3, 4]) AS k)) SELECT lemma, form, count(*) AS occurrences FROM t JOIN f USING (form) GROUP BY ALL")
def form_lemmas(spark, d):
    token = lambda t: F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("form")
    forms = table(spark, d, "benchmark").select(token("text")).distinct()
    forms = forms.select("form", F.explode(F.array(F.left("form", F.lit(3)), F.left("form", F.lit(4)))).alias("lemma")).distinct()
    return L.by_form(table(spark, d, "documents").select(token("text")), forms)


@query("vocabulary_totals", "SELECT lang, CAST(sum(length(text) - length(replace(text, ' ', ''))) AS BIGINT) AS total_words, count(DISTINCT source) AS unique_lemmas FROM documents WHERE text IS NOT NULL GROUP BY lang")
def vocabulary_totals(spark, d):
    from lexispark.operators import vocab as V

    n = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    per = table(spark, d, "documents").where("text IS NOT NULL").groupBy("lang", F.col("source").alias("lemma")).agg(F.sum(n).alias("frequency"))
    return V.totals(per, "lang")
