"""Queries of verdicts over all works, session details, seeded orders, and of answers to
single contexts and forms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.operators import enrich as E
from lexispark.operators import highlight as H
from lexispark.operators import questions as K
from lexispark.operators import quality as Q
from lexispark.operators import sessions as X
from lexispark.plans import contracts, study
from lexispark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


@query("dq_run_verdict", f"SELECT count(*) AS works, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(failures) AS BIGINT) AS failures, bool_and(ok) AS ok FROM ({contracts.ORACLES['dq_verdict']})")
def dq_run_verdict(spark, d):
    return Q.run_verdict(contracts.dq_verdict(spark, d))


@query(
    "session_details",
    f"SELECT s.*, details FROM ({study.ORACLES['session_summary']}) s JOIN (SELECT user_id, sha256(string_agg(i || ':' || event_id || ':' || correct, ',' ORDER BY i)) AS details FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM ({study._A})) GROUP BY user_id) USING (user_id)",
)
def session_details(spark, d):
    """Statistics of each session with its answers in order."""
    ordered = W.partitionBy("user_id").orderBy("ts", "event_id")
    a = study.answers(spark, d).withColumn("question_index", F.row_number().over(ordered) - 1).withColumn("question_id", F.col("event_id")).withColumnRenamed("user_id", "session_id")
    told = F.transform("answers", lambda x: F.concat_ws(":", x["question_index"].cast("string"), x["question_id"].cast("string"), x["correct"].cast("string")))
    out = X.summary(a).withColumn("details", F.sha2(F.array_join(told, ","), 256)).withColumnRenamed("session_id", "user_id")
    return out.select(*study.session_summary(spark, d).columns, "details")


@query("seeded_shuffle", "SELECT p_partkey, (SELECT string_agg(x, '|' ORDER BY md5('7|' || p_partkey || '|' || i)) FROM (SELECT unnest([p_name, p_brand, p_type, p_name]) AS x, unnest([0, 1, 2, 3]) AS i)) AS shuffled FROM part")
def seeded_shuffle(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(K.shuffled(F.array("p_name", "p_brand", "p_type", "p_name"), [F.col("p_partkey")], 7), "|").alias("shuffled"))


# documents stand for contexts, their texts for translations; some answers are unsure, unplaced or unknown
_ASKED = "SELECT doc_id, coalesce(text, '') AS t, CASE doc_id % 3 WHEN 0 THEN 'The' WHEN 1 THEN 'en' ELSE 'ER' END AS needle, greatest(doc_id % 4, 1) AS k, CASE doc_id % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'low' ELSE 'high' END AS sure FROM documents"
_PLACED = f"""SELECT *, CASE WHEN len(p) > k THEN list_sum(list_transform(p[:k], lambda x: length(x))) + (k - 1) * length(needle) END AS own, CASE WHEN len(q) > k THEN list_sum(list_transform(q[:k], lambda x: length(x))) + (k - 1) * length(needle) END AS folded
FROM (SELECT *, string_split(t, needle) AS p, string_split(lower(t), lower(needle)) AS q FROM ({_ASKED}))"""


@query(
    "aligned_highlights",
    f"""SELECT CAST(doc_id AS VARCHAR) || ':0' AS context_id, CASE WHEN spot IS NULL THEN 'none' ELSE 'model_align' END AS method, CASE WHEN spot IS NULL THEN 'low' ELSE sure END AS confidence, CAST(spot AS INTEGER) AS start, CAST(spot + length(needle) AS INTEGER) AS "end"
FROM (SELECT *, CASE WHEN sure <> 'low' AND doc_id % 7 <> 0 THEN coalesce(own, folded) END AS spot FROM ({_PLACED}))""",
)
def aligned_highlights(spark, d):
    key = F.col("doc_id")
    docs = table(spark, d, "documents").select(key, F.concat(key.cast("string"), F.lit(":0")).alias("context_id"), F.coalesce("text", F.lit("")).alias("translation"))
    needle = F.when(key % 3 == 0, "The").when(key % 3 == 1, "en").otherwise("ER")
    sure = F.when(key % 5 == 0, "medium").when(key % 5 == 1, "low").otherwise("high")
    answers = docs.where(key % 7 != 0).select("context_id", needle.alias("matched_text"), (key % 4).cast("int").alias("occurrence"), sure.alias("confidence"))
    unknown = answers.withColumn("context_id", F.concat("context_id", F.lit("9")))  # ids that nothing asked about
    got = H.align(docs.select("context_id", "translation"), answers.unionByName(unknown))
    return got.select("context_id", "method", "confidence", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


_BARE = "(NOT regexp_matches(trim(coalesce({0}, '')), '[ ,]'))"
_FORMS = "SELECT p_partkey, p_partkey % 4 AS a, CASE p_partkey % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'noun, sg' ELSE '' END AS m0, p_type AS m1, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS new FROM part"
_NEW = {c: f"CASE WHEN a {on} AND new <> '' THEN new ELSE {c} END" for c, on in (("m0", "<> 1"), ("m1", "IN (1, 2)"))}


@query("answered_morphology", f"SELECT p_partkey, {_NEW['m0']} AS m0, {_NEW['m1']} AS m1, CASE WHEN {_BARE.format('m0')} THEN {_NEW['m0']} ELSE m0 END AS bare0, CASE WHEN {_BARE.format('m1')} THEN {_NEW['m1']} ELSE m1 END AS bare1 FROM ({_FORMS})")
def answered_morphology(spark, d):
    """Forms take the morphology that an answer has for the same form: all, and only bare ones."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    form = lambda f, m: F.struct(F.lit(f).alias("form"), m.alias("morphology"))
    forms = F.array(form("a", F.when(k % 3 == 0, "noun").when(k % 3 == 1, "noun, sg").otherwise("")), form("b", F.col("p_type")))
    new = F.when(k % 5 == 0, "").otherwise(F.col("p_brand"))
    answer = F.when(k % 4 == 1, F.array(form("b", new), form("x", new))).when(k % 4 == 2, F.array(form("b", new), form("a", new))).otherwise(F.array(form("a", new)))
    both = p.select("p_partkey", *[E.merge_morphology(forms, answer, only).alias(n) for n, only in (("every", False), ("bare", True))])
    return both.select("p_partkey", *[F.col(f)[i]["morphology"].alias(f"{n}{i}") for f, n in (("every", "m"), ("bare", "bare")) for i in range(2)])
