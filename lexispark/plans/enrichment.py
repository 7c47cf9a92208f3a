"""Enrichment and data-quality queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import enrich as E
from lexispark.operators import vocab as V
from lexispark.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


@query("select_with_offset_limit", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 50 OFFSET 20")
def select_with_offset_limit(spark, d):
    return table(spark, d, "part").where("p_size > 10").orderBy("p_partkey").offset(20).limit(50).select("p_partkey", "p_name")


@query("ordered_semi_join", "WITH ids AS (SELECT min(pos) AS pos, o_orderkey FROM (SELECT unnest(range(0, 6)) AS pos, unnest([33, 7, 1, 33, 999999999, 2]) AS o_orderkey) GROUP BY o_orderkey) SELECT CAST(pos AS INTEGER) AS pos, o_orderkey, o_custkey FROM orders JOIN ids USING (o_orderkey)")
def ordered_semi_join(spark, d):
    ids = spark.range(1).select(F.posexplode(E.id_list(F.lit("33, 7,1,,33,999999999,2"))).alias("pos", "o_orderkey"))
    found, _ = E.ordered_semi_join(table(spark, d, "orders"), ids, "o_orderkey")
    return found.select("pos", "o_orderkey", "o_custkey")


@query("chunk_assign", "SELECT p_brand, p_partkey, CAST(floor((r - 1) / greatest(ceil(n / 4), 1)) AS BIGINT) AS balanced, CAST(floor((r - 1) / 5) AS BIGINT) AS fixed FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def chunk_assign(spark, d):
    p = table(spark, d, "part").withColumn("name", F.lpad(F.col("p_partkey").cast("string"), 20, "0"))
    r = V.ranked(p, ["p_brand"], "p_size", "name", prefix=18)
    both = E.chunked(r, F.col("rank"), E.balanced_size(F.col("n"), 4)).withColumnRenamed("chunk", "balanced")
    return E.chunked(both, F.col("rank"), F.lit(5)).select("p_brand", "p_partkey", "balanced", F.col("chunk").alias("fixed"))


@query("chunk_totals", "SELECT p_size AS chunk, count(*) AS lemmas, CAST(sum(p_partkey) AS BIGINT) AS total FROM part GROUP BY p_size")
def chunk_totals(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_size").alias("chunk")).agg(F.count("*").alias("lemmas"), F.sum("p_partkey").alias("total"))


@query("one_to_one_check", "WITH g AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 3 FROM labels WHERE quality = 0) GROUP BY doc_id) SELECT coalesce(d.doc_id, g.doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN g ON d.doc_id = g.doc_id")
def one_to_one_check(spark, d):
    lab = table(spark, d, "labels")
    got = lab.select("doc_id").unionByName(lab.where("quality = 0").select((F.col("doc_id") + 3).alias("doc_id")))
    return E.one_to_one(table(spark, d, "documents"), got, "doc_id")


_ORIG = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS gloss, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS etymology FROM documents"
_CHUNK = "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS gloss, 'toxic ' || toxic AS etymology FROM labels"


@query("fill_missing_merge", f"SELECT doc_id, coalesce(nullif(o.gloss, ''), nullif(c.gloss, '')) AS gloss, coalesce(nullif(o.etymology, ''), nullif(c.etymology, '')) AS etymology, coalesce(nullif(o.gloss, ''), nullif(c.gloss, ''), '') <> coalesce(o.gloss, '') OR coalesce(nullif(o.etymology, ''), nullif(c.etymology, ''), '') <> coalesce(o.etymology, '') AS changed FROM ({_ORIG}) o LEFT JOIN ({_CHUNK}) c USING (doc_id)")
def fill_missing_merge(spark, d):
    o = table(spark, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(F.col("lang")).alias("gloss"), F.when(F.pmod("doc_id", F.lit(2)) != 0, F.col("source")).alias("etymology"))
    c = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("gloss"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("etymology"))
    return E.fill_missing(o, c, "doc_id", ["gloss", "etymology"])


_TURNS = "SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS replies FROM conversations GROUP BY conv_id"


@query("positional_zip", f"SELECT conv_id, CAST(i - 1 AS INTEGER) AS ctx_index, roles[i] AS form, nullif(replies[i], '') AS translation FROM (SELECT conv_id, roles, replies, unnest(range(1, len(roles) + 1)) AS i FROM ({_TURNS}))")
def positional_zip(spark, d):
    t = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(t.alias("t"))
    g = g.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("form"), F.lit(None).cast("string").alias("translation"))).alias("c"), F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: x["text"]).alias("a"))
    z = g.select("conv_id", F.posexplode(E.zip_translations(F.col("c"), F.col("a"))).alias("ctx_index", "c"))
    return z.select("conv_id", "ctx_index", "c.form", "c.translation")


_W = "SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE lang END AS g, CASE WHEN toxic = 1 THEN source END AS e, [{'morphology': CASE WHEN d.doc_id % 5 = 0 THEN 'noun' ELSE 'noun, singular' END}, {'morphology': lang}] AS f, [{'translation': CASE WHEN quality = 1 THEN 'x' ELSE '' END}] AS c FROM documents d LEFT JOIN labels USING (doc_id)"
_BARE = "len(list_filter(f, lambda x: NOT regexp_matches(trim(x.morphology), '[ ,]'))) > 0"


@query("needs_enrichment", f"SELECT doc_id, e IS NULL OR e = '' AS etymology_only, {_BARE} AS morph_only, g = '' OR len(list_filter(c, lambda x: x.translation = '')) > 0 OR {_BARE} AS full_mode, len(list_filter(f, lambda x: regexp_matches(trim(x.morphology), '[ ,]'))) > 0 AS detailed FROM ({_W})")
def needs_enrichment(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    form = lambda c: F.struct(c.alias("morphology"))
    w = j.select(
        "doc_id",
        F.when(F.pmod("doc_id", F.lit(4)) == 0, "").otherwise(F.col("lang")).alias("g"),
        F.when(F.col("toxic") == 1, F.col("source")).alias("e"),
        F.array(form(F.when(F.pmod("doc_id", F.lit(5)) == 0, "noun").otherwise("noun, singular")), form(F.col("lang"))).alias("f"),
        F.array(F.struct(F.when(F.col("quality") == 1, "x").otherwise("").alias("translation"))).alias("c"),
    )
    need = lambda mode: E.needs_enrichment(mode, F.col("f"), F.col("c"), F.col("g"), F.col("e"))
    return w.select("doc_id", need("etymology-only").alias("etymology_only"), need("morph-only").alias("morph_only"), need("full").alias("full_mode"), E.detailed(F.col("f")).alias("detailed"))
