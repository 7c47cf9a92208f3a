"""Queries of file formats: Spark writes files from the tables, the readers read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.plans import contracts
from lexispark.session import scratch, table
from lexispark.sources import readers as R
from lexispark.sources import writers as WR

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


# -- structured texts: a document's lines are paragraphs in chapters of books, by four plans

_CLEAN = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g')"


@query(
    "tei_sections",
    rf"""WITH d AS (SELECT doc_id, doc_id % 4 AS plan, lang, string_split({_CLEAN}, chr(10)) AS ln FROM documents),
    l AS (SELECT doc_id, plan, lang, i, ln[i] AS line FROM (SELECT *, unnest(range(1, len(ln) + 1)) AS i FROM d)),
    s AS (SELECT doc_id, CASE plan WHEN 1 THEN CAST(i AS VARCHAR) ELSE '2' || CAST(i AS VARCHAR) || 'a' END AS ref, line || ' ' || line AS text, i FROM l WHERE plan > 0 AND plan < 3 AND regexp_matches(line, '[^\x09\x0A\x0D\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')),
    w AS (SELECT doc_id, '1' AS ref, array_to_string(ln, ' ') AS text, 1 AS i FROM d WHERE plan = 0 OR (plan < 3 AND doc_id NOT IN (SELECT doc_id FROM s))),
    x AS (SELECT * FROM s UNION ALL SELECT * FROM w)
    SELECT CAST(doc_id AS VARCHAR) AS work_id, 'Doc ' || doc_id AS title, CASE WHEN lang IS NULL THEN 'Unknown' ELSE 'A. ' || lang END AS author, CASE plan WHEN 0 THEN 'unknown' WHEN 1 THEN 'section' ELSE 'book-chapter' END AS reference_system,
     CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section_ord, ref, sha256(text) AS text_sha256, false AS failed FROM x JOIN (SELECT doc_id, plan, lang FROM d) USING (doc_id)
    UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, 'unknown', NULL, NULL, NULL, true FROM d WHERE plan = 3""",
)
def tei_sections(spark, d):
    """Plan 0: no divisions; 1: sections; 2: books with chapters; 3: no body, an error. Each
    paragraph but those of plan 0 comes twice, once behind a label and a page break."""
    docs = table(spark, d, "documents")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plan, lines = F.col("doc_id") % 4, F.split(safe(clean), "\n", -1)
    twice = lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>\n<p><label>no <b>text</b></label>"), x, F.lit("<pb n='3'/></p>"))
    number = lambda i: (i + 1).cast("string")
    flat = F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    sections = F.transform(lines, lambda x, i: F.concat(F.lit('<div type="Section" n="'), number(i), F.lit('">'), twice(x), F.lit("</div>")))
    chapters = F.transform(lines, lambda x, i: F.concat(F.lit('<div type="chapter" n="'), number(i), F.lit('"><div n="a">'), twice(x), F.lit("</div></div>")))
    body = F.when(plan == 0, F.array_join(flat, "")).when(plan == 1, F.array_join(sections, "\n")).otherwise(F.concat(F.lit('<div type="textpart" subtype="Book" n="2">'), F.array_join(chapters, ""), F.lit("</div>")))
    author = F.when(F.col("lang").isNotNull(), F.concat(F.lit("<author> A. "), F.col("lang"), F.lit(" Phil.</author>"))).otherwise(F.lit(""))
    head = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Doc '), F.col("doc_id").cast("string"), F.lit(" </title>"), author, F.lit("</titleStmt></fileDesc></teiHeader><text>"))
    whole = F.when(plan == 3, F.lit("")).otherwise(F.concat(F.lit("<body>"), body, F.lit("</body>")))
    got = R.tei(docs.select(F.col("doc_id").alias("work_id"), F.concat(head, whole, F.lit("</text></TEI>")).alias("xml")))
    return got.select("work_id", "title", "author", "reference_system", "section_ord", "ref", F.sha2("text", 256).alias("text_sha256"), F.col("error").isNotNull().alias("failed"))


# -- dictionaries: three files of entries, some faulty, some headwords in more than one


_BETA = "translate(regexp_replace(k, 's(?:$)', 'ς'), 'abgdezhqiklmncoprstufxyw', 'αβγδεζηθικλμνξοπρστυφχψω')"


@query(
    "dictionary_files",
    rf"""WITH p AS (SELECT p_partkey AS i, p_partkey % 3 AS f, regexp_replace(lower(p_brand), '[^a-z]', '', 'g') || CASE p_partkey % 4 WHEN 0 THEN 's' ELSE chr(CAST(97 + p_partkey % 8 AS INTEGER)) END || translate(CAST(p_partkey // 6 AS VARCHAR), '0123456789', 'abgdezhqik') || CASE WHEN p_partkey % 5 = 0 THEN 's' ELSE '' END AS k, p_type AS g, p_name AS n FROM part),
    e AS (SELECT i, f, {_BETA} AS headword, CASE WHEN i % 11 = 0 THEN n || ', ' || g ELSE g || ', ' || n END AS definition FROM p WHERE i % 7 <> 0 AND i % 13 <> 0)
    SELECT headword, arg_max(definition, f) AS definition FROM (SELECT headword, f, arg_min(definition, i) AS definition FROM e GROUP BY headword, f) GROUP BY headword""",
)
def dictionary_files(spark, d):
    """Key 7: an entry with a fault before its gloss; 13: without one; 11: the glosses stand
    behind a first sense that has none that can be used; the others have one twice."""
    i = F.col("p_partkey")
    end = F.when(i % 4 == 0, "s").otherwise(F.chr(97 + i % 8))
    key = F.concat(F.regexp_replace(F.lower("p_brand"), "[^a-z]", ""), end, F.translate(F.floor(i / 6).cast("string"), "0123456789", "abgdezhqik"), F.when(i % 5 == 0, "s").otherwise(""))
    # a rough breathing and capitals, which the headword doesn't keep apart, stay out: marks are tested elsewhere
    tr = lambda c: F.concat(F.lit("<tr>"), c, F.lit("</tr>"))
    g, n = F.col("p_type"), F.col("p_name")
    usual = F.concat(F.lit("<sense>"), tr(F.concat(g, F.lit(",; "))), tr(F.lower(g)), F.lit("<b>x</b>"), tr(n), tr(F.lit("cf.")), F.lit("</sense><sense><tr>second</tr></sense>"))
    body = F.when(i % 7 == 0, F.concat(F.lit("<sense><b></sense>"), tr(g))).when(i % 13 == 0, F.lit("<sense/>")).when(i % 11 == 0, F.concat(F.lit("<sense><tr>v.</tr></sense>"), tr(n), tr(g))).otherwise(usual)
    name = F.when(i % 2 == 0, "entry").otherwise("entryFree")
    head = F.concat(F.lit("<"), name, F.lit(' type="main" key="'), F.concat(F.when(i % 3 == 0, "*").otherwise(""), key), F.lit('"><orth>none</orth>&mdash; '))
    rows = table(spark, d, "part").select((i % 3).alias("file"), i.alias("i"), F.concat(head, body, F.lit("</"), name, F.lit(">")).alias("value"))
    path = scratch(spark)
    rows.repartition(3, "file").sortWithinPartitions("file", "i").select("file", "value").write.partitionBy("file").text(path)
    return R.dictionary(R.dictionary_files(spark, path))


# -- vocabularies: one JSON document a work


@query("vocabulary_files", f"SELECT work_id, id, lemma, definition, level, CAST(frequency AS BIGINT) AS frequency, CASE WHEN a = 0 THEN 0 ELSE 1 END AS n_forms, CASE WHEN a = 1 THEN '' WHEN a <> 0 THEN form END AS form, CASE WHEN b = 0 THEN NULL WHEN b = 2 THEN 1000 ELSE 2 END AS highlight_end, work_id AS title FROM ({contracts._WORDS}) WHERE id IS NOT NULL")
def vocabulary_files(spark, d):
    w, path = contracts.words(spark, d).where("id IS NOT NULL"), scratch(spark)
    forms = F.transform("forms", lambda f: f.withField("occurrences", f["occurrences"].cast("long")))
    WR.vocab_json(w.withColumn("forms", forms), contracts.meta(spark, d), path)
    v = R.vocab_json(spark, path)
    words = R.words_of(v).join(v.select(F.col("metadata.work_id").alias("work_id"), "metadata.title"), "work_id")
    one = F.get("forms", F.lit(0))
    return words.select("work_id", "id", "lemma", "definition", "level", "frequency", F.size("forms").alias("n_forms"), one["form"].alias("form"), F.get("contexts", F.lit(0))["highlight_end"].alias("highlight_end"), "title")


@query("id_list_files", "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, o_orderkey AS id FROM orders")
def id_list_files(spark, d):
    """A file of ids for each key: JSON arrays for even keys, one id a line for odd ones."""
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    even = F.col("o_custkey") % 2 == 0
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(ids.alias("ids")).select("o_custkey", F.when(even, F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]"))).otherwise(F.array_join("ids", "\n")).alias("value"))
    return lists.select("o_custkey", F.posexplode(R.ids_of("value")).alias("pos", "id"))


# -- answers of a provider, bare, fenced and wrapped


@query(
    "unwrapped_responses",
    "SELECT event_id, event_id % 7 IN (3, 6) AS failed, CASE WHEN event_id % 7 NOT IN (3, 6) THEN event_type END AS lemma, CASE WHEN event_id % 7 NOT IN (3, 6) THEN 'g' || user_id END AS gloss FROM events",
)
def unwrapped_responses(spark, d):
    """By key: bare, fenced, in an object, in one whose first key is no list, under another
    key, in an object without a list, no JSON."""
    e = table(spark, d, "events")
    row = F.concat(F.lit('[{"lemma": "'), F.col("event_type"), F.lit('", "gloss": "g'), F.col("user_id").cast("string"), F.lit('"}]'))
    kind = F.col("event_id") % 7
    around = lambda a, b: F.concat(F.lit(a), row, F.lit(b))
    text = (
        F.when(kind == 0, row).when(kind == 1, around("```json\n", "\n```")).when(kind == 2, around('{"enrichments": ', "}")).when(kind == 3, F.lit('{"enrichments": "none", "response": {"a": 1}}'))
        .when(kind == 4, around('{"enrichments": "x", "response": {}, "results": ', "}")).when(kind == 5, around('  ```\n{"response": ', "}\n```  ")).otherwise(F.lit("sorry"))
    )
    got = R.responses(e.select("event_id", text.alias("response")), "struct<lemma:string,gloss:string>")
    return got.select("event_id", F.col("error").isNotNull().alias("failed"), "r.lemma", "r.gloss")


_STORED = "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN value END AS value FROM events"


@query("stored_state", f"SELECT event_id, coalesce(value, -1) AS value FROM ({_STORED})")
def stored_state(spark, d):
    """Stored JSON with the default where it is malformed, absent, or no object."""
    kind = F.col("event_id") % 5
    text = F.when(kind < 2, F.concat(F.lit('{"value": '), F.col("value").cast("string"), F.lit("}"))).when(kind == 2, F.lit("{broken")).when(kind == 3, F.lit(""))
    e = table(spark, d, "events").select("event_id", text.alias("text"), "value")
    return e.select("event_id", F.coalesce(R.state(F.col("text"), "struct<value:double>", '{"value": -1}')["value"], F.lit(-1.0)).alias("value"))
