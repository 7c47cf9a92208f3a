"""Highlights of every document against a gloss of its own, and the SQL of the whole rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import highlight as H
from lexispark.operators import vocab as V
from lexispark.plans import vocabulary
from lexispark.session import table

QUERIES: dict = {}
ORACLES: dict = {}

_WORD = "[A-Za-z]+(?:''[A-Za-z]+)?"
#: Characters of words, as \b of the engine takes them.
_IN = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_OUT = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_SPACED = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def _values(pairs) -> str:
    return "VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(pairs))


def _stem(w: str) -> str:
    base = {form: min(forms.split()) for form, forms in H.SURFACE.items()}
    out = "CASE " + " ".join(f"WHEN {w} = '{form}' THEN '{b}'" for form, b in base.items())
    for s, n in T.SUFFIXES:
        cut = f"left({w}, length({w}) - 3) || 'y'" if s in ("ied", "ies") else f"left({w}, length({w}) - {len(s)})"
        out += f" WHEN ends_with({w}, '{s}') AND length({w}) >= {n} THEN {cut}"
    return f"{out} ELSE {w} END"


def _phrases(source: str) -> str:
    """rank, pi, vi, v of the phrases of a text's parts."""
    words = ", ".join(f"'{w}'" for w in H.FUNCTION_WORDS)
    return f"""SELECT rank, pi, unnest(range(1, len(vs) + 1)) AS vi, {_SPACED.format('unnest(vs)')} AS v FROM (
 SELECT rank, pi, list_concat([part, replace(part, '-', ' ')], c, CASE WHEN len(c) < 2 THEN [] ELSE list_concat([array_to_string(c, ' ')], list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])) END) AS vs
 FROM (SELECT *, list_filter(regexp_extract_all(replace(part, '-', ' '), '{_WORD}'), lambda x: x NOT IN ({words})) AS c
 FROM (SELECT rank, unnest(range(1, len(ps) + 1)) AS pi, {_SPACED.format('unnest(ps)')} AS part FROM (SELECT rank, string_split_regex(lower(coalesce({source}, '')), '[,;/()]') AS ps FROM items)) WHERE part <> ''))"""


_LISTED = lambda table: _values([(k, v) for k, vs in table.items() for v in (vs.split() if isinstance(vs, str) else vs)])
_FIRST = "CASE WHEN regexp_matches(left(p, 1), '{i}') THEN '(?:^|{o})' ELSE '{i}' END".format(i=_IN, o=_OUT)
_LAST = "CASE WHEN regexp_matches(right(p, 1), '{i}') THEN '(?:$|{o})' ELSE '{i}' END".format(i=_IN, o=_OUT)
_PATTERN = f"'(?s)^(.*?' || {_FIRST} || ')' || regexp_escape(p) || {_LAST}"

HIGHLIGHTS = rf"""WITH surface(w, form, i) AS ({_LISTED(H.SURFACE)}), rendering(w, form, i) AS ({_LISTED(H.RENDERINGS)}), other(w, form, i) AS ({_LISTED(H.PHRASES)}),
n AS (SELECT row_number() OVER (ORDER BY CAST(item_id AS VARCHAR)) AS rank, text, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM benchmark),
c AS (SELECT *, trim(split_part(t, ';', 1)) AS clause, {vocabulary._STOPS} AS stops, left(t, 80) AS head FROM n), s AS (SELECT *, CASE WHEN len(stops) > 0 THEN trim(left(t, stops[1] - 1)) ELSE t END AS sent FROM c),
items AS (SELECT rank, text AS definition, CASE WHEN coalesce(t, '') = '' THEN '' WHEN contains(t, ';') AND length(clause) BETWEEN 3 AND 80 THEN clause WHEN sent <> t AND length(sent) BETWEEN 3 AND 80 THEN sent
 WHEN length(t) <= 80 THEN t WHEN contains(head, ' ') THEN regexp_extract(head, '^(.*) ', 1) || '…' ELSE head || '…' END AS gloss FROM s),
of_gloss AS ({_phrases('gloss')}), of_definition AS ({_phrases('definition')}),
chosen AS (SELECT * FROM of_gloss WHERE length(v) >= 3 UNION ALL SELECT * FROM of_definition WHERE length(v) >= 3 AND rank NOT IN (SELECT rank FROM of_gloss WHERE length(v) >= 3)),
cand AS (SELECT rank, v, min((pi, vi)) AS o FROM chosen GROUP BY rank, v),
tried AS (SELECT rank, -length(v) AS l, o, -1 AS i, v AS p, 'exact_phrase' AS m FROM cand UNION ALL SELECT rank, -length(v), o, i, form, 'phrase_override' FROM cand JOIN other ON w = v),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, lower(text) AS low, (doc_id % (SELECT nullif(count(*), 0) FROM items) + (SELECT count(*) FROM items)) % (SELECT nullif(count(*), 0) FROM items) + 1 AS rank FROM documents),
met AS (SELECT r, l, o, i, m, length(regexp_extract(low, {_PATTERN}, 1)) AS st FROM (SELECT * FROM docs JOIN tried USING (rank) WHERE contains(low, p)) WHERE regexp_matches(low, {_PATTERN})),
hits AS (SELECT r, arg_min(m, (l, o, i)) AS m, arg_min(st, (l, o, i)) AS st FROM met GROUP BY r),
one AS (SELECT DISTINCT rank, regexp_extract(v, '{_WORD}') AS w FROM cand WHERE len(regexp_extract_all(v, '{_WORD}')) = 1), stemmed AS (SELECT *, {_stem('w')} AS s FROM one),
forms AS (SELECT rank, w AS form FROM stemmed UNION SELECT rank, s FROM stemmed UNION SELECT rank, form FROM stemmed x JOIN surface y ON y.w IN (x.w, x.s) UNION SELECT rank, form FROM stemmed x JOIN rendering y ON y.w IN (x.w, x.s)),
toks AS (SELECT r, rank, unnest(range(1, len(ts) + 1)) AS k, unnest(ts) AS w FROM (SELECT r, rank, regexp_extract_all(text, '{_WORD}') AS ts FROM docs WHERE r NOT IN (SELECT r FROM hits))),
kinds AS (SELECT w, {_stem('w')} AS s FROM (SELECT DISTINCT lower(w) AS w FROM toks)),
variant AS (SELECT w, w AS form FROM kinds UNION SELECT w, s FROM kinds UNION SELECT x.w, form FROM kinds x JOIN surface y ON y.w IN (x.w, x.s)),
first AS (SELECT r, min(k) AS k FROM toks JOIN variant ON variant.w = lower(toks.w) JOIN forms USING (rank, form) GROUP BY r),
placed AS (SELECT r, CAST(list_sum(list_transform(string_split_regex(text, '{_WORD}')[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{_WORD}')[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS st FROM docs JOIN first USING (r))
SELECT doc_id, CASE WHEN NOT coalesce(regexp_matches(text, '[A-Za-z]'), false) THEN 'none' WHEN m IS NOT NULL THEN m WHEN placed.st IS NOT NULL THEN 'exact_token' ELSE 'none' END AS method,
 CASE WHEN NOT coalesce(regexp_matches(text, '[A-Za-z]'), false) THEN 'low' WHEN m IS NOT NULL THEN 'high' WHEN placed.st IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
 CAST(CASE WHEN regexp_matches(text, '[A-Za-z]') THEN coalesce(hits.st, placed.st) END AS INTEGER) AS start FROM docs LEFT JOIN hits USING (r) LEFT JOIN placed USING (r)"""


def highlight_span_all(spark, d):
    """Every document against a gloss of its own: the short form of a benchmark item, taken in
    turn by doc_id, and the item's whole text as definition. Items are compiled before they
    are joined."""
    items = V.ranked(table(spark, d, "benchmark").select(F.lit(1).alias("one"), F.col("item_id").cast("string").alias("item"), "text"), ["one"], "one", "item")
    items = items.select(F.col("rank").alias("_rank"), H.compiled(T.short_definition(F.col("text")), F.col("text")).alias("gloss"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(items.agg(F.count("*").alias("_n"))), how="cross")  # a single row
    placed = docs.withColumn("_rank", F.pmod("doc_id", F.nullif("_n", F.lit(0))) + 1).join(items, "_rank", "left")
    return placed.select("doc_id", H.spot(F.col("text"), F.col("gloss")).alias("h")).select("doc_id", "h.method", "h.confidence", "h.start")


QUERIES["highlight_span_all"] = highlight_span_all
ORACLES["highlight_span_all"] = HIGHLIGHTS
