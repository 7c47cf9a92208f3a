"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM bn)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes)),
hit AS (SELECT rid, p, dwin.n, item_id FROM dwin JOIN win ON dwin.s = win.s AND dwin.n = win.n),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

OP2 = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, rid, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, rid, w, unnest(range(1, len(w) - 11)) AS p FROM dw)),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 13)) AS q FROM win JOIN firsts USING (s) WHERE first_doc < doc_id),
one AS (SELECT rid, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM dw),
kept AS (SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY q) AS s FROM one ANTI JOIN gone USING (rid, q) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (rid)
"""

OP4 = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
win AS (SELECT rid, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM dw)),
twice AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n_rep FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM win SEMI JOIN twice USING (rid, s)) GROUP BY rid),
f AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
 length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS upper, length(regexp_replace(t, '[^!?]+', '', 'g')) AS marks FROM dw LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * letters < 6 * word_chars OR 2 * upper > letters OR 5 * marks > n_words) AS kept
FROM g
"""

OP5 = r"""
WITH own AS (SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) v(conv_id, turn, role, text)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)),
s AS (SELECT *, length('<|im_start|>') + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 AS chars,
 row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP6 = r"""
WITH RECURSIVE dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM dw WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT rid AS a, rid AS b FROM dw UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN dw ON b = rid GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM dw LEFT JOIN n USING (rid) JOIN comp USING (rid)
"""

OP9 = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, rid, p, sha256(array_to_string(w[p + 1:p + 50], ' ')) AS s FROM (SELECT doc_id, rid, w, unnest(range(0, len(w) - 49)) AS p FROM dw)),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s),
hit AS (SELECT rid, doc_id, p, first_doc FROM win JOIN firsts USING (s) WHERE first_doc < doc_id),
edge AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS g FROM edge)
SELECT doc_id, min(p) AS start, max(p) + 50 - min(p) AS n_words, min(first_doc) AS source_doc_id FROM run GROUP BY rid, doc_id, g
"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, text, coalesce(doc_id, 9223372036854775807) AS o FROM documents),
ln AS (SELECT rid, o, i, string_split(text, chr(10))[i] AS raw FROM (SELECT rid, o, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
tk AS (SELECT rid, o, i, list_transform(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM ln),
tp AS (SELECT rid, o, i, len(t) AS n, 0 AS kind, array_to_string(t, ' ') AS a, '' AS b FROM tk WHERE len(t) >= 3
 UNION ALL SELECT rid, o, i, len(t), j, array_to_string(t[:2 + (len(t) - 2) * (j - 1) // 4], ' '), array_to_string(t[3 + (len(t) - 2) * j // 4:], ' ') FROM tk, (SELECT unnest(range(1, 5)) AS j) WHERE len(t) >= 8),
rec AS (SELECT n, kind, a, b, row_number() OVER () AS k, min((o, i)) AS first FROM tp GROUP BY n, kind, a, b HAVING count(DISTINCT rid) >= 3),
own AS MATERIALIZED (SELECT rid, o, tp.i, k, (o, tp.i) = first AS leads FROM tp JOIN rec USING (n, kind, a, b)),
stay AS (SELECT rid, i FROM own GROUP BY rid, i HAVING bool_and(leads)),
settled AS (SELECT DISTINCT k FROM own SEMI JOIN stay USING (rid, i)),
away AS (SELECT DISTINCT rid, i FROM own SEMI JOIN settled USING (k) WHERE NOT leads),
rest AS (SELECT rid, o, i, list(k) AS ks FROM own ANTI JOIN stay USING (rid, i) ANTI JOIN away USING (rid, i) GROUP BY rid, o, i),
"at" AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o, i) AS r, o, i, list({rid: rid, ks: ks}) AS ls FROM rest GROUP BY o, i),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept, []::STRUCT(rid BIGINT, ks BIGINT[])[] AS out, 0::BIGINT AS i
 UNION ALL SELECT "at".r, list_concat(kept, flatten(list_transform(list_filter(ls, lambda l: NOT list_has_any(l.ks, kept)), lambda l: l.ks))), list_filter(ls, lambda l: list_has_any(l.ks, kept)), "at".i FROM walk JOIN "at" ON "at".r = walk.r + 1),
gone AS (SELECT * FROM away UNION SELECT unnest(out).rid, i FROM walk),
kept AS (SELECT rid, string_agg(raw, chr(10) ORDER BY i) AS s, count(*) AS n_kept FROM ln ANTI JOIN gone USING (rid, i) GROUP BY rid),
tot AS (SELECT rid, count(*) AS n FROM ln GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_lines, CAST(coalesce(n, 0) - coalesce(n_kept, 0) AS BIGINT) AS n_dropped, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN tot USING (rid) LEFT JOIN kept USING (rid)
"""

OP11 = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
r AS (SELECT rid, id, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM (SELECT row_number() OVER () AS rid, coalesce(CAST(doc_id AS VARCHAR), '') AS id, text AS t FROM documents WHERE text IS NOT NULL)),
c AS (SELECT id, run, count(*) AS n FROM r GROUP BY rid, id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM c, tab),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM less x JOIN less y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
 UNION SELECT x.word, x.n, y.word, y.n FROM less x JOIN w y ON x.d = y.word
 UNION SELECT y.word, y.n, x.word, x.n FROM less x JOIN w y ON x.d = y.word),
best AS (SELECT word, count(*) AS n_near, min((-other_n, encode(other), other)) AS b FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * w.n THEN b[3] END AS form, CASE WHEN -b[1] >= 2 * w.n THEN -b[1] END AS form_n FROM w LEFT JOIN best USING (word)),
step AS (SELECT word, word AS ptr FROM f UNION ALL SELECT s.word, f.form FROM step s JOIN f ON f.word = s.ptr WHERE f.form IS NOT NULL)
SELECT f.word, f.form, ptr AS root, f.n, f.n_near, f.form_n FROM f JOIN step USING (word) JOIN f g ON g.word = ptr AND g.form IS NULL
"""

OP12 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

OP13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, row_number() OVER () AS qid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS wt FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), g),
m AS (SELECT rid, doc_id, 75 + (25 * len(w) * nn) // ll AS m FROM d, g WHERE len(w) > 0),
qt AS (SELECT qid, item_id, t, count(*) AS c FROM (SELECT qid, item_id, unnest(w) AS t FROM q) GROUP BY ALL),
s AS (SELECT qid, item_id, rid, doc_id, CAST(sum(c * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM qt JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY qid, item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
