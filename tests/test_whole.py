"""Whole jobs: rows that a filter or a bound once left out."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from lexispark.operators import study as S
from lexispark.operators import vocab as V
from lexispark.plans import registry

SF = "/root/testdata/sf0.001"


def greedy(items, most=3):
    out = []
    for x in sorted(items):
        if len(out) < most and all(y[1] != x[1] and y[2] != x[2] for y in out):
            out.append(x)
    return out


def test_context_lists_are_bounded_and_exact(spark):
    rng = random.Random(5)
    rows = [("hot", i, f"r{i}", "one") for i in range(500)] + [("hot", 500 + i, "r0", f"f{i}") for i in range(500)] + [("hot", 2000, "last", "zz"), ("hot", 2001, "last2", "yy")]
    for k in range(60):
        refs, forms = rng.choice([2, 4, 9]), rng.choice([2, 4, 9])
        rows += [(f"l{k}", i, f"r{rng.randrange(refs)}", f"f{rng.randrange(forms)}") for i in rng.sample(range(400), 80)]
    d = spark.createDataFrame(rows, "lemma string, ord int, ref string, form string").withColumn("sentence", F.col("form"))
    assert max(r["count"] for r in V.context_candidates(d, "lemma").groupBy("lemma").count().collect()) <= 11
    got = {r.lemma: [(x.ord, x.ref, x.form) for x in r.contexts] for r in V.select_contexts(d, "lemma").collect()}
    assert got == {k: greedy({r[1:] for r in rows if r[0] == k}) for k in {r[0] for r in rows}}


def test_contexts_of_every_form(spark):
    got = {}
    for r in registry.queries()["context_topk_all"](spark, SF).collect():
        got.setdefault(r.lemma, {})[r.k] = ((r.doc_id, r.sentence_ord), r.doc_id, r.form, r.highlight_start)
    items = {}
    for doc, n, s in duckdb.sql(f"SELECT doc_id, sentence_ord, sentence FROM ({_sentences()})").fetchall():
        for form in set(re.findall(r"[^\W\d_]+", s)):
            items.setdefault(form.lower(), []).append(((doc, n), doc, form, s.lower().find(form.lower())))
    assert min(map(len, items)) < 4 and max(map(len, items)) > 6
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: greedy(v) for k, v in items.items()}


def short(t, most=80):
    t = re.sub(r"\s+", " ", t or "").strip()
    clause, sentence = t.split(";")[0].strip(), re.split(r"(?<!\b[A-Z])\.(?!\w)", t)[0].strip()
    if ";" in t and 2 < len(clause) <= most:
        return clause
    if sentence != t and 2 < len(sentence) <= most:
        return sentence
    return t if len(t) <= most else (t[:most].rsplit(" ", 1)[0] if " " in t[:most] else t[:most]) + "…"


def test_glosses_of_initials_nulls_and_letters_beyond_ascii(spark, tmp_path):
    texts = ["by A. Smith. Then more", "a work of J. R. Brown", "one.été. Two", "x.λόγος is one. More", None, "", "a thing; B. more", "é A. b. c", "See 3.5 of it. End", "word " * 30, "y" * 90]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.gloss for r in registry.queries()["truncate_gloss_all"](spark, str(tmp_path)).collect()}
    assert got == {i: short(t) for i, t in enumerate(texts)} and got[0] == "by A. Smith" and got[2] == "one.été"


def test_highlights_of_every_language_and_gloss(spark, tmp_path):
    items = [(0, "virtue; rest"), (1, "say; rest"), (2, "city; rest"), (3, "(,)."), (4, None)]
    texts = [(0, "Es ist virtue", "de"), (1, "the story goes on", None), (2, "les cities", "fr"), (3, "nothing", "en"), (4, "nothing", "en"), (5, "kein", "de"), (6, "he told him", "es"), (7, "city", "en"), (8, None, "en"), (None, "virtue", "en")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.method, r.start) for r in registry.queries()["highlight_span_all"](spark, str(tmp_path)).collect()}
    none = ("none", None)
    assert got == {0: ("exact_phrase", 7), 1: ("phrase_override", 4), 2: ("exact_token", 4), 3: none, 4: none, 5: none, 6: ("exact_token", 3), 7: ("exact_phrase", 0), 8: none, None: none}


def _sentences():
    return registry.oracle_sql()["sentences"].replace("FROM documents", f"FROM '{SF}/documents.parquet'")


def test_urgency_in_blocks_and_streams_outside_the_driver(spark):
    rng = random.Random(3)
    rows = [(u, rng.randrange(400_000), i, rng.random() < p) for u, p in ((1, 0.5), (2, 0.75), (3, 0.8)) for i in range(700)]
    want = {}
    for u, _, _, ok in sorted(rows):
        want[u] = max(want.get(u, 0) - 1, 0) if ok else min(want.get(u, 0) + 3, 12)
    got = S.urgency(spark.createDataFrame(rows, "user_id long, ts long, event_id long, correct boolean"), "user_id")
    assert got.count() == 3 and {r.user_id: r.urgency for r in got.collect()} == want
    assert registry.queries()["streaming_progress"](spark, SF).inputFiles()  # files, no table in the driver's memory
