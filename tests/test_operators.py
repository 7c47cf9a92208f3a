"""Operators on small hand-made frames, with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lexispark.functions import greek
from lexispark.functions import text as T
from lexispark.operators import enrich as E
from lexispark.operators import highlight as H
from lexispark.operators import lexicon as L
from lexispark.operators import quality as Q
from lexispark.operators import questions as K
from lexispark.operators import study as S
from lexispark.operators import vocab as V
from lexispark.sources import readers as R
from lexispark.sources import writers as WR


def values(spark, col, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in d.select("i", col(F.col("t")).alias("x")).orderBy("i").collect()]


def test_greek(spark):
    assert values(spark, greek.strip_marks, "λόγος", "ἄνθρωπος", "é", None) == ["λογος", "ανθρωπος", "e", None]
    assert values(spark, greek.from_beta, "lo/gos", "a)/nqrwpos", "*swkra/ths", "123", "sos s1s") == ["λόγος", "ἄνθρωπος", "σωκράτης", "", "σοςςς"]
    assert values(spark, greek.headword, " Λόγος., ") == ["λόγος"]
    assert values(spark, T.greek_words, 'Ὁ [λόγος], "Ὦ" ἄνδρες') == [["Ὁ", "λόγος", "Ὦ", "ἄνδρες"]]


def test_definitions(spark):
    long = "word " * 30
    assert values(spark, T.short_definition, "a thing; more", "one thing. Two", "by A. Smith", "", None, long) == ["a thing", "one thing", "by A. Smith", "", "", ("word " * 16)[:79] + "…"]
    assert values(spark, T.usable_gloss, "cf.", "word", "λόγος", "a", None) == [False, True, False, False, False]
    assert values(spark, T.stem, "cities", "walked", "seemingly", "is", "ran", "runs") == ["city", "walk", "seem", "is", "ran", "run"]
    assert values(spark, T.sentences, "One. Two; three.four · five") == [["One.", "Two;", "three.four ·", "five"]]
    assert values(spark, lambda c: T.mark_span(c, F.lit(1), F.lit(3)), "abcd", "ab") == ["a[[bc]]d", "ab"]
    assert values(spark, lambda c: T.escape_html(c, True), "<a b='c'>&") == ["&lt;a b=&#39;c&#39;&gt;&amp;"]


def test_contexts_and_levels(spark):
    c = spark.createDataFrame([("l", 1, "A", "x", "X one"), ("l", 2, "A", "y", "y two"), ("l", 3, "B", "x", "x three"), ("l", 4, "B", "y", "none"), ("l", 5, "B", "y", "y four"), ("l", 6, "C", "z", "z"), ("l", 7, "D", "w", "w")], "lemma string, ord int, ref string, form string, sentence string")
    got = V.select_contexts(c, "lemma").first().contexts
    assert [(x.ord, x.ref, x.form, x.highlight_start, x.highlight_end) for x in got] == [(1, "A", "x", 0, 1), (5, "B", "y", 0, 1), (6, "C", "z", 0, 1)]
    w = spark.createDataFrame([(f"w{i:02}", i // 3) for i in range(20)], "w string, f int").withColumn("p", F.lit(1))
    rows = V.ranked(w, ["p"], "f", "w").select("w", "rank", V.level(F.col("rank"), F.col("n")).alias("level")).orderBy("rank").collect()
    assert [r.w for r in rows] == sorted((f"w{i:02}" for i in range(20)), key=lambda x: (-(int(x[1:]) // 3), x))
    sizes = [sum(r.level == k for r in rows) for k in (1, 2, 3)]
    assert max(sizes) - min(sizes) <= 1 and [r.level for r in rows] == sorted(r.level for r in rows)


def test_lookup_stages(spark):
    lex = spark.createDataFrame([("λόγος", "word"), ("ἀρχή", "rule"), ("πολιτεία", "state")], "headword string, definition string")
    w = spark.createDataFrame([("λόγος",), ("αρχη",), ("πολιτικος",), ("ab",)], "lemma string")
    got = {r.lemma: r.definition for r in L.lookup(w, lex, R.stripped_index(lex), greek.strip_marks).collect()}
    assert got == {"λόγος": "word", "αρχη": "rule", "πολιτικος": "state"}


def test_highlights(spark):
    rows = [("He began to rule.", "beginning"), ("The story goes on", "say"), ("They took place", "happen"), ("A large city", "great"), ("nothing here", "virtue"), ("", "x"), ("on the one hand", "one-hand"), ("It is virtue, indeed", "of virtue; good")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, g string")
    got = [tuple(r.h) for r in d.select("i", H.find(F.col("t"), F.col("g")).alias("h")).orderBy("i").collect()]
    assert got == [("exact_token", "medium", 3, 8), ("phrase_override", "high", 4, 14), ("phrase_override", "high", 5, 15), ("exact_token", "medium", 2, 7), ("none", "low", None, None), ("none", "low", None, None), ("exact_phrase", "high", 7, 15), ("exact_phrase", "high", 6, 12)]
    u = spark.createDataFrame([("1:0", "The cat, the Cat"), ("1:1", "a"), ("1:2", "a a a")], "context_id string, translation string")
    r = spark.createDataFrame([("1:0", "the cat", 2, "high"), ("1:2", "a", 3, "sure"), ("9:9", "a", 1, "high")], "context_id string, matched_text string, occurrence int, confidence string")
    got = {x.context_id: (x.method, x.confidence, x.start) for x in H.align(u, r).collect()}
    assert got == {"1:0": ("model_align", "high", 9), "1:1": ("none", "low", None), "1:2": ("none", "low", None)}


def test_enrichment(spark):
    assert values(spark, E.id_list, "1, 2,,3", "", " ") == [[1, 2, 3], None, None]
    assert values(spark, E.unwrap_response, '```json\n[{"a":1}]\n```', '{"response":[1]}', "{}") == ['[{"a":1}]', "[1]", None]
    o = spark.createDataFrame([(1, "", "e"), (2, "g", None), (3, None, "")], "id int, gloss string, ety string")
    c = spark.createDataFrame([(1, "new", "x"), (2, "new", "y"), (9, "z", "z")], "id int, gloss string, ety string")
    merged = E.fill_missing(o, c, "id", ["gloss", "ety"])
    assert sorted(map(tuple, merged.collect())) == [(1, "new", "e", True), (2, "g", "y", True), (3, None, None, False)]
    again = E.fill_missing(merged.drop("changed"), c, "id", ["gloss", "ety"])
    assert not any(r.changed for r in again.collect())
    f = spark.createDataFrame([([("a", "noun"), ("b", "verb, past")], [("a", "noun, dual"), ("b", "x, y")])], "f array<struct<form:string,morphology:string>>, g array<struct<form:string,morphology:string>>")
    assert [x.morphology for x in f.select(E.merge_morphology(F.col("f"), F.col("g"), True).alias("m")).first().m] == ["noun, dual", "verb, past"]


def test_study(spark):
    a = spark.createDataFrame([(1, i, i, ok) for i, ok in enumerate([False] * 5 + [True, True, False, True])], "user_id long, ts long, event_id long, correct boolean")
    assert [r.streak for r in S.streaks(a, "user_id").orderBy("ts").collect()] == [0, 0, 0, 0, 0, 1, 2, 0, 1]
    assert S.urgency(a, "user_id").first().urgency == 11
    w = spark.range(1).select(S.weight(F.lit(None), F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("a"), S.weight(F.lit(4), F.lit(1), F.lit(3), F.lit(2), F.lit(5)).alias("b")).first()
    assert w.a == 1.5 and w.b == pytest.approx((1 + 4) * 1.2 * 0.7)


def test_quality(spark, tmp_path):
    good = {"id": 1, "lemma": "l", "definition": "d", "level": 1, "frequency": 2, "pos": "NOUN", "forms": [{"form": "l", "morphology": "", "occurrences": 1}]}
    bad = good | {"id": 2, "lemma": " ", "level": 9, "contexts": [{"ref": "1", "form": "l", "sentence": "a l", "highlight_start": 2, "highlight_end": 9, "translation": "t", "translation_highlight_method": "none", "translation_highlight_confidence": "low", "translation_highlight_start": 0}]}
    (tmp_path / "v.json").write_text(json.dumps({"metadata": {"title": "T", "author": "", "work_id": "w", "total_words": 4, "unique_lemmas": 2}, "words": [good, bad, good]}))
    vocab = R.vocab_json(spark, str(tmp_path / "v.json"))
    words, meta = R.words_of(vocab), vocab.select("metadata.*")
    got = sorted((r.id, r.code) for r in Q.check_words(words).collect())
    assert got == [(1, "id.duplicate"), (1, "id.duplicate"), (2, "contexts.span"), (2, "highlight.bounds"), (2, "lemma"), (2, "level")]
    assert [r.code for r in Q.check_metadata(meta).collect()] == ["metadata.author"]
    index = spark.createDataFrame([("other",)], "id string")
    assert sorted(r.code for r in Q.check_works(words, meta, index).collect()) == ["index.missing", "levels.missing", "unique_lemmas.count"]
    assert Q.coverage(words).first().asDict() == {"words": 3, "glossed": 0, "etymologies": 0, "with_contexts": 1, "contexts": 1, "translated": 1, "multi_form": 0, "detailed": 0}
    WR.vocab_json(words.where("lemma <> ' '").dropDuplicates(["id"]), meta, str(tmp_path / "out"))
    assert R.words_of(spark.read.schema(R.VOCAB).json(str(tmp_path / "out"))).count() == 1


def test_questions(spark):
    w = spark.createDataFrame([(i, f"l{i}", "N" if i % 2 else "V", f"meaning{i} of{i}", "", [(f"f{i}", f"m{i % 3}")]) for i in range(12)], "id long, lemma string, pos string, definition string, context_definition string, forms array<struct<form:string,morphology:string>>")
    for r in K.build(w, "greek-to-english", seed=4).collect():
        assert r.correct_answer in r.choices and len(set(r.choices)) == 4 and r.prompt == f"f{r.word_id}"
    pos = {r.id: r.pos for r in w.collect()}
    assert all(pos[r.id] == pos[r.other_id] and r.id != r.other_id for r in K.distractors(w).collect())
    c = K.morphology_choices(w, w.select("id", F.col("forms")[0]["morphology"].alias("morphology"))).first()
    assert len(c.choices) == 3 and c.choices[2] == "morphology option 3"


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Work</title><author>Name Phil.</author></titleStmt></fileDesc></teiHeader>
<text><body><div type="book" n="1"><div type="chapter" n="2"><p>One <label>no</label>two.</p><p>three</p></div><div n="3"><p> </p></div></div></body></text></TEI>"""


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([("w", TEI), ("x", "<TEI><body>not this <p>plain <pb n='1'>gone</pb>text </p><p>\n two</p></body></TEI>"), ("y", "<TEI/>"), ("z", "<broken"), ("n", None)], "work_id string, xml string")
    got = {r.work_id: r for r in R.tei(d).collect()}
    assert (got["w"].title, got["w"].author, got["w"].ref, got["w"].text, got["w"].reference_system) == ("Work", "Name", "12", "One two. three", "book-chapter")
    assert (got["x"].ref, got["x"].text, got["x"].title, got["x"].reference_system) == ("1", "plain text  \n two", "Unknown", "unknown")
    assert all(got[k].error for k in "yzn")
    one = '<b><entryFree key="lo/gos"><orth>x</orth><sense><tr>word,</tr><tr>Word</tr><tr>speech</tr></sense></entryFree><entry><orth>ἀρχή</orth><tr>rule</tr></entry></b>'
    two = '<b><entry key="lo/gos"><sense><tr>cf.</tr></sense><tr>reason</tr></entry><entry key="lo/gos"><tr>later</tr></entry></b>'
    e = R.dictionary_entries(spark.createDataFrame([("1", one), ("2", two), ("3", "<b")], "file string, xml string"))
    assert {r.headword: r.definition for r in R.dictionary(e).collect()} == {"λόγος": "reason", "ἀρχή": "rule"}
    (tmp_path / "a.txt").write_text("[3, 1,\n2]")
    (tmp_path / "b.txt").write_text("5\n4\n")
    (tmp_path / "c.txt").write_text("")
    ids = lambda n: [r.id for r in R.id_file(spark, str(tmp_path / n)).orderBy("pos").collect()]
    assert ids("a.txt") == [3, 1, 2] and ids("b.txt") == [5, 4] and ids("c.txt") == []
    WR.replace_parquet(spark.range(5), str(tmp_path / "t"))
    WR.replace_parquet(spark.read.parquet(str(tmp_path / "t")).where("id > 2"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
