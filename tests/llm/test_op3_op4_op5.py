"""Operators 3, 4 and 5: edge cases, held-out accuracy and round trips."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexispark.llm import chat, quality, registry, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out_accuracy(spark):
    got = {r.doc_id: r for r in registry.op3_toxicity(spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    docs = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(got) == docs
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    c = Counter(held)
    assert c[1, 1] / (c[1, 1] + c[0, 1]) > 0.85
    assert c[0, 0] / (c[0, 0] + c[1, 0]) > 0.98


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "idiot", 1), (3, "a. " * 30_000, 1), (4, "b", 1), (4, "b", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert toxicity.toxicity(d.limit(0), labels).count() == 0
    assert toxicity.toxicity(d, labels.limit(0)).count() == 6


def test_grammar_composes_negation_report_and_target():
    g = toxicity.Grammar({"idiot": 4.0, "lowei*": 5.0})
    score = lambda t: g.clause(w := t.split(), [g.insult(x) for x in w])[0]
    assert score("such an idiot") == 4 and score("loweixyz") == 5 and score("lowei") == 0
    assert score("you are an idiot") > score("such an idiot") > score("this is not an idiot")
    assert score("someone wrote idiot") < score("such an idiot")
    assert score("i will hurt things") > 0 == score("it may hurt")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute_base(t):
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    cov = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov)


def test_quality_edges(spark):
    texts = [None, "", " \n\t ", "one", "a b c d e f", "x y z u v " * 4, "same words here for you\n" * 3, "a a a a a a a a", "ab cd ef gh ij # | <> kl mn op\n\nab cd ef gh ij", "word " * 20_000, "w%d " * 3 % (1, 2, 3), " x   y\x85z"]
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, "one", 5)], "doc_id long, text string, n_words int")
    got = quality.quality(d).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, chars, sym, dup, rep = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept) and r.kept == (r.rejected_by is None)
    assert quality.quality(d.limit(0)).count() == 0


def test_cascade_order_on_made_costs():
    # b rejects most a second; of what it leaves, c rejects some and a nothing
    kinds = {(True, True, False): 60, (False, True, False): 10, (False, False, True): 5, (False, False, False): 25}
    assert quality.cascade_order(kinds, {"a": 1.0, "b": 1.0, "c": 1.0}) == ["b", "c", "a"]
    assert quality.cascade_order(kinds, {"a": 1.0, "b": 1.5, "c": 1.0}) == ["a", "b", "c"]
    assert quality.cascade_order(kinds, {"a": 9.0, "b": 90.0, "c": 0.1}) == ["c", "a", "b"]
    assert quality.cascade_order({(False, False): 3}, {"a": 2.0, "b": 1.0}) == ["b", "a"]


def test_costs_of_rules_and_their_order_on_a_sample(spark):
    texts = [" ".join(f"{w}{j}" for j, w in enumerate("a few plain words of no great length".split() * 40)) + "#" * (i % 3) * 300 for i in range(24)]
    sample = quality.base_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").cache()
    slow = F.length(F.regexp_replace(F.regexp_replace("text", r"(\w+)\s", "$1  "), r"\P{Lu}+", "")) > 5
    found = {"slow": slow, "quick": F.col("n_symbols") > 100}
    costs = quality.rule_costs(sample, found)
    assert costs["slow"] > 20 * costs["quick"] > 0
    assert quality.order_rules(sample, found) == ["quick", "slow"]
    assert quality.order_rules(sample.limit(0), found) == ["slow", "quick"]


def test_chat_edges(spark):
    bad = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| <| \\ <|br|>"
    turns = [(1, 0, "user", bad, 9), (1, 1, "assistant", bad, 9), (1, 2, "user", None, 9), (1, 2, "user", None, 9), (2, None, None, "", 9), (2, 5, "assistant", "x" * 50_000, 9), (2, 5, "assistant", "é\n日", 9), (None, 0, "ro\nle<|", "t", 9), (3, 0, "assistant", None, 9)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example int").repartition(3)
    examples = chat.format_examples(d)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    for c in (1, 2, 3, None):
        own = sorted((-1 if t is None else t, r or "", x or "") for i, t, r, x, _ in turns if i == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():
        assert r.formatted.count(chat.START) == r.example + 1 == r.formatted.count(chat.END)
    assert chat.format_examples(d.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="<|\\a\n", max_size=12), min_size=20, max_size=20))
def test_escape_round_trip(spark, texts):
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", chat.escape(d.t).alias("e"), chat.unescape(chat.escape(d.t)).alias("u")).collect():
        assert r.t == r.u and "<|" not in r.e


def test_grammar_reads_quotes_colons_apostrophes_and_inflected_verbs():
    g = toxicity.Grammar({"idiot": 4.0})
    total = lambda t: g.figures(t)[3]
    plain = total("such an idiot")
    assert total('such an "idiot"') < plain and total('"What. Such an idiot."') < plain and total("such an «idiot»") < plain and total("“such an idiot”") < plain
    assert total('such an idiot 5" long') == plain == total('"so" such an idiot') == total('an open " such an idiot')
    assert total("somebody said: such an idiot") < plain == total("not: such an idiot")
    assert total("that isn't an idiot") == total("that isnt an idiot") < plain > total("that wasn’t an idiot")
    assert total("i'll hurt things") > 0 == total("ill hurt things") and total("it will be killed") > 0 and total("he’ll be shot") > 0
    assert total("rock'n'roll") == 0
