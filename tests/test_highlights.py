"""Glosses compiled to words: the stemmer undone, places of tokens, whole rows."""

import itertools

from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import highlight as H


def test_spellings_are_all_words_with_a_form_among_their_variants(spark):
    bases = ["city", "cit", "rul", "rule", "say", "speak", "spok", "begin", "have", "ha", "y", "bless", "carr", "carry", "told", "hold", "happen", "tell"]
    ends = ["", *(s for s, _ in T.SUFFIXES), "y", "'s", "ss"]
    known = sorted({b + e for b in bases for e in ends} | set(H.SURFACE) | {w for f in H.SURFACE.values() for w in f.split()})
    groups = [[b] for b in known] + [list(p) for p in itertools.islice(itertools.combinations(known, 3), 0, 4000, 97)] + [[]]
    d = spark.createDataFrame([(known, g) for g in groups], "known array<string>, forms array<string>")
    want = F.filter("known", lambda w: F.arrays_overlap(H.variants(w), F.col("forms")))
    got = F.array_intersect("known", H.spellings(F.col("forms")))
    assert d.where(F.array_sort(want) != F.array_sort(got)).count() == 0 and d.where(F.size(want) > 0).count() >= len(known)


def test_places_of_tokens(spark):
    rows = [
        ("'tis a'b'Cities, cities", "city", ("exact_token", 9, 15)),  # a token may follow a quote that ends another one
        ("Cities'x CITIES'", "city", ("exact_token", 9, 15)),
        ("city", "city", ("exact_phrase", 0, 4)),
        ("subcities; they said: \U0001d538 told", "speak", ("exact_token", 16, 20)),
        ("été \U0001d538 Städte und spoken", "say", ("exact_token", 17, 23)),
        ("... a... b", "say", ("none", None, None)),
        (None, "say", ("none", None, None)),
        ("said", None, ("none", None, None)),
        ("said", "(,);", ("none", None, None)),
        ("x " * 50_000 + "rulings", "ruling", ("exact_token", 100_000, 100_007)),
    ]
    d = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(rows)], "i int, t string, g string")
    got = {r.i: (r.h.method, r.h.start, r.h.end) for r in d.select("i", H.find(F.col("t"), F.col("g")).alias("h")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows)}
    again = d.join(d.select("g").distinct().select("g", H.compiled(F.col("g")).alias("index")), "g", "left")
    again = {r.i: (r.h.method, r.h.start, r.h.end) for r in again.select("i", H.spot(F.col("t"), F.col("index")).alias("h")).collect()}
    assert again == got
