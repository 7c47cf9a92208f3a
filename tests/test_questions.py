"""Questions and queues against plain Python."""

import hashlib
import math
import re

import pytest

from lexispark.operators import questions as K
from lexispark.operators import sessions as S


def bag(text):
    return {w for w in re.split(r"[\s,;]+", (text or "").lower()) if w}


def brute_distractors(words, n=3):
    shade = lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest()
    order = sorted(words, key=lambda w: shade(w[0]))
    out = {}
    for i, pos, text in words:
        at = [w[0] for w in order].index(i)
        turned = order[at + 1 :] + order[:at]
        seq = [w for w in turned if w[1] == pos] + [w for w in turned if w[1] != pos]
        over = lambda w: len(bag(w[2]) & bag(text)) > 0.5 * min(len(bag(w[2])), len(bag(text)))  # noqa: B023, E731
        out[i] = [w[0] for w in [w for w in seq if not over(w)] + [w for w in seq if over(w)]][:n]
    return out


def test_distractors_far_around_the_ring(spark):
    words = [(i, "noun", f"same old words {i}") for i in range(40)] + [(40 + i, "noun", f"clean{i} other{i}") for i in range(3)]
    words += [(50 + i, "verb", f"same old words v{i}") for i in range(5)] + [(60, "adverb", "lone gloss")]
    d = spark.createDataFrame(words, "id long, pos string, definition string")
    got = {}
    for r in K.distractors(d, reach=2).orderBy("id", "k").collect():
        got.setdefault(r.id, []).append(r.other_id)
    assert got == brute_distractors(words)
    assert K.distractors(d.limit(0)).count() == 0


@pytest.mark.parametrize("n_words", [230, 6_000])
def test_words_of_equal_definitions(spark, monkeypatch, n_words):
    """Words of a few definitions, all but some of which overlap: the ring is searched by classes."""
    if n_words < 1000:
        monkeypatch.setattr(K, "_STEPS", 4)
        monkeypatch.setattr(K, "_BLOCK", 8)
    kinds = ["same old words", "words same old", "same old words here", "Same, old; other words"]
    words = [(i, "noun" if i % 3 else "verb", kinds[i % 4]) for i in range(n_words)]
    words += [(n_words + i, "noun", f"clean{i} other") for i in range(4)] + [(n_words + 9, "verb", "rare gloss"), (n_words + 10, "adverb", ""), (n_words + 11, "verb", None)]
    d = spark.createDataFrame(words, "id long, pos string, definition string")
    got = {}
    for r in K.distractors(d, reach=4).orderBy("id", "k").collect():
        got.setdefault(r.id, []).append(r.other_id)
    assert len(got) == len(words) and all(len(x) == 3 for x in got.values())
    if n_words < 1000:
        assert got == brute_distractors(words)
    else:  # the rare ones are whom the others take
        rare = {i for i, _, t in words if i >= n_words}
        assert all(set(got[i]) <= rare for i in range(0, n_words, 997))


def test_unknown_kind_and_mixed_mode(spark):
    forms = "array<struct<form:string,morphology:string>>"
    rows = [(i, f"l{i}", "n", f"gloss{i}", None, [(f"f{i}", f"m{i % 3}")] if i % 2 else []) for i in range(8)]
    d = spark.createDataFrame(rows, f"id long, lemma string, pos string, definition string, context_definition string, forms {forms}")
    with pytest.raises(ValueError):
        K.build(d, "other")
    got = {r.word_id: r for r in K.ask(d, "mixed").collect()}
    assert set(got) == set(range(8)) and all(got[i].type != "form-id" for i in range(0, 8, 2))
    assert all(r.correct_answer in r.choices and len(r.choices) == 4 for r in got.values())
    forms_only = K.ask(d, "form-id").collect()
    assert {r.word_id for r in forms_only} == {1, 3, 5, 7}
    assert all(r.correct_answer == f"m{r.word_id % 3}" and r.prompt == f"f{r.word_id}" for r in forms_only)


def brute_queue(part, states, k):
    def u(item, i):
        return (int(hashlib.md5(f"0|{part}|{item}|{i}".encode()).hexdigest()[:13], 16) + 1) / ((1 << 52) + 2)

    recent, queue, drawn = list(states[0][2] or [])[-3:], [], set()
    for i in range(k):
        weight = {x: (w if w is not None else 1.0 if x in drawn else 1.5) for x, w, _ in states}
        pool = [x for x in weight if x not in recent] or list(weight)
        one = min(pool, key=lambda x: -math.log(u(x, i)) / weight[x])
        queue.append(one)
        drawn.add(one)
        recent = [*recent, one][-3:]
    return queue


def test_queue_leaves_out_recent_words(spark):
    states = {p: [(x, None if x % 2 else 0.5 + x, [1, 2, 4]) for x in range(size)] for p, size in ((1, 9), (2, 2), (3, 60), (4, 9))}
    rows = [(p, *s) for p, part in states.items() for s in part]
    d = spark.createDataFrame(rows, "u long, item long, weight double, recent array<long>")
    got = {r.u: list(r.queue) for r in S.seed_queue(d, "u", "item", 7).collect()}
    assert got == {p: brute_queue(p, part, 7) for p, part in states.items()}
    assert got[1] != got[4]
    assert {r.u: r.item for r in S.adaptive(d, "u", "item").collect()} == {p: brute_queue(p, part, 1)[0] for p, part in states.items()}
