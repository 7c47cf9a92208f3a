"""The composed transducers against the rules of the grammar, spelled out word by word."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import toxicity as X

WORDS = ["fool", "kill", "will", "you", "not", "said", "tree", "shot", "never", "they"]
LEXICON = {"fool": 4.0, "shot": 3.5}


def by_rules(words, weights, quoted, starts, modals):
    """Each word looks at all others of its clause anew."""
    score, n, lowered = 0.0, 0, 0
    for i, (w, x) in enumerate(zip(words, weights, strict=True)):
        begin = max((p for p in starts if p <= i), default=0)
        end = min((p for p in starts if p > i), default=len(words))

        def before(group, reach, low, i=i):
            return any(words[j] in group for j in range(max(low, i - reach), i + 1))

        modal = before(X.THREAT_MODALS, 6, begin) or any(max(begin, i - 6) <= j <= i for j in modals)
        if w in X.HARM_VERBS and modal:
            x += 3.0
        if x <= 0:
            continue
        if before(X.TARGETS, 4, begin) or any(v in X.TARGETS for v in words[i + 1 : min(end, i + 5)]):
            x *= 1.25
        if before(X.NEGATORS, 3, begin):
            x, lowered = x * 0.6, lowered + 1
        elif i in quoted or before(X.REPORTERS, 6, 0):
            x, lowered = x * 0.7, lowered + 1
        score, n = score + x, n + 1
    return score, n, lowered


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=24), st.data())
def test_clause_follows_the_rules(words, data):
    grammar = X.Grammar(LEXICON)
    places = [data.draw(st.sets(st.integers(0, max(0, len(words) - 1)), max_size=3)) if words else set() for _ in range(3)]
    weights = [grammar.insult(w) for w in words]
    score, n, lowered = grammar.clause(words, weights, *places)
    assert (pytest.approx(score), n, lowered) == by_rules(words, weights, *places)


def test_composition_is_one_after_the_other():
    grammar = X.Grammar(LEXICON)
    words = "they said you will not kill the fool".split()
    tape = grammar.tape(words, [grammar.insult(w) for w in words], set(), set(), set())
    state, one = grammar.forward.begin, []
    for symbol in tape:
        state, out, _, _ = grammar.forward.arc(state, symbol)
        one.append(out)
    for part in X.FORWARD:
        s, written = part.begin, []
        for symbol in tape:
            s, out, _, _ = part.arc(s, symbol)
            written.append(out)
        tape = written
    assert one == tape
    assert one[5] & X.THREAT and one[5] & X.NEGATED and not one[5] & X.REPORTED


def test_arcs_are_bounded():
    grammar = X.Grammar(LEXICON)
    for _ in range(3):
        grammar.clause(WORDS * 50, [grammar.insult(w) for w in WORDS * 50])
    assert len(grammar.forward.arcs) <= 8 * 6 * 5 * 8 * len(WORDS) * 2
