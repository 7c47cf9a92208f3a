"""States of a session's words are asked for together: each asking of the state store costs
as much as folding many answers."""

import pandas as pd
import pytest

from lexispark.streaming import answers as SA
from lexispark.streaming import restore as R


class Kept:
    """A state variable of any kind in memory, for one key; counts what it is asked."""

    def __init__(self, calls):
        self.calls, self.rows, self.map = calls, [], {}

    def __getattr__(self, name):
        one = {"exists": lambda: bool(self.rows), "update": lambda v: self.rows.__setitem__(slice(None), [v]), "containsKey": self.map.__contains__, "updateValue": self.map.__setitem__}
        many = {"put": lambda v: self.rows.__setitem__(slice(None), v), "appendValue": self.rows.append, "appendList": self.rows.extend, "get": lambda: iter(list(self.rows))}
        self.calls.append(name)
        return (one | many)[name]


class Handle:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a, **b: Kept(self.calls)


@pytest.mark.parametrize("make", [SA.WordState, lambda: R.Words(3, None)])
def test_a_session_asks_a_few_times_whatever_its_words(make):
    processor, handle = make(), Handle()
    processor.init(handle)
    rows = [(w, f"q{i % 150}", i, pd.Timestamp(i % 7, unit="s"), i % 3 != 0, f"p{i}") for i in range(300) for w in (i % 50,)]
    want, done = {}, set()
    for batch in (rows[:200], rows[150:]):  # questions come again in a batch, and in the next one
        df = pd.DataFrame(batch, columns=["word_id", "question_id", "event_id", "ts", "correct", "prompt"])
        parts = [df.iloc[:70], df.iloc[70:]]
        got = {r.word_id: (r.seen, r.correct, r.incorrect, r.streak, r.urgency) for out in processor.handleInputRows((7, 0), iter(parts), None) for r in out.itertuples()}
        for w, q, _, _, ok, _ in sorted(batch, key=lambda r: (r[3], r[2])):
            if (w, q) not in done:
                done.add((w, q))
                n, a, b, s, u = want.get(w, (0, 0, 0, 0, 0))
                want[w] = (n + 1, a + ok, b + (not ok), s + 1 if ok else 0, max(u - 1, 0) if ok else min(u + 3, 12))
        assert got == {w: want[w] for w in df.word_id.unique()}
    assert len(handle.calls) <= 8
