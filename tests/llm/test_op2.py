"""Operator 2 against plain Python on the odd cases."""

import hashlib
import random

from lexispark.llm import substrings


def brute(docs, k):
    first = {}
    for d, t in docs:
        w = (t or "").encode().split()
        for p in range(len(w) - k + 1):
            if d is not None:
                g = tuple(w[p : p + k])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - k + 1):
            if d is not None and first[tuple(w[p : p + k])] < d:
                gone |= set(range(p, p + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_odd_cases(spark):
    r = random.Random(3)
    word = lambda n: " ".join(r.choice("abc") for _ in range(n))
    base = word(400)
    docs = [(1, None), (2, ""), (None, base), (3, base), (3, base), (4, base[100:300] + " q " + base[300:]), (5, word(30_000)), (6, "a " * 500), (7, "a " * 200 + "b"), (8, word(12)), (0, "z " + base[50:90])]
    docs += [(10 + i, word(r.randrange(40)) + " " + base[2 * r.randrange(100) : 2 * r.randrange(100, 200)] + "\t" + word(r.randrange(60))) for i in range(60)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, uid int").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(d).collect()), key=repr)
    assert got == brute(docs, 13)
    assert substrings.dedup_substrings(d.limit(0)).count() == 0
