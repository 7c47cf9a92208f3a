"""Operator 6 against plain Python."""

import random
from collections import defaultdict

import pytest

from lexispark.llm import jaccard, registry

SF = "/root/testdata/sf0.01"


def brute(docs, k=4, percent=85):
    sets, lists = [], defaultdict(list)
    for r, (_, t) in enumerate(docs):
        w = bytes((t or "").encode()).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append(s)
        for g in s:
            lists[g].append(r)
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r, s in enumerate(sets):
        n = defaultdict(int)
        for g in s:
            for o in lists[g]:
                if o < r:
                    n[o] += 1
        for o, m in n.items():
            if 100 * m >= percent * (len(s) + len(sets[o]) - m):
                up[find(r)] = find(o)
    low = {}
    for r, (d, _) in enumerate(docs):
        f = find(r)
        if d is not None:
            low[f] = min(low.get(f, d), d)
    return sorted(((d, len(s), low.get(find(r))) for r, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_on_sf(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in registry.op6_jaccard(spark, f"/root/testdata/{sf}").collect()), key=repr)
    assert got == brute(docs)


def test_long_lists_and_odd_cases(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):  # near copies of near copies, some past the threshold
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            t[r.randrange(120)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(t)))
    docs += [(200 + i, " ".join(base[:40]) + f" y{i} z{i}") for i in range(90)]
    docs += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one\ttwo"), (305, "two one"), (None, "one two"), (None, "alone here"), (306, "a " * 30_000), (307, "A A A A"), (5, "other words stand here now"), (5, "one two")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n long").repartition(4)
    for long_list in (8, 64):
        got = sorted((tuple(x) for x in jaccard.jaccard_components(d, long_list=long_list).collect()), key=repr)
        assert got == brute(docs)
    assert jaccard.jaccard_components(d.limit(0)).count() == 0


def test_components_in_one_task_or_many(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(7, 7), (200, 201), (200, 201)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for x, y in edges:
            up[x] = up[y] = min(up[x], up[y])
    d = spark.createDataFrame(edges, "a long, b long")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for block in (500_000, 9):
        assert {x.node: x.comp for x in jaccard.components(d, block).collect()} == {x: up[x] for x in linked if up[x] != x}
    assert jaccard.components(d.limit(0)).count() == 0
