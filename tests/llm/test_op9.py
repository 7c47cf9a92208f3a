"""Operator 9 against plain Python."""

import random

from lexispark.llm import registry, suffixes

SF = "/root/testdata/sf0.01"


def brute(docs, k=50):
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
        run = None
        for p in range(len(w) - k + 1):
            s = first.get(tuple(w[p : p + k]))
            if d is None or s >= d:
                continue
            if run and p <= run[1]:
                run = (run[0], p + k, min(run[2], s))
            else:
                if run:
                    out.append((d, run[0], run[1] - run[0], run[2]))
                run = (p, p + k, s)
        if run:
            out.append((d, run[0], run[1] - run[0], run[2]))
    return sorted(out)


def test_on_sf(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in registry.op9_suffixes(spark, SF).collect())
    assert got == brute(docs) and len(got) > 20


def test_odd_cases(spark):
    r = random.Random(9)
    word = lambda n: [r.choice("abcdefgh") for _ in range(n)]
    base = word(300)
    docs = [(1, None), (2, ""), (None, " ".join(base)), (3, " ".join(base)), (3, " ".join(base)), (4, "a " * 400), (5, "a " * 90 + "b"), (6, " ".join(word(20_000)))]
    for i in range(60):
        a = r.randrange(240)
        docs.append((10 + r.randrange(70), " ".join(word(r.randrange(30)) + base[a : a + r.randrange(40, 200)] + word(r.randrange(30)))))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(4)
    assert sorted(tuple(x) for x in suffixes.repeated_spans(d).collect()) == brute(docs)
    assert suffixes.repeated_spans(d.limit(0)).count() == 0


def test_runs_over_the_ends_of_ranges(spark):
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, (i * 7919) % 1000, 1, 1, i) for i in range(900)] + [(i, i % 50, 1 + i % 3, i % 2, i) for i in range(900, 1200)]
        got = suffixes.compared(spark.createDataFrame(rows, "uid long, doc_id long, h long, c long, run long"), "c")
        got = got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    first = {}
    for _, d, h, c, _ in rows:
        first[h, c] = min(first.get((h, c), d), d)
    assert sorted((r.uid, r.source) for r in got if r.doc_id > r.source) == sorted((u, first[h, c]) for u, d, h, c, _ in rows if d > first[h, c])
    assert sorted((r.h, r.c, r.source) for r in got if r.head) == sorted((*k, v) for k, v in first.items())
