"""Operator 13 against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from lexispark.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INF = 1 << 63


def brute(docs, items, k=20):
    tf = [Counter(TERM.findall((t or "").translate(LOW))) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, m in zip(docs, tf, n, strict=True):
            if not m:
                continue
            own = 75 + 25 * m * big_n // big_l
            s = 0
            for t in TERM.findall((text or "").translate(LOW)):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * own))
            if s > 0:
                scores.append((-s, INF if doc is None else doc, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    docs = [(i, " ".join(rng.choices(words[i % 4], k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, "same words in each of these A1 b2") for i in range(300)]  # ties, and a large group of copies
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, "a1 a2 a2"), (2000, None), (2001, ""), (2002, "?! ,"), (2003, "É× é a1 ÉA1 漢字 a1_b2 a1-b2")]
    docs += [(2004, "a1 " * 40_000 + "needle"), (2005, "x" * 70_000)]
    items = [(i, " ".join(rng.choices(words[i % 4], k=8))) for i in range(12)]
    items += [(3, "needle"), (None, "same WORDS words"), (20, None), (21, ""), (22, "nothing-of-this"), (23, "É 漢字 a1 éa1"), (24, "x" * 70_000), (25, " ".join(words[0] + words[1]))]
    return docs, items


@pytest.mark.parametrize("shard_docs, depth, batch", [(16, 3, 1024), (100_000, 0, 7)])
def test_search(spark, corpus, shard_docs, depth, batch):
    docs, items = corpus
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, rank int, term string").repartition(5)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    index = search.build(d, sample_docs=200, sample_terms=150, depth=depth, shard_docs=shard_docs)
    assert (index.shards.count() > 20) == (depth > 0)
    assert rows(search.search(index, q, visits=(1, 3), batch=batch)) == brute(docs, items)
    assert rows(search.search(index, q, k=3, visits=())) == brute(docs, items, 3)


def test_empty_tables(spark, corpus):
    d = spark.createDataFrame(corpus[0][:20], "doc_id long, text string")
    q = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert rows(search.search(search.build(d), q.limit(0))) == []
    assert rows(search.search(search.build(d.limit(0)), q)) == []
    assert rows(search.search(search.build(d.where("false").union(spark.createDataFrame([(1, None)], "doc_id long, text string"))), q)) == []


def test_bisection_parts_what_shares_no_terms():
    rng = random.Random(1)
    words = [[f"{c}{i}".encode() for i in range(40)] for c in "abcd"]
    docs = [sorted(set(rng.choices(words[i % 4], k=15))) for i in range(400)]
    tree = search.bisect(docs, 1000, 2)
    leaf = [tree.leaf(iter(d)) for d in docs]
    assert all(len({leaf[i] for i in range(j, 400, 4)}) == 1 for j in range(4)) and len(set(leaf)) == 4


def test_few_shards_are_visited(spark):
    """Clusters and bounds spare work: an item of one cluster's words visits few shards."""
    rng = random.Random(2)
    words = [[f"{c}{i}" for i in range(200)] for c in "abcdefgh"]
    docs = [(i, " ".join(rng.choices(words[i % 8], k=40))) for i in range(1600)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(i, docs[i][1]) for i in range(16)], "item_id long, text string")
    index = search.build(d, sample_docs=400, depth=3, shard_docs=50)
    _, bound = search.bounds(index, search.queries_of(q, "item_id", "text"))
    n = index.shards.count()
    assert bound.count() <= 16 * n / 8 * 1.5  # other clusters share no term
    assert rows(search.search(index, q)) == brute(docs, [(i, docs[i][1]) for i in range(16)])
