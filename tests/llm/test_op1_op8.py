"""Operators 1 and 8 against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import common, decontamination, packing, registry

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_decontaminate(docs, items):
    windows, out = defaultdict(set), []
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(10, len(w))
            for p in range(len(w) - n + 1):
                windows[tuple(w[p : p + n])].add(str(i))
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    got |= ids
        out.append((d, len(w), len(hit), sorted(got)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_decontaminate_on_sf(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute_decontaminate(docs, items)]
    got = [tuple(r) for r in registry.op1_decontaminate(spark, SF).collect()]
    assert order(got) == order(want)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_decontaminate_edges(spark):
    long = " ".join(f"w{i % 97}x{i // 50}" for i in range(3000))
    docs = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f g h i j k", "x"), (4, "A, b. C", "x"), (4, "A, b. C", "x"), (5, "z " * 50 + "a b c d e f g h i j", None), (6, long, ""), (7, "é é é é é é é é é é é", "")]
    items = [(1, "a b c"), (2, None), (None, "a b c"), (3, ""), (4, "a b c d e f g h i j k l"), (5, "a b c"), (6, " ".join(long.split()[1000:1015])), (7, "é É é é é é é é é é é é"), (8, "q")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.decontaminate(d, b).collect()]
    assert order(got) == order(brute_decontaminate([x[:2] for x in docs], items))
    assert decontamination.decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(d, b.limit(0)).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=10, max_size=60), st.data())
def test_winnowing_keeps_a_fingerprint_of_each_window(seq, data):
    x = common.WordHashes().of([str(i).encode() for i in seq])
    at = data.draw(st.integers(0, len(seq) - 10))
    _, own = decontamination.fingerprints(x[at : at + 10], 5, 10)
    pos, kept = decontamination.fingerprints(x, 5, 10)
    assert set(own.tolist()) & {h for p, h in zip(pos.tolist(), kept.tolist()) if at <= p <= at + 5}


def check_packing(spark, docs, out, size=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.word_tokenizer())
    want = sorted((d if d is not None else -1, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs)
    pieces = defaultdict(list)
    seqs = defaultdict(list)
    for r in out:
        pieces[-1 if r.doc_id is None else r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    by_doc = defaultdict(list)
    for d, ids in want:
        by_doc[d].append(ids)
    assert set(pieces) == set(by_doc)
    for d, all_ids in by_doc.items():
        if len(all_ids) > 1:
            assert sum(p.length for p in pieces[d]) == sum(map(len, all_ids))
            continue
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(all_ids[0])
            assert p.ids_crc32 == zlib.crc32(np.array(all_ids[0][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(all_ids[0])
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    return sum(p.length for p in out), len(seqs)


def test_pack_on_sf(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    total, n = check_packing(spark, docs, registry.op8_pack(spark, SF).collect())
    assert n <= total / 4096 * 1.02 + 1


def test_pack_edges(spark):
    docs = [(1, None), (2, ""), (None, "a cat"), (3, "x" * 50_000), (3, "x" * 50_000), (4, "one <|endoftext|> two<|startoftext|>three"), (5, "Ünï çödé 日本語  é don't 12345"), (6, "word " * 9000), (7, "tie"), (8, "tie")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, length int").repartition(3)
    for size in (64, 4096):
        check_packing(spark, docs, packing.pack(d, registry.word_tokenizer(), size=size, open_windows=2, min_cut=4).collect(), size)
    assert packing.pack(d.limit(0), registry.word_tokenizer()).count() == 0
