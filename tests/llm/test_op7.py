"""Operator 7 against encoding every edited text anew."""

import random
import zlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import registry, token_counts

SF = "/root/testdata/sf0.01"
COUNTS = token_counts.PieceCounts(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def full(t):
    return len(COUNTS.encoding.encode_ordinary(t))


def applied(t, edits):
    for s, e, r in edits:
        s = max(0, min(s, len(t)))
        e = max(s, min(e, len(t)))
        t = t[:s] + r + t[e:]
    return t


piece = st.text(alphabet=" \n\t'sabré1.,ll日", max_size=30)


@settings(max_examples=500, deadline=None)
@given(piece, st.lists(st.tuples(st.integers(0, 40), st.integers(0, 45), piece), max_size=6), st.sampled_from([1, 2, 64]))
def test_tree_equals_encoding_anew(text, edits, block):
    tree = token_counts.TokenTree(text, COUNTS, block)
    assert tree.total == full(text)
    for i, (s, e, r) in enumerate(edits):
        tree.edit(s, e, r)
        now = applied(text, edits[: i + 1])
        assert "".join(p for b in tree.blocks for p in b) == now
        assert (tree.total, tree.chars[1]) == (full(now), len(now))


def test_on_sf(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.op7_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r.doc_id]
        at = [zlib.crc32(f"{r.doc_id}{c}".encode()) % (len(t) + 1) for c in "abc"]
        now = applied(t, [(at[0], at[0], " (revised 2024)"), (at[1], at[1] + 12, "it's "), (at[2], at[2] + 40, ""), (len(t), len(t) + 100, "\n  end.")])
        assert (r.tokens_before, r.tokens_after, r.chars_after, r.n_edits) == (full(t), full(now), len(now), 4)
        assert r.n_reencoded < 60 or len(t) < 400


def test_odd_cases(spark):
    docs = [(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "word " * 40_000, 1), (4, "tie", 1), (4, "tie", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, edits int")
    edits = spark.createDataFrame([(1, 1, 0, 0, "new"), (3, 2, 5, 9, None), (3, 1, None, None, "x"), (4, 1, 1, 99, "o")], "doc_id long, seq int, start long, end long, replacement string")
    out = token_counts.token_counts(token_counts.attach_edits(d.drop("edits"), edits), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = sorted(((r.doc_id, r.n_edits, r.tokens_after) for r in out.collect()), key=repr)
    want = [(1, 1, full("new")), (2, 0, 0), (None, 0, full("a b")), (3, 2, full(applied("word " * 40_000, [(0, 0, "x"), (5, 9, "")]))), (4, 1, full("to")), (4, 1, full("to"))]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(token_counts.revision_edits(d.limit(0)), "unused").count() == 0


def test_grown_blocks_are_cut_up():
    rng = random.Random(5)
    text = " ".join(f"w{i}" for i in range(40))
    tree = token_counts.TokenTree(text, COUNTS, block=4)
    for n in range(60):
        start = rng.randrange(len(text) + 1)
        end, new = start + rng.choice((0, 0, 3, 200)), " x1, y" * rng.choice((0, 1, 2, 90)) + rng.choice(("", "'", " ", "é"))
        tree.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert "".join(map("".join, tree.blocks)) == text and tree.chars[1] == len(text)
        assert max(map(len, tree.blocks)) <= 8 and tree.total == full(text), n
