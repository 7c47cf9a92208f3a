"""Fill-missing merge against a plain fold, and what it rewrites."""

import random

from lexispark.operators import merge as M

WORD = "id long, part string, context_definition string, etymology string, contexts array<struct<ref:string,translation:string>>, forms array<struct<form:string,morphology:string>>"
CHUNK = WORD.replace("part string", "chunk long, row long").replace("ref:string,", "")


def is_bare(m):
    m = (m or "").strip(" ")
    return not m or (" " not in m and "," not in m)


def fold(words, chunks):
    out = {w[0]: [w[0], w[1], w[2], w[3], None if w[4] is None else [list(c) for c in w[4]], None if w[5] is None else [list(f) for f in w[5]], 0] for w in words}
    for _, _, i, gloss, root, contexts, forms in sorted(([c[1], c[2], c[0], *c[3:]] for c in chunks if c[0] is not None), key=lambda c: c[:2]):
        w = out.get(i)
        if w is None:
            continue
        changed = False
        for at, new in ((2, gloss), (3, root)):
            if new and not w[at]:
                w[at], changed = new, True
        for c, new in zip(w[4] or [], contexts or [], strict=False):
            if new[0] and not c[1]:
                c[1], changed = new[0], True
        known = {f: m for f, m in forms or []}
        for f in w[5] or []:
            if known.get(f[0]) and is_bare(f[1]):
                f[1], changed = known[f[0]], True
        w[6] += changed
    return sorted(out.values())


def plain(df, *cols):
    return sorted([r.id, r.part, r.context_definition, r.etymology, *[None if r[c] is None else [list(x) for x in r[c]] for c in ("contexts", "forms")], *[r[c] for c in cols]] for r in df.collect())


def made(seed, n_words=60, n_chunks=8):
    rng = random.Random(seed)
    text, morph = lambda: rng.choice([None, "", "x", f"t{rng.randrange(99)}"]), lambda: rng.choice([None, "", "noun", "verb", "noun, pl", "verb x", " "])
    form = lambda: rng.choice("abc")
    words = [(i, "pq"[i % 2], text(), text(), rng.choice([None, [(f"r{j}", text()) for j in range(rng.randrange(4))]]), rng.choice([None, [(form(), morph()) for _ in range(rng.randrange(4))]])) for i in range(n_words)]
    chunks = []
    for c in range(n_chunks):
        for r in range(30):
            i = rng.choice([None, 3, 3, 3, rng.randrange(n_words + 9)])  # word 3 is in every chunk, many times
            chunks.append((i, c, r, text(), text(), rng.choice([None, [(text(),) for _ in range(rng.randrange(5))]]), rng.choice([None, [(form(), morph()) for _ in range(rng.randrange(4))]])))
    return words, chunks


def test_fold(spark):
    for seed in range(3):
        words, chunks = made(seed)
        w, c = spark.createDataFrame(words, WORD).repartition(3), spark.createDataFrame(chunks, CHUNK).repartition(4)
        got = M.merge_chunks(w, c)
        assert got.columns == [*w.columns, "n_changes"]
        assert plain(got, "n_changes") == fold(words, chunks)
    assert plain(M.merge_chunks(w, c.limit(0)), "n_changes") == fold(words, [])
    assert M.merge_chunks(w.limit(0), c).count() == 0


def test_only_changed_partitions_are_written(spark, tmp_path):
    words, chunks = made(9)
    path = f"{tmp_path}/words"
    spark.createDataFrame(words, WORD).write.partitionBy("part").parquet(path)
    before = {p: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "words").glob("part=*")}
    own = [c for c in chunks if c[0] is None or c[0] % 2]  # words of part q
    want = fold(words, own)
    assert M.merge_into(spark, path, spark.createDataFrame(own, CHUNK), "part") == sum(w[6] for w in want)
    assert plain(spark.read.parquet(path)) == [w[:6] for w in want]
    after = {p: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "words").glob("part=*")}
    assert {p.name for p in before if before[p] == after[p]} == {"part=p"}
    again = M.merge_into(spark, path, spark.createDataFrame(own, CHUNK), "part")  # bare morphologies are replaced anew, nothing else
    assert again == sum(w[6] for w in fold([tuple(w[:6]) for w in want], own))
