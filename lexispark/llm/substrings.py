"""Operator 2: substring dedup on a compacted de Bruijn graph of words.

Nodes are runs of k - 1 words, edges runs of k (windows). The edges of a document whose
smallest m-gram (minimiser) is the same occurrence form a path; paths, not single edges,
are what is exchanged, so a graph of n words costs about 2n / (k - m + 2) rows:

1. minimisers that start in one document alone cannot lie on a repeated path; they are
   counted per task, then in Spark, and a fixed-size bitmap of the others spares the
   second reading most of its rows;
2. paths of equal words are joined and compacted to one with its first source
   coordinate: later sources are removed as a whole;
3. where a minimiser has paths of different words the graph branches: there the compacted
   paths, one for each distinct sequence, are opened into edges, and edges are joined to
   their first source;
4. the coordinates that are removed are merged to spans, document by document.

Each path is a unitig of its minimiser: a full graph of single edges, compacted by joins
on in- and out-degrees, would exchange every word of the corpus with 40 bytes of keys.
Equality is that of two 64-bit hashes made of 64-bit hashes of the words (minimiser and
path, or minimiser and edge). A window counts as repeated if it also starts in a document
with a smaller id.

Rows: ids must be integers (anything that casts to long); null texts have no words; a null id neither loses words nor is a source; repeated
rows of one id lose the same words each, and aren't sources for each other; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C
from lexispark.llm import words as W

#: Bitmaps of 8 MB.
BITS = 26
#: A first window and a number of windows, fewer than this, go in one integer.
RUN = 1 << 10


class Paths:
    """Paths of a few texts: text, minimiser, first window (a word's place in the text) and
    number of windows of each."""

    def __init__(self, words: W.Words, k: int, m: int) -> None:
        self.words, self.k = words, k
        grams = C.gram_hashes(words.h, m)
        at = C.sliding_argmin(grams, k - m + 1)
        left = np.repeat(words.first[1:], words.counts()) - np.arange(len(words.h))
        inside = np.flatnonzero(left[: len(at)] >= k)  # windows that lie in one text
        new = np.empty(len(inside), bool)
        new[:1] = True
        new[1:] = (at[inside[1:]] != at[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.n = inside[begin], np.diff(np.append(begin, len(inside)))
        self.text = np.searchsorted(words.first, self.first, side="right") - 1
        self.h = grams[at[self.first]]

    def pick(self, keep: np.ndarray) -> None:
        self.text, self.h, self.first, self.n = self.text[keep], self.h[keep], self.first[keep], self.n[keep]

    def contents(self, sums: W.Sums) -> np.ndarray:
        """A hash of all words of each path."""
        return sums.runs(sums.of(self.words.h), self.first, self.first + self.n + self.k - 1)

    def runs(self) -> np.ndarray:
        return (self.first - self.words.first[self.text]) * RUN + self.n


def paths_of(column: pa.Array, k: int, m: int) -> Iterator[tuple[int, Paths]]:
    for lo, words in W.chunks(column, W.BLANK):
        yield lo, Paths(words, k, m)


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names=names.split())


def repeated_minimisers(docs: DataFrame, k: int, m: int) -> DataFrame:
    """h of minimisers that lie in two documents or more. docs: doc_id, text."""

    def ends(hs: list[np.ndarray], ds: list[np.ndarray]) -> pa.RecordBatch:
        h, d = np.concatenate(hs), np.concatenate(ds)
        order = np.argsort(h)
        h, d = h[order], d[order]
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        low = np.minimum.reduceat(d, new)
        return _batch("h low more", C.signed(h[new]), low, np.maximum.reduceat(d, new) - low)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, size = [], [], 0
        for b in it:
            ids, known = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, paths in paths_of(b.column(1), k, m):
                keep = known[lo + paths.text]
                hs.append(paths.h[keep])
                ds.append(ids[lo + paths.text][keep])
                size += len(hs[-1])
                if size > 1_000_000:
                    yield ends(hs, ds)
                    hs, ds, size = [], [], 0
        if size:
            yield ends(hs, ds)

    found = docs.mapInArrow(run, "h long, low long, more long").groupBy("h")
    found = found.agg(F.min("low").alias("low"), F.max(F.col("low") + F.col("more")).alias("high"))
    return found.where("low < high").select("h")


def filtered(rows: DataFrame, col: str, keys: DataFrame, absent: bool = False) -> DataFrame:
    """rows whose ``col`` may be among the keys: a bitmap drops nearly all others before
    they are shuffled. With absent the others, whose ``col`` is surely none of the keys."""
    sent = rows.sparkSession.sparkContext.broadcast(C.key_filter(keys, col, BITS))
    at = rows.columns.index(col)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = C.KeyFilter(sent.value, BITS)
        for b in it:
            yield b.filter(pa.array(known.has(b.column(at).to_numpy()) ^ absent))

    return rows.mapInArrow(keep, rows.schema)


def indexed(source: DataFrame, k: int, m: int, digest: bool) -> DataFrame:
    """Documents (uid, doc_id, n_words, whole_sha256 if digest, and the text if a path of
    it may repeat) with minimiser, content and coordinates of those paths (hs, cs, runs: RUN
    times the first window plus how many). source: doc_id, text."""
    spark = source.sparkSession
    sent = spark.sparkContext.broadcast(C.key_filter(repeated_minimisers(source, k, m), "h", BITS))
    C.release(spark)
    names = "uid doc_id n_words whole_sha256 text hs cs runs".split()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, uid = C.KeyFilter(sent.value, BITS), W.Sums(), TaskContext.get().partitionId() << 36
        for b in it:
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, paths in paths_of(b.column(1), k, m):
                words = paths.words
                paths.pick(known.has(paths.h) & valid[lo + paths.text])
                size = len(words.bounds) - 1
                at = np.searchsorted(paths.text, np.arange(size + 1))
                kept = pa.array(np.arange(lo, lo + size), mask=np.diff(at) == 0)
                shas = [hashlib.sha256(words.joined(i)).hexdigest() if digest else None for i in range(size)]
                lists = (C.signed(paths.h), C.signed(paths.contents(sums)), paths.runs())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + size)),
                        b.column(0).slice(lo, size),
                        pa.array(words.counts(), pa.int64()),
                        pa.array(shas, pa.string()),
                        b.column(1).take(kept),
                        *[pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int64())) for x in lists],
                    ],
                    names=names,
                )
                uid += size

    schema = "uid long, doc_id long, n_words long, whole_sha256 string, text string"
    return C.written(source.mapInArrow(run, schema + ", hs array<long>, cs array<long>, runs array<long>"))


def placed(base: DataFrame) -> DataFrame:
    """The paths of base one by one: uid, doc_id, h, c, run."""
    some = base.where("text IS NOT NULL").select("uid", "doc_id", F.explode(F.arrays_zip("hs", "cs", "runs")).alias("p"))
    return some.select("uid", "doc_id", F.col("p.hs").alias("h"), F.col("p.cs").alias("c"), F.col("p.runs").alias("run"))


def opened(base: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """Windows (uid, doc_id, h, e, their words' hash, run) of the paths where the graph
    branches. distinct: h, c, source, one row for each distinct path."""
    branching = distinct.groupBy("h").agg(F.count("*").alias("ways"), F.min("source").alias("low"), F.max("source").alias("high"))
    branching = branching.where("ways > 1 AND low < high").select("h")
    # a bitmap in place of a join, in which a minimiser of very many paths would meet in one task
    chosen = filtered(distinct, "h", branching).select(F.xxhash64("h", "c", "source").alias("key"))
    to_open = base.sparkSession.sparkContext.broadcast(C.key_filter(chosen, "key", BITS))
    key = F.transform(F.arrays_zip("hs", "cs"), lambda p: F.xxhash64(p["hs"], p["cs"], F.col("doc_id")))
    keyed = base.where("text IS NOT NULL").select("uid", "doc_id", "text", key.alias("keys"), "hs", "runs")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums_of = C.KeyFilter(to_open.value, BITS), W.Sums()
        for b in it:
            keys, hs, runs = (b.column(j).flatten().to_numpy() for j in (3, 4, 5))
            hit = known.has(keys)
            at = b.column(3).offsets.to_numpy()
            text = np.repeat(np.arange(b.num_rows), np.diff(at))[hit]
            h, first, n = hs[hit], runs[hit] // RUN, runs[hit] % RUN
            some = np.unique(text)
            for lo, words in W.chunks(b.column(2).take(pa.array(some)), W.BLANK):
                own = slice(*np.searchsorted(text, (some[lo], some[lo + len(words.bounds) - 2] + 1)))
                many = n[own]
                row = np.repeat(np.searchsorted(some, text[own]) - lo, many)
                place = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
                begin = words.first[row] + place
                e = sums_of.runs(sums_of.of(words.h), begin, begin + k)
                uid, doc = (b.column(j).take(pa.array(some[lo + row])) for j in (0, 1))
                yield _batch("uid doc_id h e run", uid, doc, np.repeat(h[own], many), C.signed(e), place * RUN + 1)

    return C.written(keyed.mapInArrow(run, "uid long, doc_id long, h long, e long, run long"))


def repeated_words(source: DataFrame, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Documents as of indexed(), and the windows to remove (uid, run, source: the smallest
    id of a document that has them)."""
    base = indexed(source, k, m, digest=True)
    places = placed(base)
    compacted = places.groupBy("h", "c").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    compacted = C.written(compacted.select("h", "c", "source", (F.col("source") < F.col("last")).alias("again")))
    C.release(source.sparkSession)
    again = compacted.where("again").select("h", "c", "source")
    later = filtered(places, "c", again).join(again, ["h", "c"]).where("doc_id > source").select("uid", "run", "source")

    single = opened(base, compacted, k)
    firsts = single.groupBy("h", "e").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    firsts = C.written(firsts.where("source < last").select("h", "e", "source"))
    C.release(source.sparkSession)
    branched = filtered(single, "e", firsts).join(firsts, ["h", "e"]).where("doc_id > source")
    return base, later.unionByName(branched.select("uid", "run", "source"))


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 5, keep_text: bool = True
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with keep_text kept (the kept words
    joined by blanks; null if nothing was removed)."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    base, removed = repeated_words(source, k, m)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[] for _ in range(5)]
            for d, n_words, whole, t, spans in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                gone = 0
                if spans.is_valid and len(spans.values):
                    words = C.blank_words(t)
                    edge = np.zeros(len(words) + 1, np.int64)
                    s, n = np.divmod(spans.values.to_numpy(), RUN)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + k - 1, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                if gone:
                    kept = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o])
                    whole = hashlib.sha256(kept).hexdigest()
                for col, v in zip(cols, (d, n_words, gone, whole, kept.decode() if gone and keep_text else None), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    removed = C.written(removed.select("uid", "run"))
    C.release(docs.sparkSession)
    keys = removed.select(F.xxhash64("uid").alias("key"))
    keyed = base.select("uid", "doc_id", "n_words", "whole_sha256", "text", F.xxhash64("uid").alias("key"))
    spans = removed.groupBy("uid").agg(F.collect_list("run").alias("spans"))
    touched = filtered(keyed, "key", keys).join(spans, "uid", "left").select("doc_id", "n_words", "whole_sha256", "text", "spans")
    whole = [F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept")]
    rest = filtered(keyed.drop("text"), "key", keys, absent=True).select("doc_id", "n_words", *whole)
    out = touched.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string").unionByName(rest)
    return out if keep_text else out.drop("kept")
