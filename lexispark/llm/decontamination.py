"""Operator 1: benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item; an item of fewer words is one window.
Fingerprints: of the ``k``-gram hashes in each run of ``span - k + 1`` the smallest is
kept, so any shared window has a fingerprint in common (that run of hashes depends on
the window's words alone). Items shorter than a window keep the hash of all their words;
documents then keep every gram of those few lengths. Hits are extended to the windows
around them, compared as whole word strings, so hashes only ever propose.

A fixed-size bitmap of the items' fingerprints goes to the tasks, so that nearly all
document fingerprints are dropped where they are made; how full it is changes the work,
never the result. The windows are then joined with those of the items.

Rows: a null or empty text has no words and hits nothing; a null item id or item text is
skipped; repeated item texts count as items of their own; repeated documents give a row
each; empty tables give no rows, or rows without hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    return C.gram_hashes(words, k) ^ np.uint64(k * 0x9E3779B9)


def fingerprints(words: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps."""
    grams = _grams(words, k)
    if len(grams) < span - k + 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.unique(C.sliding_argmin(grams, span - k + 1))
    return at, grams[at]


def _items(items: DataFrame, item_col: str, text_col: str, k: int, span: int) -> DataFrame:
    """Each item's windows, and its fingerprints, as rows (kind, item_id, win, n, fp)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for ids, texts in C.batches(it):
            out: list[tuple] = []
            for i, t in zip(ids, texts, strict=True):
                words = C.alnum_words(t)
                if i is None or not words:
                    continue
                n = min(span, len(words))
                wins = {b" ".join(words[p : p + n]).decode() for p in range(len(words) - n + 1)}
                out += [(False, i, w, n, None) for w in wins]
                x = hashes.of(words)
                fps = fingerprints(x, k, span)[1] if n == span else _grams(x, n)
                out += [(True, None, None, n, int(f)) for f in set(C.signed(fps).tolist())]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["is_fp", "item_id", "win", "n", "fp"])

    return items.select(items[item_col].cast("string").alias("item_id"), items[text_col].alias("text")).mapInArrow(run, "is_fp boolean, item_id string, win string, n int, fp long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside shared windows), items (sorted
    ids of the items found), spans (start, end of the merged hits, in words) and uid, a
    key of the row; and a struct, row, of the columns of docs named in carry."""
    found = C.written(_items(items, item_col, item_text_col, k, span))
    bitmap = C.key_filter(found.where("is_fp"), "fp")
    spark = docs.sparkSession
    shorter = sorted(r["n"] for r in found.where(f"n < {span}").select("n").distinct().collect())  # at most span - 1 numbers
    sent = spark.sparkContext.broadcast(bitmap)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, uid = C.KeyFilter(sent.value), C.WordHashes(), TaskContext.get().partitionId() << 36
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            uids, counts, starts, wins = [], [], [], []
            for t in texts:
                words = C.alnum_words(t)
                uids.append(uid)
                uid += 1
                counts.append(len(words))
                got: list[tuple[int, int]] = []
                if words:
                    x, last = hashes.of(words), len(words) - span
                    at, fps = fingerprints(x, k, span)
                    hit = at[known.has(fps)] if len(at) else at
                    if len(hit):
                        near = (hit[:, None] + np.arange(k - span, 1)).ravel()
                        got += [(p, span) for p in np.unique(near[(near >= 0) & (near <= last)]).tolist()]
                    for n in shorter:
                        g = _grams(x, n)
                        if len(g):
                            got += [(p, n) for p in np.nonzero(known.has(g))[0].tolist()]
                starts.append([p for p, _ in got])
                wins.append([b" ".join(words[p : p + n]).decode() for p, n in got])
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), ids, pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(wins, pa.list_(pa.string())), *batch.columns[2:]], names=["uid", "doc_id", "n_words", "starts", "wins", *batch.schema.names[2:]])

    own = [docs[c].alias(f"_c{i}") for i, c in enumerate(carry)]
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *own)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[2:]]
    base = C.written(source.mapInArrow(run, ", ".join(["uid long, doc_id long, n_words long, starts array<int>, wins array<string>", *kept])))
    hits = base.where(F.size("wins") > 0).select("uid", F.explode(F.arrays_zip("starts", "wins")).alias("h")).select("uid", F.col("h.starts").alias("start"), F.col("h.wins").alias("win"))
    windows = found.where("NOT is_fp").select("win", "n", "item_id").distinct()
    true = hits.join(windows.select("win", "n").distinct(), "win").select("uid", "win", F.struct("start", (F.col("start") + F.col("n")).alias("end")).alias("hit"))
    named = true.select("uid", "win").distinct().join(windows.select("win", "item_id"), "win").groupBy("uid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    true = true.groupBy("uid").agg(F.sort_array(F.collect_set("hit")).alias("hits")).join(named, "uid")
    merged = F.aggregate(
        "hits",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, h: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= h["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], h["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(h))),
    )
    true = true.select("uid", "items", merged.alias("spans"))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long"))
    return base.drop("starts", "wins").join(true, "uid", "left").select("uid", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"), *([F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]).alias("row")] if carry else []))
