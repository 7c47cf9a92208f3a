"""Operator 9: sparse suffix arrays.

Of each window of ``span`` words the suffix at its smallest ``m``-gram (minimiser) is
retained, so any two equal windows retain suffixes at the same place in them.

1. The retained suffixes are sorted by Spark over ranges: by that gram, then by all the
   words to the left and right that lie in windows of theirs, then by document.
2. Each is compared with its neighbour before it. A run of equal neighbours is one entry;
   its first document is the source of all its windows. A run that goes on over the end of
   a task's range is stitched by one row a task, so a gram with a third of all suffixes is
   split like any other.
3. Where neighbours agree on the gram, but not on all the words around it, each distinct
   entry is extended to the left and right window by window, and the windows are sorted
   and compared with their neighbours the same way: the longest match of a suffix, to both
   sides at once, may be with one that isn't next to it in any single order.
4. The windows found are merged to spans, document by document.

The order of words is that of hashes, not of letters, which sorts equal contexts together
all the same; equality is that of two 64-bit hashes made of 64-bit hashes of the words.

Rows: as for operator 2. A document without repeated spans has no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C
from lexispark.llm import substrings as S


def compared(entries: DataFrame, x: str) -> DataFrame:
    """The entries (uid, doc_id, h, x, run) in the order of h, x and document, each compared
    with its neighbours: source is the first document of its run of equal h and x, and head
    tells the first entry of a run. Entries of the source that aren't heads are left out."""
    order = ["h", x, "doc_id"]
    dealt = entries.select("uid", "doc_id", "h", x, "run").repartitionByRange(*order).sortWithinPartitions(*order)
    names = f"uid doc_id h {x} run source head part last_h last_x last_source many".split()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, source, runs, first = TaskContext.get().partitionId(), None, 0, 0, None
        for b in it:
            if not b.num_rows:
                continue
            doc, h, c = (b.column(i).to_numpy() for i in (1, 2, 3))
            new = np.empty(len(h), bool)
            new[0] = (h[0], c[0]) != key
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            number = np.cumsum(new)  # of the run, from this batch's start on
            found = np.concatenate(([source], doc[new]))[number]
            open_ = number + runs <= 1  # the task's first run may have begun before
            keep = np.flatnonzero(new | open_ | (doc > found))
            if first is None:
                first = (int(h[0]), int(c[0]))
            key, source, runs = (h[-1], c[-1]), int(found[-1]), runs + int(number[-1])
            parts = pa.array(np.full(len(keep), part), mask=~open_[keep])
            none = pa.nulls(len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(pa.array(keep)) for i in range(5)], pa.array(found[keep]), pa.array(new[keep]), parts, none, none, none, none],
                names=names,
            )
        if first is not None:
            row = [None, None, *first, None, None, None, part, int(key[0]), int(key[1]), source, runs]
            types = [pa.int64()] * 6 + [pa.bool_()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    schema = ", ".join(f"{c} {'boolean' if c == 'head' else 'long'}" for c in names)
    out = C.written(dealt.mapInArrow(run, schema))
    fixed, key, source = [], None, None
    for r in out.where("many IS NOT NULL").orderBy("part").collect():  # one row a task
        goes_on = (r["h"], r[x]) == key
        if goes_on:
            fixed.append((r["part"], source))
        if not goes_on or r["many"] > 1:
            source = r["last_source"]
        key = (r["last_h"], r["last_x"])
    # sources of the tasks' first runs, by task (null: the run begins there): one number a task
    sources: list[int | None] = [None] * (1 + max((p for p, _ in fixed), default=0))
    for p, found in fixed:
        sources[p] = found
    before = F.get(F.from_json(F.lit(json.dumps(sources)), "array<long>"), F.col("part").cast("int"))
    rows = out.where("many IS NULL").withColumn("before", before)
    head = F.col("head") & F.col("before").isNull()
    return rows.select("uid", "doc_id", "h", x, "run", F.coalesce("before", "source").alias("source"), head.alias("head"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, m: int = 8) -> DataFrame:
    """doc_id, start, n_words: runs of words in windows of ``span`` words that also start in
    a document with a smaller id; source_doc_id: the smallest id found for the run."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    base = S.indexed(source, span, m, digest=False)
    entries = compared(S.placed(base), "c")
    windows = compared(S.opened(base, entries.where("head").select("h", "c", "source"), span), "e")
    found = entries.unionByName(windows.withColumnRenamed("e", "c")).where("doc_id > source")
    C.release(docs.sparkSession)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for d, spans in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                run, first = (spans.values.field(j).to_numpy() for j in range(2))
                start, n = np.divmod(run, S.RUN)
                order = np.argsort(start, kind="stable")
                start, end, first = start[order], (start + n)[order] + span - 1, first[order]
                reach = np.maximum.accumulate(end)
                new = np.nonzero(np.concatenate(([True], start[1:] > reach[:-1])))[0]
                last = np.append(new[1:], len(start)) - 1
                lengths = (reach[last] - start[new]).tolist()
                sources = np.minimum.reduceat(first, new).tolist()
                out += zip([d] * len(new), start[new].tolist(), lengths, sources, strict=True)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            names = ["doc_id", "start", "n_words", "source_doc_id"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    lists = found.groupBy("uid").agg(F.collect_list(F.struct("run", "source")).alias("spans"))
    merged = base.select("uid", "doc_id").join(lists, "uid").select("doc_id", "spans")
    return merged.mapInArrow(merge, "doc_id long, start long, n_words long, source_doc_id long")
