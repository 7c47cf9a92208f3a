"""Operator 10: line dedup on a log-template tree of fixed depth.

A line's tokens are its runs without ASCII white space; tokens with a digit are variable
fields. The tree branches by token count, then by the leading ``lead`` tokens; below
them lie the templates, the rest of the line in ``parts`` runs of nearly equal length:
the line itself, and (from ``least_general`` tokens on) the line with one of the runs as
a variable field. So a line has 1 + parts templates, and lines that differ in one place
share one, whatever the order they come in; no list of lines is ever held together.

A template recurs if it lies in ``min_docs`` documents or more. In the order of doc_id and
line number, a line goes if it shares a recurring template with a line before it that stays,
and stays otherwise; so every recurring template keeps a line, or each of its lines went for
another one that stays. This is found in rounds: lines that are first of all their recurring
templates stay, lines that share a template with them go, and the lines that are left (those
whose templates' first line went for another template) are judged among themselves. A round
judges most lines; a chain of lines, each sharing a template with the next alone, takes one
round for two of its lines. Lines of fewer than ``least`` tokens are never dropped.

Rows: a null text has no lines and stays null; a text whose lines all go is empty; rows
with equal ids are documents of their own, and of their lines none is first alone; a
null id is never first before another; extra columns are carried along whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C
from lexispark.llm import words as W

#: What a token with a digit counts as.
FIELD = b"<*>"
_IS_DIGIT = bytes(48 <= c <= 57 for c in range(256))
_LAST = (1 << 63) - 1


class Tree:
    def __init__(self, lead: int, parts: int, least: int, least_general: int) -> None:
        self.lead, self.parts, self.least, self.least_general = lead, parts, least, least_general
        self.sums = W.Sums()
        self.field = W.Words(FIELD, np.array([0, len(FIELD)]), W.BLANK).h[0]

    def keys(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, line and template of every line that may be dropped. words: tokens of a
        few texts."""
        raw, lead, parts = np.frombuffer(words.raw, np.uint8), self.lead, self.parts
        h = words.h.copy()
        digits = np.flatnonzero(np.frombuffer(words.raw.translate(_IS_DIGIT), bool))
        h[np.searchsorted(words.start, digits, side="right") - 1] = self.field
        breaks = np.flatnonzero(raw == 10)
        text = np.repeat(np.arange(len(words.bounds) - 1), words.counts())
        above = np.searchsorted(breaks, words.start)  # line breaks before each token
        new = np.empty(len(h), bool)
        new[:1] = True
        new[1:] = (above[1:] != above[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        first, n = first[n >= self.least], n[n >= self.least]
        text, line = text[first], above[first]
        line = line - np.searchsorted(breaks, words.bounds[:-1])[text]
        sums, rest = self.sums.of(h), n - lead
        cuts = [first + lead + rest * j // parts for j in range(parts + 1)]
        leaf = C.mix(self.sums.runs(sums, first, first + lead) ^ C.mix(n.astype(np.uint64)))
        placed = [
            C.mix(self.sums.runs(sums, cuts[j], cuts[j + 1]) + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15 >> 3))
            for j in range(parts)
        ]
        whole = sum(placed[1:], placed[0])
        general = n >= self.least_general
        # a template of kind j > 0 lacks run j; the kind is part of the key
        kind = [np.uint64((j + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1) for j in range(parts)]
        many = [(text, line, C.mix(leaf + whole))]
        for j in range(parts):
            many.append((text[general], line[general], C.mix(leaf + whole - placed[j] + kind[j])[general]))
        return tuple(np.concatenate(x) for x in zip(*many, strict=True))


def dropped(judged: DataFrame) -> DataFrame:
    """_uid, line of the lines that go. judged: a row for each line and recurring template of
    it, with its place and whether it leads, that is, whether no line of the template is
    before it."""
    gone: DataFrame | None = None
    line = ["_uid", "line"]
    while True:
        lines = C.written(judged.groupBy(*line).agg(F.bool_and("leads").alias("stays"), F.count_if(~F.col("leads")).alias("others"), F.count("*").alias("n")))
        away = lines.where("NOT stays").select(*line)
        gone = away if gone is None else gone.join(lines.where("stays").select(*line), line, "left_anti")
        # templates whose first line goes: no line went for them, so others of theirs may stay
        leaders = judged.join(lines.where("NOT stays AND others < n").select(*line), line, "left_semi").where("leads")
        open_ = leaders.select("key").distinct().join(judged.where("leads").join(lines.where("stays").select(*line), line, "left_semi").select("key"), "key", "left_anti")
        open_ = C.written(open_)
        if open_.isEmpty():
            return gone
        spared = judged.where("NOT leads").join(open_, "key", "left_semi").groupBy(*line).agg(F.count("*").alias("spared"))
        left = C.written(lines.join(spared, line).where("spared = others").select(*line))
        if left.isEmpty():
            return gone
        rest = judged.join(left, line, "left_semi").select(*line, "key", "place")
        first = rest.groupBy("key").agg(F.min("place").alias("first"))
        judged = C.written(rest.join(first, "key").select(*line, "key", "place", (F.col("place") == F.col("first")).alias("leads")))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    lead: int = 2,
    parts: int = 4,
    least: int = 3,
    least_general: int = 8,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """The rows of docs, their text without the dropped lines, and the numbers of their lines
    and of dropped ones (appended under the names in counts; a column of docs of such a name
    is replaced)."""
    spark = docs.sparkSession
    tree = Tree(lead, parts, least, least_general)
    names = [c for c in docs.columns if c not in (id_col, text_col, *counts)]
    source = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(names)])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(found: list[tuple]) -> pa.RecordBatch:
            key, doc, line, row = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((line, doc, key))
            key, doc, line, row = key[order], doc[order], line[order], row[order]
            same = key[1:] == key[:-1]
            new = np.flatnonzero(np.concatenate(([True], ~same)))
            pairs = np.concatenate(([True], ~same | (row[1:] != row[:-1]))).astype(np.int64)
            cols = C.signed(key[new]), np.add.reduceat(pairs, new), doc[new], line[new]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "n", "doc", "line"])

        for b in it:
            ids = b.column(0).fill_null(_LAST).to_numpy()
            found, size = [], 0
            for lo, words in W.chunks(b.column(1), W.BLANK):
                row, line, key = tree.keys(words)
                if len(key):
                    found.append((key, ids[lo + row], line, lo + row))
                    size += len(key)
                if size > 300_000:
                    yield sums(found)
                    found, size = [], 0
            if found:
                yield sums(found)

    counted = source.select("_id", "_text").mapInArrow(count, "key long, n long, doc long, line long")
    recurring = C.written(counted.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "line")).alias("first")).where(F.col("n") >= min_docs).select("key", "first"))
    sent = spark.sparkContext.broadcast(C.key_filter(recurring, "key"))

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uid = C.KeyFilter(sent.value), TaskContext.get().partitionId() << 36
        for b in it:
            none = np.empty(0, np.int64)
            rows, lines, keys = [none], [none], [none]
            for lo, words in W.chunks(b.column(1), W.BLANK):
                row, line, key = tree.keys(words)
                hit = known.has(key)
                rows.append(lo + row[hit])
                lines.append(line[hit])
                keys.append(C.signed(key[hit]))
            row, line, key = (np.concatenate(x) for x in (rows, lines, keys))
            order = np.argsort(row, kind="stable")
            at = pa.array(np.searchsorted(row[order], np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x[order], pa.int64())) for x in (line, key)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.arange(uid, uid + b.num_rows)), *lists],
                names=[*b.schema.names, "_uid", "_lines", "_keys"],
            )
            uid += b.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    base = C.written(source.mapInArrow(ask, schema + ", _uid long, _lines array<long>, _keys array<long>"))
    places = base.where(F.size("_keys") > 0).select("_uid", F.col("_id").alias("id"), F.explode(F.arrays_zip("_lines", "_keys")).alias("p")).select("_uid", "id", F.col("p._lines").alias("line"), F.col("p._keys").alias("key"))
    own = F.struct(F.coalesce("id", F.lit(_LAST)).alias("doc"), F.col("line").cast("long").alias("line"))
    judged = C.written(places.join(recurring, "key").select("_uid", "line", "key", own.alias("place"), (own == F.col("first")).alias("leads")))
    drop = dropped(judged).groupBy("_uid").agg(F.collect_set("line").alias("_drop"))
    carried = [F.col("_id"), F.col("_text"), *[F.col(f"_c{i}") for i in range(len(names))]]
    # texts meet the list of their dropped lines by a shuffle, however short the lists are
    touched = base.where(F.size("_keys") > 0).join(drop.hint("merge"), "_uid", "left").select(*carried, "_drop")
    clean = base.where(F.size("_keys") == 0).select(*carried, F.lit(None).cast("array<long>").alias("_drop"))
    out = touched.unionByName(clean)
    lines = F.split("_text", "\n")
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_drop", i.cast("long"))), "\n"))
    named = {id_col: F.col("_id"), text_col: kept, **{c: F.col(f"_c{i}") for i, c in enumerate(names)}}
    return out.select(*[named[c].alias(c) for c in docs.columns if c in named], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias(counts[1]))
