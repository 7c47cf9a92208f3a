"""Operator 8: bounded-space online packing of token ids into fixed windows.

Each task keeps ``open_windows`` windows open. A document goes whole into the fullest
window that still holds it; when none does, the fullest window is topped up with the
document's head (if at least ``min_cut`` ids fit) and emitted. Longer documents give
full windows first. What is open at a task's end is leftover: those pieces meet in
fewer tasks, are packed again the same way, and the last open windows of each such task
are joined end to end, so that one sequence a task at most is partly filled.

Rows: null and empty texts have the end id alone; a null document id is carried along;
repeated rows are packed each for itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, leftover boolean"
_ARROW = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary()), ("leftover", pa.bool_())])
#: Sequences of the second level are numbered from here on.
SECOND_LEVEL = 1 << 62


class ChunkIds(dict):
    """Ids (little-endian 32 bits) of a run without ASCII white space. The tokenizer
    drops white space and never joins what it parts, so runs stand for themselves; A-Z
    is lower-cased first, as the tokenizer does, unless a control string may be near.

    Runs are remembered in two generations of bounded size: when the young one is full
    it becomes the old one, and what is asked again moves on to the next young one.
    """

    LIMIT, LONGEST = 250_000, 40
    _of_worker: dict[str, ChunkIds] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {c: self._whole(c) for c in (".", ",")}

    @classmethod
    def shared(cls, path: str) -> ChunkIds:
        """One for each file in a Python worker, kept from task to task."""
        if path not in cls._of_worker:
            cls._of_worker[path] = cls(path)
        return cls._of_worker[path]

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _make(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        simple = _SIMPLE.fullmatch(text)
        if not simple:
            return self._whole(text)
        if simple[2]:
            return self[chunk[:-1]] + self.marks[simple[2]]
        # one run of lower-case letters, which needs no normalizing and no splitting
        word = text if text.isascii() else chunk.decode("latin-1").translate(_BYTE_LEVEL)
        return b"".join([x.id.to_bytes(4, "little") for x in self.tokenizer.model.tokenize(word)])

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            out = self._make(chunk)
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8")
        if b"<|" not in raw:
            raw = raw.translate(C.LOWER)
        return b"".join(map(self.__getitem__, raw.split()))


_SIMPLE = re.compile("([a-zß-öø-ÿ]+)([.,]?)")
#: The byte-level alphabet for the bytes of such words (all else is no Latin-1 letter).
_BYTE_LEVEL = {b: c for b, c in zip([*range(0x7F, 0xA1), 0xAD], range(256 + 33, 256 + 33 + 35), strict=True)}


class Packer:
    """Open windows of one task. Pieces are (doc_id, start, bytes of ids, doc_tokens)."""

    def __init__(self, size: int, most: int, min_cut: int, first: int) -> None:
        self.size, self.most, self.min_cut, self.next = size, most, min_cut, first
        self.fills: list[tuple[int, int]] = []  # (fill, window), sorted
        self.windows: dict[int, list] = {}
        self.done: list[tuple[int, list]] = []

    def _new(self) -> int:
        self.next += 1
        self.windows[self.next - 1] = []
        return self.next - 1

    def _emit(self, window: int) -> None:
        self.done.append((window, self.windows.pop(window)))

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        while n >= self.size:
            w = self._new()
            self.windows[w].append((doc, start, ids[: 4 * self.size], total))
            self._emit(w)
            ids, start, n = ids[4 * self.size :], start + self.size, n - self.size
        while n:
            at = bisect_right(self.fills, (self.size - n, 1 << 63)) - 1
            if at >= 0:
                fill, w = self.fills.pop(at)
            elif len(self.fills) < self.most:
                fill, w = 0, self._new()
            else:
                fill, w = self.fills.pop()
                gap = self.size - fill
                if gap >= self.min_cut:
                    self.windows[w].append((doc, start, ids[: 4 * gap], total))
                    ids, start, n = ids[4 * gap :], start + gap, n - gap
                self._emit(w)
                continue
            self.windows[w].append((doc, start, ids, total))
            if fill + n == self.size:
                self._emit(w)
            else:
                insort(self.fills, (fill + n, w))
            return

    def join_rest(self) -> None:
        """Open windows end to end, cut at each full sequence."""
        rest = [p for _, w in reversed(self.fills) for p in self.windows[w]]
        self.fills, self.windows = [], {}
        w, fill = self._new(), 0
        for doc, start, ids, total in rest:
            while ids:
                head = ids[: 4 * (self.size - fill)]
                self.windows[w].append((doc, start, head, total))
                ids, start, fill = ids[len(head) :], start + len(head) // 4, fill + len(head) // 4
                if fill == self.size:
                    self._emit(w)
                    w, fill = self._new(), 0
        if fill:
            self._emit(w)

    def rows(self, keep_ids: bool, leftover: bool = False) -> pa.RecordBatch:
        windows = [(w, self.windows[w]) for _, w in self.fills] if leftover else self.done
        cols: list[list] = [[] for _ in _ARROW]
        for w, pieces in windows:
            offset = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                for c, v in zip(cols, (doc, start, n, zlib.crc32(ids), total, w, offset, ids if keep_ids or leftover else None, leftover), strict=True):
                    c.append(v)
                offset += n
        if not leftover:
            self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, open_windows: int = 64, min_cut: int = 64, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document with the sequence and offset they lie at, and their ids
    (binary, little-endian 32 bits) if keep_ids. tokenizer: a file of the tokenizers
    library that every executor can read."""
    end = end_id.to_bytes(4, "little")

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, p = ChunkIds.shared(tokenizer), Packer(size, open_windows, min_cut, TaskContext.get().partitionId() << 32)
        for doc_ids, texts in C.batches(it):
            for d, t in zip(doc_ids, texts, strict=True):
                ids = ids_of.of(t) + end
                p.add(d, 0, ids, len(ids) // 4)
                if len(p.done) >= 2000:
                    yield p.rows(keep_ids)
            yield p.rows(keep_ids)
        yield p.rows(keep_ids)
        yield p.rows(keep_ids, leftover=True)

    def second(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(size, open_windows, min_cut, SECOND_LEVEL + (TaskContext.get().partitionId() << 32))
        for d, start, ids, total in ((x for b in it for x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))):
            p.add(d, start, ids, total)
            if len(p.done) >= 2000:
                yield p.rows(keep_ids)
        p.join_rest()
        yield p.rows(keep_ids)

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    level1 = C.written(source.mapInArrow(first, SCHEMA))
    rest = level1.where("leftover")
    tasks = rest.select(F.shiftright("sequence_id", 32)).distinct().count()
    level2 = rest.repartition(max(1, -(-tasks // 32)), "sequence_id").sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "ids", "doc_tokens").mapInArrow(second, SCHEMA)
    out = level1.where("NOT leftover").unionByName(level2).drop("leftover")
    return out if keep_ids else out.drop("ids")
