"""Operator 7: edit-aware token counts.

Each document keeps its pre-tokens in blocks under a segment tree whose nodes hold the
characters and tokens below them. An edit (start, end, replacement; code points of the
text as it then is) finds its block from the root, splits anew from the last pre-token
boundary that the edit cannot reach until a boundary falls on an old one again, encodes
the pre-tokens between, and updates the sums on the way to the root. The total is the
root's; nothing else is split or encoded again. A block that edits have grown to more than
twice its size is cut up, and the tree is set up anew over the sums of its blocks.

Why that is exact: the pattern has no look-behind, so what follows a boundary depends on
the text after it alone; and a pre-token depends on its own characters and the two after
it at most, so one that ends two characters before the edit stays.

Rows: a null text is empty; edits are applied in order, their ends clipped to the text;
null edits or replacements are none or empty; repeated rows give a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C

#: Pre-tokens of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after a pre-token that it may depend on.
CONTEXT = 2


class PieceCounts(dict):
    """Tokens of a pre-token, remembered for a bounded number of them."""

    LIMIT = 300_000
    _of_worker: dict[str, PieceCounts] = {}

    def __init__(self, ranks_path: str) -> None:
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def shared(cls, path: str) -> PieceCounts:
        if path not in cls._of_worker:
            cls._of_worker[path] = cls(path)
        return cls._of_worker[path]

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = n
        return n


_split = regex.compile(PATTERN)


class TokenTree:
    """Pre-tokens of one text in blocks, and the sums above them."""

    def __init__(self, text: str, counts: PieceCounts, block: int = 64) -> None:
        self.counts = counts
        self.block = block
        self._build([self._summed(b) for b in self._cut(_split.findall(text))] or [([], 0, 0)])
        self.reencoded = 0

    def _cut(self, pieces: list[str]) -> list[list[str]]:
        return [pieces[i : i + self.block] for i in range(0, len(pieces), self.block)]

    def _summed(self, pieces: list[str]) -> tuple[list[str], int, int]:
        return pieces, sum(map(len, pieces)), sum(map(self.counts.__getitem__, pieces))

    def _build(self, leaves: list[tuple[list[str], int, int]]) -> None:
        """The tree over these blocks and their sums."""
        self.blocks = [b for b, _, _ in leaves]
        self.leaves = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (self.leaves - len(leaves))
        self.chars = [0] * self.leaves + [c for _, c, _ in leaves] + pad
        self.tokens = [0] * self.leaves + [t for _, _, t in leaves] + pad
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _leaf(self, i: int, pieces: list[str]) -> None:
        at = self.leaves + i
        self.blocks[i], self.chars[at], self.tokens[at] = self._summed(pieces)

    def _cut_up(self, grown: int) -> None:
        """The tree with the grown block cut up and without empty blocks; sums of all other
        blocks are taken over. It takes ``block`` new pre-tokens or more to come here."""
        leaves = []
        for i, b in enumerate(self.blocks):
            if i == grown:
                leaves += [self._summed(part) for part in self._cut(b)]
            elif b:
                leaves.append((b, self.chars[self.leaves + i], self.tokens[self.leaves + i]))
        self._build(leaves)

    def _update(self, i: int) -> None:
        i = (self.leaves + i) // 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def _find(self, at: int) -> tuple[int, int]:
        """Block of the character at this place (or the last one), and where it starts."""
        i, start = 1, 0
        while i < self.leaves:
            i *= 2
            if at >= start + self.chars[i] and start + self.chars[i] < self.chars[1]:
                start += self.chars[i]
                i += 1
        return min(i - self.leaves, len(self.blocks) - 1), start

    @property
    def total(self) -> int:
        return self.tokens[1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        size = self.chars[1]
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        first, begin = self._find(max(0, start - CONTEXT))
        kept, safe = [], begin
        for p in self.blocks[first]:
            if safe + len(p) > start - CONTEXT:
                break
            kept.append(p)
            safe += len(p)
        rest = self.blocks[first][len(kept) :]
        last = first
        reach = safe + sum(map(len, rest))
        shift = len(replacement) - (end - start)
        while True:
            while last + 1 < len(self.blocks) and reach < end + 1:
                last += 1
                rest = rest + self.blocks[last]
                reach += self.chars[self.leaves + last]
            old = "".join(rest)
            text = old[: start - safe] + replacement + old[end - safe :]
            bounds, at = {safe: 0}, safe
            for n, p in enumerate(rest, 1):
                at += len(p)
                bounds[at] = n
            whole = last + 1 >= len(self.blocks)
            new: list[str] = []
            tail: list[str] | None = None
            for m in _split.finditer(text):
                place = safe + m.end() - shift
                if not whole and m.end() + CONTEXT > len(text):
                    break
                new.append(m[0])
                if place >= end and place in bounds:
                    tail = rest[bounds[place] :]
                    break
            if tail is None and whole:
                tail = []
            if tail is not None:
                break
            last += 1
            rest = rest + self.blocks[last]
            reach += self.chars[self.leaves + last]
        self.reencoded += len(new)
        self._leaf(first, kept + new + tail)
        for i in range(first + 1, last + 1):
            self._leaf(i, [])
        if len(self.blocks[first]) > 2 * self.block:
            self._cut_up(first)
            return
        for i in range(first, last + 1):
            self._update(i)


EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a column of their edits in order. edits: doc_id, seq, start, end, replacement."""
    own = edits.groupBy(F.col(id_col).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("_e"))
    own = own.select("_key", F.transform("_e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["replacement"].alias("replacement"))).alias("edits"))
    return docs.join(own, docs[id_col] == own["_key"], "left").drop("_key")


def token_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """doc_id, tokens_before, n_edits, n_reencoded (pre-tokens encoded again), tokens_after,
    chars_after. ranks_path: a rank file that every executor can read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts.shared(ranks_path)
        for ids, texts, edits in C.batches(it):
            out = []
            for d, t, es in zip(ids, texts, edits, strict=True):
                tree = TokenTree(t or "", counts)
                before = tree.total
                es = [e for e in es or () if e is not None]
                for e in es:
                    start = e["start"] or 0
                    tree.edit(start, start if e["end"] is None else e["end"], e["replacement"] or "")
                out.append((d, before, len(es), tree.reencoded, tree.total, tree.chars[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "tokens_before", "n_edits", "n_reencoded", "tokens_after", "chars_after"])

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[edits_col].cast(EDITS).alias("edits"))
    return source.mapInArrow(run, "doc_id long, tokens_before long, n_edits long, n_reencoded long, tokens_after long, chars_after long")


def revision_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with four edits each that follow from id and length: an insertion, a
    replacement, a deletion and one at the text's end."""
    size = F.coalesce(F.length(docs[text_col]), F.lit(0)).cast("long")
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    place = lambda salt: F.pmod(F.crc32(F.concat(key, F.lit(salt))), size + 1)
    edit = lambda a, b, r: F.struct(a.alias("start"), b.alias("end"), F.lit(r).alias("replacement"))
    edits = F.array(edit(place("a"), place("a"), " (revised 2024)"), edit(place("b"), place("b") + 12, "it's "), edit(place("c"), place("c") + 40, ""), edit(size, size + 100, "\n  end."))
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), edits.alias("edits"))
