"""Words of many texts at once, as columns of numbers.

The bytes of a column of texts are read as one array, in chunks of about ``CHUNK`` bytes:
where words begin and end, and a 64-bit hash of each, made of eight bytes at a time. No
word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexispark.llm import common as C

#: Bytes of texts that are read at once; a longer text is a chunk of its own.
CHUNK = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first so many bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Sums:
    """Hashes of any run of words of a sequence in constant time: sums of words times
    powers of an odd base, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    _inverse = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            p = np.full(n, b, np.uint64)
            p[0] = 1
            return np.cumprod(p)

        self.up, self.down = powers(self.BASE), powers(self._inverse)

    def of(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if len(self.up) < n + 1:
            self._grow(max(4096, 2 * n))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(C.mix(words ^ np.uint64(0xA0761D6478BD642F)) * self.up[:n], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return C.mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Kind:
    """What words are made of: a flag for each byte, and the byte that it counts as."""

    def __init__(self, inside: bytes, fold: bytes | None = None) -> None:
        self.inside, self.fold = inside, fold


_NOT_BLANK = bytes(c != 32 and not 9 <= c <= 13 for c in range(256))
#: words ``[^\x20\x09-\x0D]+`` as they are, and with A-Z lower-cased
BLANK = Kind(_NOT_BLANK)
LOWER = Kind(_NOT_BLANK, C.LOWER)
#: words of digits, ASCII letters and all beyond ASCII, with A-Z lower-cased
ALNUM = Kind(bytes(x != 32 for x in C.ALNUM), C.LOWER)


class Words:
    """Words of a few texts: hash h, bytes start to end of raw; those of text i are
    first[i] to first[i + 1]."""

    def __init__(self, raw: bytes, bounds: np.ndarray, kind: Kind) -> None:
        self.raw, self.bounds = raw, bounds
        inside = np.frombuffer(raw.translate(kind.inside), bool)
        edge = np.zeros(len(raw) + 1, bool)  # whether a text begins here
        edge[bounds] = True
        near = inside[:-1] & inside[1:] & ~edge[1:-1]  # a byte goes on with the word of the one before
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~near
        ends[:-1] &= ~near
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.h = self._hashes(raw.translate(kind.fold) if kind.fold else raw)

    def _hashes(self, folded: bytes) -> np.ndarray:
        eights = np.frombuffer(folded + bytes(16 - len(folded) % 8), np.uint64)
        at, left = self.start, self.end - self.start
        out = C.mix(left.astype(np.uint64) * _STEP)
        more = None  # words that go on, once some have ended
        while len(at):
            q, r = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
            own = (eights[q] >> r) | ((eights[q + 1] << np.uint64(1)) << (np.uint64(63) - r))
            own &= _FIRST[np.minimum(left, 8)]
            if more is None:
                out = C.mix(out ^ own)
                more = np.flatnonzero(left > 8)
                at, left = at[more] + 8, left[more] - 8
            else:
                out[more] = C.mix(out[more] * _STEP ^ own)
                on = left > 8
                more, at, left = more[on], at[on] + 8, left[on] - 8
        return out

    def of(self, i: int) -> np.ndarray:
        """Hashes of the words of text i."""
        return self.h[self.first[i] : self.first[i + 1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text i (those that keep flags), joined by blanks; of kind BLANK."""
        words = self.raw[self.bounds[i] : self.bounds[i + 1]].split()
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep.tolist(), strict=True) if k])


def texts_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes of a column of texts, and where each begins; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return memoryview(data if data is not None else b""), at


def chunks(column: pa.Array, kind: Kind, size: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """Words of the texts of a column, a few texts at a time, each with the first's number."""
    if not len(column):
        return
    raw, at = texts_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, Words(raw[at[lo] : at[hi]].tobytes(), at[lo : hi + 1] - at[lo], kind)
        lo = hi
