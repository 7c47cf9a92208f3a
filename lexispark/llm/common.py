"""Helpers shared by the operators: words, hashes, fixed-size filters, cut lineage."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.session import shared_dir

#: Fixed-size key filters have 2**FILTER_BITS bits (4 MB), whatever the input.
FILTER_BITS = 25
#: A-Z to a-z; every other ASCII character that is no digit or letter to a blank.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_LIMIT = 400_000


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def gram_hashes(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of each run of k words; two families are independent of each other."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, base = words[:n].copy(), _BASES[family]
    if family:
        out = mix(out + base)
    for i in range(1, k):
        out *= base
        out += words[i : i + n] if not family else mix(words[i : i + n] ^ base)
    return mix(out)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value (the last of equals) in each run of w values."""
    if len(x) < w:
        return np.empty(0, np.int64)
    best, at, width = x, np.arange(len(x)), 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(best) - shift
        later = best[shift:] <= best[:n]
        return np.where(later, best[shift:], best[:n]), np.where(later, at[shift:], at[:n])

    while 2 * width <= w:
        best, at = joined(width)
        width *= 2
    return joined(w - width)[1] if width < w else at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def own_folder(spark: SparkSession) -> str:
    """A name for a folder in the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/lexispark-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and no task's
    second run can give other rows. The table goes when the driver ends."""
    spark = df.sparkSession
    path = own_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended first
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of jobs whose frames nobody holds any more; it
    does so when the driver's JVM collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def key_filter(keys: DataFrame, col: str, bits: int = FILTER_BITS) -> bytes:
    """A bitmap of the keys' low bits, of 2**bits bits at most whatever the number of
    keys. It only spares work: a key outside it is surely absent, one inside may be."""
    slot = F.col(col).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")
    rows = (
        keys.where(F.col(col).isNotNull())
        .select(slot)
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
        .toLocalIterator()
    )
    out = bytearray((1 << bits) // 8 + 4096)
    for r in rows:  # at most 2**bits / 32768 + 1 rows of 4 KB
        if r["bucket"] < 1:  # slot 0 alone; has() always lets it through
            continue
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(r["bitmap"], np.uint8)
        view = np.frombuffer(out, np.uint8)[at : at + len(part)]
        view |= part
    return bytes(out)


class KeyFilter:
    """Reads what key_filter() made."""

    def __init__(self, data: bytes, bits: int = FILTER_BITS) -> None:
        self.data, self.mask = np.frombuffer(data, np.uint8), np.uint64((1 << bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.view(np.uint64) & self.mask).astype(np.int64)
        at = slot - 1  # position in the numbering of Spark's bitmaps
        hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return hit.astype(bool) | (slot == 0)


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """Columns of each batch as Python lists."""
    for b in it:
        if b.num_rows:
            yield tuple(b.column(i).to_pylist() for i in range(b.num_columns))


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only these columns, so that others, whatever their names, never meet ours."""
    return df.select(*[df[c] for c in cols])
