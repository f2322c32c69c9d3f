"""Shared pieces of the training-data operators: tables, staging, hashing in numpy, bounded bitmaps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, ship, stage  # noqa: F401

#: Text bytes that one numpy step handles at once; a longer text makes a step of its own.
CHUNK_BYTES = 1 << 19
#: Bits of a broadcast bitmap: 2**23 bits are 1 MB however large the corpus is.
BITMAP_BITS = 1 << 23
_BUCKET = 32768  # bits that one row of bitmap_construct_agg holds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns cannot clash."""
    return df.select(*(F.col(f"`{have}`").alias(name) for name, have in columns.items()))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a long key. The derived key makes both sides exchange anew, which is what lets
    adaptive execution split a hot key, also when right is an aggregate by that key."""
    r = right.withColumn("_k", -F.col(key)).drop(key)
    return left.withColumn("_k", -F.col(key)).join(r, "_k", how).drop("_k")


# ---- bounded bitmaps, JVM side -------------------------------------------------------------


def bitmap_of(keys: DataFrame, key: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """At most bits/32768 rows of 4 KB that mark the keys; a fixed size, so safe to broadcast."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        keys.select(bit.alias("_b"))
        .groupBy(F.floor(F.col("_b") / _BUCKET).cast("int").alias("_bucket"))
        .agg(F.bitmap_construct_agg((F.col("_b") % _BUCKET).cast("long")).alias("_bitmap"))
    )


def mark_in_bitmap(df: DataFrame, key: Column, bitmap: DataFrame, flag: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Add flag: true for every key in the bitmap, and for a few others that share a bit."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_b % 32768 as int) div 8 + 1, 1)")), 16, 10).cast("int")
    out = df.withColumn("_b", bit).withColumn("_bucket", F.floor(F.col("_b") / _BUCKET).cast("int"))
    out = out.join(F.broadcast(bitmap), "_bucket", "left").withColumn("_byte", byte)
    hit = F.expr("coalesce(shiftright(_byte, cast(_b % 8 as int)) & 1, 0) = 1")
    return out.withColumn(flag, hit).drop("_b", "_bucket", "_bitmap", "_byte")


def bits_for(count: int, least: int = BITMAP_BITS, most: int = 1 << 28) -> int:
    """Bits of a bitmap for so many keys: 8 each, within 1 and 32 MB."""
    return min(max(least, 1 << max(0, 8 * count - 1).bit_length()), most)


def split_by_ids(docs: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose key is not in ids (its column id), with docs' columns; and the others, with a few that
    share a bit, as (row, key). Only those need a join, so the texts of the first part are not moved."""
    bits = bits_for(ids.count())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    marked = mark_in_bitmap(rows, F.col("key"), bitmap_of(ids, F.col("id"), bits), "on", bits)
    return marked.filter("NOT on").select("row.*"), marked.filter("on").select("row", "key")


# ---- memory of Python workers -----------------------------------------------------------------

_held: list = ["", None]


def claim(owner: str, forget=None) -> None:
    """Workers are used again by later stages. The first task of another operator in a worker lets go of what the
    one before keeps there between its tasks (forget), and gives freed memory back to the system."""
    if _held[0] == owner:
        return
    if _held[1] is not None:
        _held[1]()
    _powers.clear()
    _held[:] = [owner, forget]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---- numpy over Arrow text ------------------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a text column, null as empty, without making Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about most bytes together; never splits a text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def byte_chunks(batches, text: int = 1, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their text bytes, offsets) for about CHUNK_BYTES of text at a time."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(text))
        for i, j in chunks(offsets, most):
            yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            have[filled : filled + step] = have[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbours of h (len(h)-k+1 values)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_INV, n)[: n - k + 1] + np.uint64(k))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and for every value the number of its place."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts: byte ranges, hashes (A-Z lower-cased), text bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        space = _SPACE[data]
        word = ~space
        begins = word.copy()
        begins[1:] &= space[:-1]
        ends = word.copy()
        ends[:-1] &= space[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] |= word[inner]
        ends[inner - 1] |= word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE_LOWER[data] * powers(_BASE, n), out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * powers(_INV, n + 1)[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.bounds = np.searchsorted(self.start, offsets)
