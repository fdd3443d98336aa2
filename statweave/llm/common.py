"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import Stored, free_shuffles, release, shared_dir, stored, tables  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(c, UPPER, LOWER)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column ``row`` beside new columns, whose names then clash with none of docs'."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs again, with a new text and, where docs has it, n_chars set anew."""
    out = df.select("row", text.alias("new"))
    made = []
    for f in docs.schema.fields:
        own = F.col("row").getField(f.name)
        own = F.col("new") if f.name == "text" else F.length("new").cast(f.dataType) if f.name == "n_chars" else own
        made.append(own.alias(f.name, metadata=f.metadata))
    return out.select(*made)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as UTF-8 bytes (uint8) and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[ends[0] : ends[-1]], ends - ends[0]


#: Bytes of a shuffled partition, about.
PARTITION_BYTES = 64 << 20


def partitions(spark: SparkSession, size: int) -> int:
    """Partitions for a shuffle of ``size`` bytes: the session's number, or more where they would become too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PARTITION_BYTES))


#: Rows of a key from which on its partner is broadcast, instead of all of them going to one task; and how many such keys at most (some 100 bytes each: 20 MB).
HOT = 1_000
HOT_KEYS = 200_000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str) -> DataFrame:
    """left.join(right, keys, how), inner or left_semi, where ``right`` is a stored table with the number of left's ``rows`` of each key.

    Keys of more than HOT rows are broadcast, so left's rows stay where they are; beyond HOT_KEYS of them it is left to adaptive execution to split them.
    """
    hot = right.where(F.col(rows) > HOT)
    if not 0 < hot.count() <= HOT_KEYS:
        return left.join(right, keys, how)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(rows) <= HOT), keys, how)
    return left.join(F.broadcast(hot), keys, how).unionByName(rest)


#: Bytes of an Arrow batch between Spark and Python: what a worker makes of a batch of texts is several times as large.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES, which the session keeps as its setting (unless it has a smaller one)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", df.sparkSession.conf.get(name, None) or "")
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory to the system, as a worker waits for its next task beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


def blocks(offsets: np.ndarray, limit: int):
    """Row ranges (i, j) of at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply and shift rounds); works on a copy."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_table(word_bytes: np.ndarray) -> np.ndarray:
    """A lookup table of 256 flags."""
    flags = np.zeros(256, bool)
    flags[word_bytes] = True
    return flags


class Words:
    """Words of a batch of texts: where they start and end, their text and a 64-bit hash, by numpy alone.

    ``is_word``: flags of the 256 byte values that words are made of. ``fold``: lower-case A-Z for the hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        n = len(data)
        flags = np.zeros(n + 2, np.int8)
        flags[1:-1] = is_word[data]
        step = np.diff(flags)
        start, end = step == 1, step == -1
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        both = inner[(flags[inner] & flags[inner + 1]) == 1]  # a word never runs over the end of a text
        start[both] = end[both] = True
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end)
        #: The first word of each text, and one more entry.
        self.first = np.searchsorted(self.starts, offsets)
        if hashed:
            self.hashes = span_hashes(data, self.starts, self.ends)


LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
#: What the first n of 8 bytes leave of a number, the lowest byte being the first.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte spans in lower case (A-Z).

    Up to 16 bytes are taken whole, as two numbers that are mixed one after the
    other; longer spans are named by xxh3. No arithmetic of the bytes' places is
    involved, so spans of one structure (mirror images, say) get names as unlike as any.
    """
    padded = np.concatenate([LOWERED[data], np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    size = ends - starts
    head, tail = np.minimum(size, 8), np.clip(size - 8, 0, 8)
    out = mix(eight[starts] & FIRST_BYTES[head] ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + (eight[starts + 8] & FIRST_BYTES[tail]))
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = padded.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out
