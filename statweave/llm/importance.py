"""Importance resampling towards a target distribution, on hashed n-gram features.

Documents and target texts are bags of n-grams of 1 to ``width`` words, put into
buckets by the CRC-32 of their UTF-8 bytes.  A bucket's gain is the logarithm of
its smoothed share among the target's features over that among the documents'; a
document's weight is the sum of its features' gains.  Adding Gumbel noise, which
comes from the doc_id alone, and taking the highest scores draws documents without
replacement in proportion to the exponentials of their weights.

N-grams are never made as strings.  A CRC is linear over GF(2): that of two strings
in a row is the first one's, shifted by the second one's length, xor the second
one's.  The CRC of each word is computed once; shifting by a length is a product
of 32 x 32 bit matrices, one for each power of two, applied to all n-grams of a
block of texts at a time through tables of bytes.

Two passes over the documents: counts by bucket (a task passes on at most one row
for each bucket), then weights.  The buckets' gains are the model, of a size that
``buckets`` alone sets.  Ranks come from a sort by range that is stored, and the
rows of its partitions; nothing but a row per partition goes to the driver.

Defined results: a null or empty text has no words; a document without features
weighs 0; a null doc_id is written as nothing in the noise's key and comes last
among ties; rows that agree in all that is returned are ranked one after another;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, Stored, Words, blocks, byte_table, map_arrow, text_buffer

#: Words: runs of letters of A-Z and a-z, digits, and everything beyond ASCII.
WORD_BYTES = byte_table(np.r_[48:58, 65:91, 97:123, 128:256])
#: Buckets at most: their gains go to all tasks (8 bytes each).
MOST_BUCKETS = 1 << 22
#: Bytes of a word that are taken together with those of all other words; longer words are finished one by one.
TOGETHER = 24


def _byte_step() -> np.ndarray:
    """What a byte does to the register: the usual table, from its reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


STEP = _byte_step()


def _shift_tables(powers: int = 32) -> np.ndarray:
    """For each power of two p, four tables of 256: what p zero bytes do to each byte of a CRC. Squares of one matrix, by its images of single bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = STEP[bits & np.uint32(255)] ^ (bits >> np.uint32(8))  # one zero byte
    out = np.zeros((powers, 4, 256), np.uint32)
    for p in range(powers):
        for k in range(4):
            for b in range(8):
                on = (np.arange(256) >> b & 1).astype(bool)
                out[p, k, on] ^= image[8 * k + b]
        image = _apply(out[p], image)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        tables[0][crc & np.uint32(255)] ^ tables[1][crc >> np.uint32(8) & np.uint32(255)]
        ^ tables[2][crc >> np.uint32(16) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)]
    )


SHIFT = _shift_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved past that many bytes: the product of the matrices of its length's powers of two."""
    out, p, most = crc.copy(), 0, int(lengths.max(initial=0))
    while most >> p:
        on = np.flatnonzero(lengths >> p & 1)
        out[on] = _apply(SHIFT[p], out[on])
        p += 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte spans, a byte of all of them at a time, longest first so that those still running lead."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    running = len(order) - np.searchsorted(size[::-1], np.arange(min(TOGETHER, int(size.max(initial=0)))), "right")
    for i, n in enumerate(running.tolist()):
        head = crc[:n]
        crc[:n] = STEP[(head ^ data[at[:n] + i]) & np.uint32(255)] ^ (head >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(len(order) - int(np.searchsorted(size[::-1], TOGETHER, "right"))):
        crc[k] = zlib.crc32(data[at[k] + TOGETHER : at[k] + size[k]], int(crc[k]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def gram_crcs(crcs: np.ndarray, lengths: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``width`` words: the CRCs of all runs of so many words with single spaces between, and the first run of each text (and one more entry)."""
    yield crcs, first
    spaced = shifted(np.full(len(crcs), zlib.crc32(b" "), np.uint32), lengths) ^ crcs
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams, begin = crcs, np.arange(len(crcs))
    for n in range(2, width + 1):
        stay = begin + n - 1 < first[text[begin] + 1] if len(begin) else np.zeros(0, bool)
        begin, grams = begin[stay], grams[stay]
        last = begin + n - 1
        grams = shifted(grams, lengths[last] + 1) ^ spaced[last]
        yield grams, np.searchsorted(begin, first)


def _features(column: pa.Array, width: int, buckets: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each block of texts: their numbers of words, and for each length of n-grams the buckets and the first feature of each text."""
    data, offsets = text_buffer(column)
    for i, j in blocks(offsets, 1 << 20):
        part = LOWERED[data[offsets[i] : offsets[j]]]
        words = Words(part, offsets[i : j + 1] - offsets[i], WORD_BYTES, hashed=False)
        crcs = word_crcs(part, words.starts, words.ends)
        grams = gram_crcs(crcs, words.ends - words.starts, words.first, width)
        yield np.diff(words.first), [((g % np.uint32(buckets)).astype(np.int64), first) for g, first in grams]


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, grams in _features(batch.column(0), width, buckets):
                for found, _ in grams:
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    sums = map_arrow(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's smoothed share in the target over that in the documents, floored."""
    b, s, t = len(documents), float(documents.sum()), float(target.sum())
    top, bottom = (target.astype(float) + 1) * (s + b), (documents.astype(float) + 1) * (t + b)
    return np.array([math.floor(1000 * math.log(x / y)) for x, y in zip(top.tolist(), bottom.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, features, weight = [], [], []
            for n, grams in _features(batch.column(1), width, len(gain)):
                words.append(n)
                features.append(sum(np.diff(first) for _, first in grams))
                own = np.zeros(len(n), np.int64)
                for found, first in grams:
                    sums = np.append(0, np.cumsum(gain[found]))
                    own += sums[first[1:]] - sums[first[:-1]]
                weight.append(own)
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (words, features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):  # noqa: ANN201
    """1000 times a standard Gumbel variate, floored, from the doc_id and the seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Every document with n_features, weight, score, and its rank if it is drawn: of those with ``least_words`` words, ``percent`` in a hundred."""
    if width < 1 or not 0 <= percent <= 100:
        raise ValueError("width >= 1 and a percentage of 0 to 100 are needed")
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    scored = weighed(docs, gain, width).withColumn("score", F.col("weight") + noise(seed))
    rows = scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") < least_words).alias("short"), F.monotonically_increasing_id().alias("salt"))
    # Stored before the sort, as a sort by ranges reads its input twice.
    rows = Stored(rows)
    in_order = rows.df.orderBy("short", F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "salt")
    # The place in a partition is the lower 33 bits of the increasing id, the partition's number what is above.
    placed = Stored(in_order.select("doc_id", "n_features", "weight", "score", "short", F.monotonically_increasing_id().alias("id")))
    rows.drop()
    part = F.shiftrightunsigned("id", 33)
    sizes = placed.df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.when(~F.col("short"), 1).otherwise(0)).alias("fit")).sort("part").collect()  # a row per partition
    drawn, before, starts = sum(r["fit"] for r in sizes) * percent // 100, 0, []
    for r in sizes:
        starts.append((r["part"], before + 1))
        before += r["n"]
    starts = docs.sparkSession.createDataFrame(starts, "part long, start long")
    ranked = placed.df.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(~F.col("short") & (rank <= drawn), rank).alias("rank"))
