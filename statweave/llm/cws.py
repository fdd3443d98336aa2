"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words (digits, letters and non-ASCII characters,
A-Z lower-cased) with their counts.  For each of ``samples`` independent draws a
word of weight w gets, from hashes of word and draw alone, r and c from
Gamma(2, 1) and b from [0, 1), and

    t = floor(ln w / r + b),   ln a = ln c - r (t + 1 - b);

the draw's sample is (word, t) of the least a.  Two texts agree in a draw with
probability equal to their generalised Jaccard similarity (sum of least weights
over sum of greatest).  A fingerprint holds 16 bits of each sample, so unlike
samples agree by chance once in 65536.

``edited_pairs`` also needs each document's successor by falling doc_id.  The order
(doc_id, hash of the text, task) is cut into ranges, so that neither one doc_id nor
one text that many rows have makes a large range; each range gets, besides its own
documents, a copy of the first document of the next range that has any, and so
knows all its successors after one shuffle.

Defined results: a null text is empty; an empty set has its own fingerprint,
which is like itself alone; rows with equal doc_id stand in the order of their
texts' hashes, so that equal rows follow one another; rows with null doc_id come
last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, map_arrow, mix, partitions
from .licenses import WORD_BYTES

SAMPLES = 64
#: Text per range of ids, about.
RANGE_BYTES = 4 << 20
#: Ranges at most (their cuts go to all tasks, 3 MB); beyond 400 GB of text ranges grow, as sorts that spill.
RANGES = 100_000
#: Documents that choose a cut, about.
CHOOSERS = 20


def _gamma(h: np.ndarray) -> np.ndarray:
    """A Gamma(2, 1) number from each hash: -ln(u v), u and v in (0, 1] from its halves."""
    u = (h >> np.uint64(32)).astype(np.float32)
    v = h.view(np.uint32)[:, ::2].astype(np.float32)
    u += np.float32(1)
    v += np.float32(1)
    u *= v
    u *= np.float32(2.0**-64)
    return -np.log(u, out=u)


def draws(words: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """ln a (float32) and the sample's 16 bits for each word hash, with its weight, and draw."""
    salt = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (words[:, None] ^ salt[None, :]) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    r = _gamma(h)
    np.maximum(r, np.float32(1e-6), out=r)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    ln_c = np.log(_gamma(h) + np.float32(1e-30))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    b = (h >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
    t = np.log(weights.astype(np.float32))[:, None] / r
    t += b
    np.floor(t, out=t)
    h += t.astype(np.uint64)
    h *= np.uint64(0x9FB21C651E98DF25)
    bits = (h >> np.uint64(48)).astype(np.uint16)
    return ln_c - r * (t + np.float32(1) - b), bits


def signatures(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES, limit: int = 2 << 20) -> np.ndarray:
    """Samples (texts x samples, uint16) of a batch of texts; ``limit``: bytes of texts that are taken together, or one text; draws are held in parts of bounded size."""
    out = np.empty((len(offsets) - 1, samples), np.uint16)
    for i, j in blocks(offsets, limit):
        own = offsets[i : j + 1] - offsets[i]
        words = Words(data[offsets[i] : offsets[j]], own, WORD_BYTES)
        text = np.repeat(np.arange(j - i), np.diff(words.first))
        order = np.lexsort((words.hashes, text))
        h, text = words.hashes[order], text[order]
        new = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
        weights = np.diff(np.append(new, len(h)))
        h, text = h[new], text[new]
        part = _least(h, weights, np.searchsorted(text, np.arange(j - i + 1)), samples)
        out[i:j] = part
    return out


def _least(words: np.ndarray, weights: np.ndarray, first: np.ndarray, samples: int, limit: int = 1 << 14) -> np.ndarray:
    """The samples of each text, of which ``words[first[i]:first[i + 1]]`` are its own."""
    texts = len(first) - 1
    best = np.full((texts, samples), np.iinfo(np.uint64).max, np.uint64)
    # What many texts of the batch share is drawn once.
    pairs, at = np.unique(words + mix(weights.astype(np.uint64)), return_inverse=True)
    some = np.zeros(len(pairs), np.int64)
    some[at] = np.arange(len(at))
    by_pair = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[by_pair], np.arange(0, len(pairs) + limit, limit))
    owner = np.repeat(np.arange(texts), np.diff(first))
    for k, s in enumerate(range(0, len(pairs), limit)):  # a part of the draws at a time, and of each text's least ones so far
        ln_a, bits = draws(words[some[s : s + limit]], weights[some[s : s + limit]], samples)
        raw = ln_a.view(np.int32)
        sortable = np.where(raw < 0, ~raw.view(np.uint32), raw.view(np.uint32) | np.uint32(1 << 31))
        keys = sortable.astype(np.uint64) << np.uint64(32) | bits
        held = np.sort(by_pair[ends[k] : ends[k + 1]])  # by text again
        for e in range(0, len(held), limit):
            own = held[e : e + limit]
            text = owner[own]
            new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            best[text[new]] = np.minimum(best[text[new]], np.minimum.reduceat(keys[at[own] - s], new, axis=0))
    return np.where((np.diff(first) > 0)[:, None], best & np.uint64(0xFFFF), np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """Share of equal samples of each row; an empty text is like empty texts alone."""
    same = (a == b).mean(1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), same)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: A document's place in the order.
PLACE = "struct<no_id: boolean, id: bigint, hash: bigint, task: int>"


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with ``place``, ``range`` and ``own``, and copies (``own`` false) of the first documents of other ranges; and the number of ranges."""
    spark = docs.sparkSession
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    place = F.struct(F.isnull("doc_id").alias("no_id"), F.bitwise_not("doc_id").alias("id"), "hash", F.spark_partition_id().alias("task")).cast(PLACE)
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = min(RANGES, max(1, (size or 0) // RANGE_BYTES))
    step = max(1, n // (CHOOSERS * parts))
    # A hash chooses the documents at which cuts may be; every row belongs to a range, whatever it chooses.
    chosen = hashed.where(F.pmod(F.xxhash64(F.lit(3), "hash", "doc_id", F.spark_partition_id()), F.lit(step)) == 0).select(place.alias("place")).distinct() if parts > 1 else None
    found = sorted((tuple(r["place"]) for r in chosen.collect()), key=_order) if chosen else []
    cuts = sorted({found[k * len(found) // parts] for k in range(1, parts)} if found else set(), key=_order)
    placed = hashed.withColumn("place", place).withColumn("range", _below(spark, cuts)).drop("hash")
    heads = {r["range"]: tuple(r["place"]) for r in placed.groupBy("range").agg(F.min("place").alias("place")).collect()}
    after, nxt = [], heads[min(heads)] if heads else None
    for r in range(len(cuts), -1, -1):  # every range gets a copy, also one without documents
        after.append((r, nxt))
        nxt = heads.get(r, nxt)
    wanted = spark.createDataFrame([(r, *x[:3]) for r, x in after if x], "to int, no_id boolean, id bigint, hash bigint")
    # Which of several equal rows comes first makes no difference.
    same = [F.col("place")[c].eqNullSafe(F.col(c)) for c in ("no_id", "id", "hash")]
    copies = placed.drop("range").join(F.broadcast(wanted), same[0] & same[1] & same[2]).groupBy("to").agg(F.min("place").alias("place"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    copies = copies.select("doc_id", "text", "place", F.col("to").alias("range"), F.lit(False).alias("own"))
    return placed.select("doc_id", "text", "place", "range", F.lit(True).alias("own")).union(copies), len(cuts) + 1


def _order(place: tuple) -> tuple:
    return tuple((x is not None, x) for x in place)  # nulls first, as Spark has it


def _below(spark: SparkSession, cuts: list[tuple]) -> Column:
    """The number of cuts at or below a document's place, by halving for a batch at a time."""
    columns = [np.array([c[k] or 0 for c in cuts], np.int64) for k in range(4)]
    shared = spark.sparkContext.broadcast(columns)

    @F.pandas_udf("int")
    def number(no_id: pd.Series, ident: pd.Series, hashed: pd.Series, task: pd.Series) -> pd.Series:
        cut, own = shared.value, [x.to_numpy().astype(np.int64) for x in (no_id, ident, hashed, task)]
        lo, hi = np.zeros(len(no_id), np.int64), np.full(len(no_id), len(cut[0]))
        while (some := np.flatnonzero(lo < hi)).size:
            mid = (lo[some] + hi[some]) // 2
            under = np.ones(len(some), bool)  # cut <= place, from the last part to the first
            for c, x in zip(reversed(cut), reversed(own), strict=True):
                under = (c[mid] < x[some]) | (c[mid] == x[some]) & under
            lo[some[under]], hi[some[~under]] = mid[under] + 1, mid[~under]
        return pd.Series(lo.astype(np.int32))

    return number(F.col("place.no_id"), F.coalesce("place.id", F.lit(0)), "place.hash", "place.task")


def edited_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Columns of SCHEMA for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged, ranges = _ranges(docs)
    parts = ranged.repartition(max(ranges, partitions(docs.sparkSession, 0)), "range").sortWithinPartitions("range", F.desc("own"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                weight += len(row[1])
                if weight > 1 << 19 and len(held) > 1:
                    yield _report(held, samples)
                    held, weight = held[-1:], len(row[1])
        yield _report(held, samples)

    return map_arrow(parts.select("doc_id", "text", "range", "own"), run, SCHEMA)


def _report(rows: list[tuple], samples: int) -> pa.RecordBatch:
    """What can be said of rows that their successor follows."""
    keep = [k for k in range(len(rows) - 1) if rows[k][3] and rows[k][2] == rows[k + 1][2]]
    texts = [r[1] for r in rows]
    edited = []
    for k in keep:
        n = len(texts[k])
        m = n // 3
        edited.append(texts[k][: n - m] + texts[k + 1][:m])
    raw, edited_raw = [t.encode() for t in texts], [t.encode() for t in edited]
    both = raw + edited_raw
    offsets = np.cumsum([0, *map(len, both)])
    s = signatures(np.frombuffer(b"".join(both), np.uint8), offsets, samples)
    empty = (s == 0xFFFF).all(1)
    a, b, c = np.array(keep, int), len(rows) + np.arange(len(keep)), np.array(keep, int) + 1
    columns = [
        pa.array([rows[k][0] for k in keep], pa.int64()), pa.array([len(texts[k]) for k in keep], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited_raw], pa.string()),
        pa.array([s[k].tobytes().hex() for k in a], pa.string()), pa.array([s[k].tobytes().hex() for k in b], pa.string()),
        pa.array(likeness(s[a], s[b], empty[a], empty[b]), pa.float64()), pa.array(likeness(s[a], s[c], empty[a], empty[c]), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])
