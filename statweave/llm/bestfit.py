"""Sequence packing by vector best-fit: every sequence has several capacities.

A sequence holds at most so many tokens, so many documents (pieces), and so much
attention cost (the sum of its pieces' squared lengths).  Documents are tokenised
once; only those longer than a sequence are cut, at multiples of its length.
Pieces are dealt by hash to groups of bounded size; in a group they are taken by
falling length, and of all sequences that hold the piece under every constraint
it goes to the one that a rule prefers:

* ``norm``: the least weighted square norm of what is left after it;
* ``dot``: the greatest weighted dot product of what is left and what it takes.

All parts are divided by their capacities first. With the weights of ``WEIGHTS``
tokens decide and the other two break ties, which gives the fewest sequences where
tokens alone run short.

Groups are independent and bounded in bytes of text and in documents, so small
rows alone are shuffled (no text, no ids). What stays unfilled at the end of each
group is packed once more together: sequences with more than ``LOOSE`` of their
tokens free give their pieces back, and these are dealt to groups again.

Defined results: a null text is empty and still has its end id; repeated rows are
packed as often as they occur; an empty table gives no pieces; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored
from .packing import PIECES, pieces

#: Bytes of a group, about: of its text, and 64 for each document besides.
GROUP_BYTES = 32 << 20
#: Pieces of a group in the second round, about.
GROUP_PIECES = 16_384
#: Share of a sequence's tokens that is free, from which on its pieces are packed again.
LOOSE = 1 / 256
#: Weights of tokens, documents and attention cost.
WEIGHTS = (1.0, 1e-9, 1e-9)
RULES = ("norm", "dot")


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most; None: no limit but the tokens'."""

    tokens: int
    documents: int | None = None
    attention: int | None = None

    def limits(self) -> np.ndarray:
        n = self.tokens
        return np.array([n, min(n, self.documents or n), min(n * n, self.attention or n * n)], np.float64)

    def piece(self) -> int:
        """The longest piece that a sequence holds under every constraint."""
        limits = self.limits()
        if limits.min() < 1:
            raise ValueError("capacities must be at least 1")
        return int(min(limits[0], math.isqrt(int(limits[2]))))


def vector_best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken by falling length (equal ones in order); of equally good bins the oldest."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")
    limits, n = capacity.limits(), len(lengths)
    where, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    whole = int((lengths == limits[0]).sum())  # these fill a bin each
    where[order[:whole]] = np.arange(whole)
    least, made = float(lengths.min(initial=1)), whole
    w = np.asarray(weights, np.float64) / limits**2
    room, name = np.zeros((3, 64)), np.zeros(64, np.int64)  # what is left of open bins, a column each
    m = 0
    for i in order[whole:].tolist():
        size = float(lengths[i])
        item = np.array([size, 1.0, size * size])
        left = room[:, :m] - item[:, None]
        fits = np.flatnonzero(left.min(0) >= 0) if m else left[0]
        if len(fits):
            rest = left[:, fits]
            value = w @ (rest * rest) if rule == "norm" else -((w * item) @ room[:, fits])
            b = int(fits[value.argmin()])
        else:
            if m == room.shape[1]:
                shut = (room[0, :m] < least) | (room[1, :m] < 1) | (room[2, :m] < least * least)
                keep = np.flatnonzero(~shut)
                wide = max(64, 2 * len(keep))
                room, name = np.hstack([room[:, keep], np.zeros((3, wide - len(keep)))]), np.append(name[keep], np.zeros(wide - len(keep), np.int64))
                m = len(keep)
            b = m
            room[:, b], name[b] = limits, made
            m, made = m + 1, made + 1
        where[i], at[i] = name[b], limits[0] - room[0, b]
        room[:, b] -= item
    return where, at


NAMES = [x.split()[0] for x in PIECES.split(", ")]
OUT = PIECES + ", sequence_id long, offset long"


def _filled(dealt: DataFrame, capacity: Capacity, weights: tuple[float, float, float], rule: str, first: int) -> DataFrame:
    """Pieces with a group ``grp`` put into sequences; ``first`` sets the sequences of this round apart from others'."""

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        bins, at = vector_best_fit(part["length"].to_numpy(), capacity, weights, rule)
        ids = first + part["grp"].to_numpy() * (1 << 32) + bins
        return part.select(NAMES).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(at))

    return dealt.select(*NAMES, "grp").groupBy("grp").applyInArrow(fill, OUT)


def pack(
    docs: DataFrame, tokenizer: str, capacity: Capacity, end_id: int = 1, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", seed: int = 0,
    group_bytes: int = GROUP_BYTES, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Every piece with its number in the document, its sequence and its offset there."""
    size = capacity.piece()
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    # Equal pieces of a task's documents are numbered, so that repeated rows spread over all groups.
    numbered = pieces(docs, tokenizer, size, end_id).withColumn("task", F.spark_partition_id()).groupBy(*NAMES, "task").agg(F.count("*").alias("m"))
    numbered = numbered.select(*NAMES, "task", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy"))
    dealt = numbered.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "task", "copy", F.lit(seed)), F.lit(groups)))
    one = Stored(_filled(dealt, capacity, weights, rule, 0))
    # Whole sequences come from tokens alone; a group's free tokens are what its sequences lack.
    used = one.df.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("parts"))
    loose = Stored(used.where(F.col("used") < capacity.tokens * (1 - LOOSE)))
    many = loose.df.agg(F.sum("parts")).first()[0] or 0
    if groups == 1 or not many:
        loose.drop()
        return _numbered(one.df, size)
    again = max(1, -(-many // group_pieces))
    rest = one.df.join(loose.df.select("sequence_id"), "sequence_id", "left_semi")
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("sequence_id", F.lit(seed + 1)), F.lit(again)))
    two = _filled(rest, capacity, weights, rule, 1 << 62)
    return _numbered(one.df.join(loose.df.select("sequence_id"), "sequence_id", "left_anti").unionByName(two), size)


def _numbered(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("piece", F.floor(F.col("start") / size).cast("int")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
