"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised once.  A document of n ids is cut at multiples of the
sequence length, so all pieces but its last fill a sequence each.  Pieces are
dealt at random (by a hash of document, place, task and, of equal ones in a task,
their number) into groups of bounded size;
in a group they are taken by falling length, and each goes to the first
sequence with enough room.  The tournament tree holds at every node the greatest
room below it, so the first fit is found by one walk down.

A group is independent of all others and bounded in size, so the packing shuffles
small rows alone (no text, no ids) and has no state between groups.

Defined results: a null text is empty and still has its end id; repeated rows
are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Bytes of text whose pieces form one group, about.
GROUP_BYTES = 4 << 20
#: Words whose ids a task remembers.
REMEMBER = 250_000
#: Texts of these characters alone are split here; all others go through the tokenizer's own normaliser.
PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa0-\u012f\u0131-\u017f]")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-zA-Z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level tokenizers write for bytes: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Ids of texts by a word-level tokenizer file; ids of words are remembered.

    The tokenizer encodes each word by itself, so encoding distinct words once
    and joining their ids gives the same ids as encoding whole texts; texts that
    hold an added token go to the tokenizer as a whole.
    """

    _made: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One for each process, as tasks follow one another."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Lower-cased texts of added tokens, which the tokenizer takes out of a text before it splits words.
        self.added = [a.content.lower() for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)
        self.starts = np.zeros(REMEMBER + 1, np.int64)

    def _learn(self, words: set[str]) -> None:
        at, model, flat, ends = len(self.index), self.tokenizer.model, [], []
        start = int(self.starts[at])
        for word in words:
            flat += [t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]
            ends.append(start + len(flat))
        self.index.update(zip(words, range(at, at + len(words)), strict=True))
        self.starts[at + 1 : at + 1 + len(ends)] = ends
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[start : ends[-1]] = flat

    def encode(self, text: str) -> np.ndarray:
        low = text.lower()
        if (CONTROL if text.isascii() else PLAIN).search(text) or any(a in low for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        words = WORD.findall(low)
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > REMEMBER:
            self._clear()
            new = set(words)
            if len(new) > REMEMBER:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        starts, counts = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(starts - (ends - counts), counts)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """The pieces of each document: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(tokens.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                doc = doc.as_py()
                rows += [(doc, i, min(size, len(ids) - i), zlib.crc32(ids[i : i + size].tobytes()), len(ids)) for i in range(0, len(ids), size)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


class Tournament:
    """Room of bins 0, 1, ... of equal size; ``place`` puts an item into the first bin with enough room."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        found = node - self.leaves
        room[node] -= length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items of equal length keep their order."""
    where, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    # First fit never leaves two bins at half or less, so this many are enough.
    tree, used = Tournament(2 * int(-(-lengths.sum() // size)) + 1, size), {}
    for i in np.argsort(-lengths, kind="stable"):
        b = tree.place(int(lengths[i]))
        where[i], at[i] = b, used.get(b, 0)
        used[b] = at[i] + lengths[i]
    return where, at


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, seed: int = 0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every piece with its sequence and its offset there (columns of PIECES, sequence_id, offset)."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    names = [x.split()[0] for x in PIECES.split(", ")]
    # Equal pieces of a task's documents are numbered, so that repeated rows spread over all groups.
    numbered = pieces(docs, tokenizer, size, end_id).withColumn("task", F.spark_partition_id()).groupBy(*names, "task").agg(F.count("*").alias("m"))
    numbered = numbered.select(*names, "task", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy"))
    dealt = numbered.select(*names, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "task", "copy", F.lit(seed)), F.lit(groups)).alias("grp"))

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        bins, at = first_fit_decreasing(part["length"].to_numpy(), size)
        ids = part["grp"].to_numpy() * (1 << 32) + bins
        return part.drop_columns(["grp"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(at))

    return dealt.groupBy("grp").applyInArrow(fill, PIECES + ", sequence_id long, offset long")
