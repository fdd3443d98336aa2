"""Edit-aware token counts with a segment tree of pre-tokens per document.

A byte-pair tokenizer cuts a text into pre-tokens by a regex and encodes each by
itself, so a text's count is the sum over its pre-tokens.  ``Counted`` keeps the
pre-tokens in leaves of a segment tree whose nodes hold characters and tokens of
what is below them.  After an edit only a region is cut and encoded again: it
begins at the first pre-token that may have looked at the edited place (the
pattern looks at most two characters past a match) and ends where the new cut
meets an old boundary behind the edit; from there both cuts agree, since a match
depends on what follows alone.  Then sums change on the paths of the leaves
involved.

Defined results: a null text is empty; edits beyond the end are clipped; rows
repeat as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Pre-tokens in a leaf at first.
LEAF = 64
#: Characters past the end of a match that the pattern may look at.
LOOK = 2
REMEMBER = 400_000


class Tokenizer:
    """Pre-token pattern and counts of a byte-pair vocabulary given as a file of base64 tokens and ranks."""

    _made: dict[tuple[str, str], Tokenizer] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Tokenizer:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > REMEMBER:
                known.clear()
                new = set(words)
            encode = self.encoding.encode_ordinary
            for w in new:
                known[w] = len(encode(w))
        return list(map(known.__getitem__, words))


class Counted:
    """A text with its token count under edits."""

    def __init__(self, text: str, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.cut_again = 0  # characters cut and encoded again by edits so far
        self._build(tokenizer.pattern.findall(text))

    def _build(self, words: list[str]) -> None:
        counts = np.array(self.tokenizer.counts(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.arange(0, max(1, len(words)), LEAF)
        self.leaves = [words[i : i + LEAF] for i in first.tolist()]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.tokens, self.chars = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        if words:
            self.tokens[self.width : self.width + len(first)] = np.add.reduceat(counts, first)
            self.chars[self.width : self.width + len(first)] = np.add.reduceat(sizes, first)
        for sums in (self.tokens, self.chars):
            level = self.width
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last leaf for the end) and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        leaf = min(node - self.width, len(self.leaves) - 1)
        return leaf, before if leaf == node - self.width else self._before(leaf)

    def _before(self, leaf: int) -> int:
        node, total = leaf + self.width, 0
        while node > 1:
            total += int(self.chars[node - 1]) if node % 2 else 0
            node //= 2
        return total

    def _set(self, leaf: int, words: list[str]) -> None:
        self.leaves[leaf] = words
        node = leaf + self.width
        self.tokens[node], self.chars[node] = sum(self.tokenizer.counts(words)), sum(map(len, words))
        while node > 1:
            node //= 2
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start`` on."""
        start = min(max(0, start), self.n_chars)
        end = min(start + max(0, removed), self.n_chars)
        # The last boundary that no change can reach.
        leaf, at = self._leaf_at(max(0, start - LOOK))
        words, k = self.leaves[leaf], 0
        while k < len(words) and at + len(words[k]) + LOOK <= start:
            at += len(words[k])
            k += 1
        head = words[:k]
        # Old pre-tokens from there on, up to the leaf behind the edit, and twice as many leaves where the cuts don't meet by then.
        last = max(leaf, self._leaf_at(min(end + LOOK + 1, self.n_chars))[0])
        while True:
            old = [*words[k:], *(w for part in self.leaves[leaf + 1 : last + 1] for w in part)]
            region = "".join(old)
            new = region[: start - at] + inserted + region[end - at :]
            shift = len(inserted) - (end - start)
            bounds, place = {}, at
            for i, w in enumerate(old):
                if place >= end:
                    bounds[place + shift] = i
                place += len(w)
            final = last + 1 == len(self.leaves)
            fresh, pos, meet = [], 0, None
            while pos < len(new):
                if at + pos >= start + len(inserted) and at + pos in bounds:
                    meet = bounds[at + pos]
                    break
                m = self.tokenizer.pattern.match(new, pos)
                if not final and m.end() + LOOK > len(new):
                    break
                fresh.append(m.group())
                pos = m.end()
            else:
                meet = len(old) if final else None
            if meet is not None:
                break
            last = min(len(self.leaves) - 1, last + max(1, last - leaf))
        self.cut_again += pos
        done = head + fresh + old[meet:]
        for i in range(leaf + 1, last + 1):
            if self.leaves[i]:
                self._set(i, [])
        self._set(leaf, done)
        if len(done) > 16 * LEAF:
            self._build([w for part in self.leaves for w in part])


def edits_of(n: int) -> list[tuple[int, int, str]]:
    """The edits that the report applies to a text of n characters: a cut, an insertion and a replacement at the end."""
    cut = n // 20
    return [(n // 3, cut, ""), (n // 2, 0, " an inserted sentence, 2024."), (max(0, n - cut - cut), cut, "it's ")]


SCHEMA = "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, cut_again long, edited_sha256 string"


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts before and after ``edits_of`` for each row of docs (doc_id, text); columns of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.of(path, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(*batch.columns, strict=True):
                counted = Counted(text.as_py() or "", tokenizer)
                n, before = counted.n_chars, counted.n_tokens
                for e in edits_of(n):
                    counted.edit(*e)
                rows.append((doc.as_py(), n, before, counted.n_chars, counted.n_tokens, counted.cut_again, hashlib.sha256(counted.text().encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, [pa.int64()] * 6 + [pa.string()])), [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
