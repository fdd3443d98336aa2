"""Spelling variants: words of the whole corpus that one inserted, deleted or replaced character parts.

The vocabulary is joined with itself by tries.  Words are dealt to tries by the
place where two of them may differ: in one trie stand the words of n characters
(and of n + 1, their partners by an insertion) that agree before and behind a
window of places.  At first there are two windows, the halves of n + 1 places, so
a trie is named by a prefix of the words, or by a suffix.  A window with more than
``TRIE`` words is halved again, until it is a single place; there a trie holds the
words that differ in one or two given characters alone, which is few, whatever
the vocabulary.  So no task gathers more than that, and no pair is lost: two words
at distance one first differ at one place, and stand together in the trie of its window.

A trie is walked from its root with a set of active nodes: the nodes at distance
one of the node at hand (which itself is the only one at distance 0).  Of a child
by character c, active are: the node itself (its last character deleted), later
siblings (replaced), and what the node's active nodes have as children by c.
Insertions are the deletions of the other word.  Where a word ends, active nodes
that end words too are its near words.  Tries aren't built: a node is a range of
the sorted words and a depth, and a range of one word is looked up at once.

Each word's form is its near word of most occurrences, if they are enough; roots
follow forms to the last one by doubling, in a number of rounds that grows with the
logarithm of the longest path (whose counts grow by ``ratio`` with each step).

Defined results: a null text has no words; a null doc_id is written as nothing in
the key that alters runs; repeated rows count as often as they occur; an empty
table gives no words; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Stored, map_arrow

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words of a trie at most, unless its window is a single place.
TRIE = 20_000
#: Tries beyond TRIE up to which their names are broadcast (about 100 bytes each: 10 MB); beyond it they are joined.
BROADCAST_TRIES = 100_000
#: Rows of an Arrow batch that tasks pass on.
ROWS = 20_000


def words(docs: DataFrame, least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """(word, n): altered runs of letters of at least ``least`` characters that occur at least ``times`` times.

    Of runs whose key's CRC is a multiple of ``every``, one character goes. Each
    batch passes on its own counts, so a frequent word is a row of each batch at most.
    """
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode().translate(LOWERED).decode()
                key = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(run_of.findall(raw)).items():
                    h = zlib.crc32(run.encode(), key)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    total[run] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    counted = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def near_pairs(found: list[str], n: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Places of all pairs at distance one in the sorted distinct words that first differ in [lo, hi), one word of a pair having n characters.

    All words agree in their first lo characters.
    """
    known: dict[tuple[int, int], list[tuple[str, int, int]]] = {}

    def children(a: int, b: int, k: int) -> list[tuple[str, int, int]]:
        """The ranges of [a, b) by character k, without a word that ends there."""
        if (a, k) in known:
            return known[a, k]
        out, at = [], a + (len(found[a]) == k)
        while at < b:
            c = found[at][k]
            end = b if found[b - 1][k] == c else bisect_left(found, True, at + 1, b, key=lambda w: w[k] > c)
            out.append((c, at, end))
            at = end
        if len(out) > 1:  # a chain of single children may be very long
            known[a, k] = out
        return out

    def fits(i: int, j: int) -> bool:
        u, v = found[i], found[j]
        return min(len(u), len(v)) == n and u[:hi] != v[:hi]

    stack: list[tuple[int, int, int, list[tuple[int, int, int]]]] = [(0, len(found), lo, [])]
    while stack:
        a, b, k, active = stack.pop()
        word = found[a]
        if b - a == 1:
            rest = word[k:]
            for c, d, m in active:
                wanted = found[c][:m] + rest
                at = bisect_left(found, wanted, c, d) if d - c > 1 else c
                if at < d and found[at] == wanted and fits(a, at):
                    yield a, at
            continue
        below, wide = word[:k], []
        for c, d, m in active:
            if d - c == 1:  # a lone word has one partner here at most
                wanted = below + found[c][m:]
                at = bisect_left(found, wanted, a, b)
                if at < b and found[at] == wanted and fits(at, c):
                    yield at, c
            else:
                wide.append((c, d, m))
        if len(word) == k:
            for c, _, m in wide:
                if len(found[c]) == m and fits(a, c):
                    yield a, c
        if k >= hi and not wide:
            continue
        own = children(a, b, k)
        survive: dict[str, list[tuple[int, int, int]]] = {}
        for c, d, m in wide:
            for letter, e, f in children(c, d, m):
                if (e, m + 1) != (a, k):  # the node itself, by an earlier deletion in a run of equal letters
                    survive.setdefault(letter, []).append((e, f, m + 1))
        for i, (letter, c, d) in enumerate(own):
            new = survive.get(letter, [])
            if k < hi:
                new = [(a, b, k), *new, *[(e, f, k + 1) for _, e, f in own[i + 1 :]]]
            if new or (d - c > 1 and k + 1 < hi):
                stack.append((c, d, k + 1, new))


def _windows(vocabulary: DataFrame) -> DataFrame:
    """Each word in the two windows of its own length and, as a partner, of the length below."""
    size = F.length("word")
    each = vocabulary.select("word", "count", F.explode(F.array(size, size - 1)).alias("n"))
    half = ((F.col("n") + 1) / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("n") + 1).alias("hi")))
    return _keyed(each.select("word", "count", "n", F.explode(both).alias("w")).select("word", "count", "n", "w.lo", "w.hi"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The name of the trie: what a window's words share before and behind it (a word has no bar)."""
    return rows.withColumn("key", F.concat(F.expr("left(word, lo)"), F.lit("|"), F.expr("right(word, greatest(n - hi, 0))")))


TRIE_KEY = ["n", "lo", "hi", "key"]


def near(vocabulary: DataFrame, trie: int = TRIE) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of near words of (word, n), once each."""
    rows, held = _windows(vocabulary.withColumnRenamed("n", "count")), []
    while True:
        # A window of one place holds few words, whatever the vocabulary.
        large = Stored(rows.where("hi - lo > 1").groupBy(*TRIE_KEY).agg(F.count("*").alias("rows")).where(F.col("rows") > trie).drop("rows"))
        many = large.df.count()
        if not many:
            large.drop()
            break
        names = F.broadcast(large.df) if many <= BROADCAST_TRIES else large.df
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        split = rows.join(names, TRIE_KEY, "left_semi").select("word", "count", "n", F.explode(halves).alias("w")).select("word", "count", "n", "w.lo", "w.hi")
        new = Stored(rows.join(names, TRIE_KEY, "left_anti").unionByName(_keyed(split)))
        for done in (*held, large):
            done.drop()
        held, rows = [new], new.df

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []

        def of(name: tuple, found: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
            alone = len(found) < 2 or all(len(w) > name[0] for w in found)
            for i, j in () if alone else near_pairs(found, *name[:3]):
                yield found[i], counts[i], found[j], counts[j]

        def passed(pairs: Iterator[tuple[str, int, str, int]]) -> Iterator[pa.RecordBatch]:
            while True:
                out.extend(islice(pairs, ROWS - len(out)))
                if len(out) < ROWS:
                    return
                yield _pairs(out)
                out.clear()

        name, found, counts = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for key, word, count in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if key != name:
                    yield from passed(of(name, found, counts))
                    name, found, counts = key, [], []
                found.append(word)
                counts.append(count)
        yield from passed(of(name, found, counts))
        if out:
            yield _pairs(out)

    dealt = rows.select(*TRIE_KEY, "word", "count").repartition(*TRIE_KEY).sortWithinPartitions(*TRIE_KEY, "word")
    return map_arrow(dealt, join, "a string, a_n long, b string, b_n long")


def _pairs(rows: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    a, a_n, b, b_n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(a_n, pa.int64()), pa.array(b, pa.string()), pa.array(b_n, pa.int64())], ["a", "a_n", "b", "b_n"])


def variants(docs: DataFrame, least: int = 5, times: int = 3, every: int = 97, ratio: int = 2, trie: int = TRIE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocabulary = Stored(words(docs, least, times, every))
    pairs = near(vocabulary.df, trie)
    sides = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("best")),
                    F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("best")))
    best = pairs.select(F.explode(sides).alias("s")).groupBy("s.word").agg(F.count("*").alias("n_near"), F.min("s.best").alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    forms = Stored(vocabulary.df.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    vocabulary.drop()
    now = Stored(forms.df.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.df.where("moved").isEmpty():
        after = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = Stored(now.df.drop("moved").join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")))
        now.drop()
        now = new
    roots = now.df.select("word", "root")
    return forms.df.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
