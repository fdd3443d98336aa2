"""Suffix-array deduplication to a fixed depth.

Every byte that lies in a window of ``size`` bytes which also starts anywhere
else is removed.  Windows of one text and of others are equal exactly when the
suffixes that start there agree to depth ``size``, so suffixes are ordered only
that far, by most-significant-digit passes, and groups with one member drop out
after each pass.

1. Dealing: each window has an *anchor*, the piece of ``GRAM`` bytes with the
   least hash in it (the first of equals), pieces in common use last.  Which are in common
   use is told by a count of all pieces in ``BUCKETS`` classes of their hashes; a
   line that many texts share thus becomes the anchor of nothing but windows
   full of such pieces, and not of all the different texts around it.  Equal windows have equal anchors at
   equal places, so windows with different anchors never meet.  Neighbouring
   windows mostly share their anchor, and a text gives one row per stretch of
   windows, about one in 185 bytes, with a 128-bit name of all that they cover.
2. Anchors that occur once drop out, by a count that combines before the shuffle.
   Stretches with equal anchor and equal content are repeated as a whole.  One of
   each content stays as a partner for others.
3. Where an anchor has several contents, a task orders the suffixes that begin
   at the anchors: radix passes over the texts' own bytes, eight at a time from
   the most significant on, and likewise over what stands before the anchors,
   backwards.  Where two suffixes part is their common depth, so a window that
   begins i bytes before its anchor is in an equal group with those that agree
   to depth ``size - i`` after the anchor and to depth i before it: for each i
   these groups are runs of the two orders.  No hash decides here.
4. An anchor with more than ``GROUP`` contents isn't gathered in a task.  Its
   windows are taken in chunks of neighbouring places; the bytes that all windows
   of a chunk hold are a digit (named by 128 bits) by which chunks are grouped
   with an aggregate.  Lone chunks drop out, groups that agree in all their
   bytes are done, and the others are cut into smaller chunks, down to windows.

Windows may also be counted in words, which are then the letters of the suffixes:
a window of ``words`` words that starts anywhere else is found as well.  Words
are runs without white space, compared without case (A-Z) and without ASCII
punctuation around them; such a window is the bytes from the first word's first to
the last word's last.  Both kinds of windows take the same steps together.

Defined results: a null text is empty; texts shorter than ``size`` lose nothing;
repeated rows are copies of each other and lose all their windows; coverage
belongs to a text's content (named by 128 bits), so doc_id may be
null or repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, Words, blocks, byte_table, hot_join, map_arrow, mix, packed, partitions, span_hashes, text_buffer, unpacked

GRAM = 32
#: The anchor's length where windows are counted in words, and bytes that words don't hold or aren't told apart by.
GRAM_WORDS = 8
NOT_SPACE = byte_table(np.r_[0:9, 14:32, 33:256])
INNER = byte_table(np.r_[48:58, 65:91, 97:123, 128:256])
#: Classes of pieces by their hash, and how many times the average a class has to hold to be in common use.
BUCKETS = 1 << 20
COMMON = 4
#: Contents of an anchor that one task puts in order, at most (about 600 bytes each).
GROUP = 1_000
#: Neighbouring windows of larger anchors that are grouped together, pass by pass.
CHUNKS = (64, 8, 1)
#: Bytes whose windows are worked on at a time; bytes that are gathered before stretches are ordered, and stretches that are ordered at a time, about.
STRETCH = 1 << 19
GATHERED = 2 << 20
ROWS = 3000
#: Greatest number of text keys that are broadcast to pick texts (some 80 bytes each in memory: 40 MB); beyond it texts are joined.
BROADCAST_KEYS = 500_000
#: What names a text: two hashes with different seeds.
KEY = ["th", "tl"]
#: Longer than any text.
FAR = 1 << 40


def big_endian(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number, the first being the most significant; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    u = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    h = u[: len(u) - GRAM + 8].copy()
    for k in range(8, GRAM, 8):
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(31)
        h += u[k : k + len(h)]
    return mix(h)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts without punctuation around them: starts, ends, and the first word of each text (and one more entry)."""
    words, inner = Words(data, offsets, NOT_SPACE, hashed=False), np.flatnonzero(INNER[data])
    a, b = np.searchsorted(inner, words.starts), np.searchsorted(inner, words.ends)
    some = a < b  # a word of nothing but punctuation stays as it is
    starts, ends = words.starts.copy(), words.ends.copy()
    starts[some], ends[some] = inner[a[some]], inner[b[some] - 1] + 1
    return starts, ends, words.first


def word_gram_hashes(letters: np.ndarray) -> np.ndarray:
    h, width = letters, 1
    while width < GRAM_WORDS:
        h, width = mix(h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + h[width:]), width * 2
    return h


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    now = 1
    while now * 2 <= width:
        values, now = np.minimum(values[:-now], values[now:]), now * 2
    return np.minimum(values[: len(values) - (width - now)], values[width - now :]) if now < width else values


def stretches(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, gram: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor, of texts [starts, ends) whose pieces of ``gram`` letters have hashes ``h``: text, first and last window, place of the anchor, hash of the anchor.

    ``common``: flags of BUCKETS classes of pieces, which come after all others.
    """
    place = np.uint64((1 << 24) - 1)
    order = h >> np.uint64(1) | common[h & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(63)
    least = least_in_windows((order & ~place) | np.arange(len(h), dtype=np.uint64), size - gram + 1) & place
    long = np.flatnonzero(ends - starts >= size)
    counts = (ends - starts)[long] - size + 1
    text = np.repeat(long, counts)
    p = np.arange(len(text)) + np.repeat(starts[long] - (np.cumsum(counts) - counts), counts)
    a = least[p].astype(np.int64)
    new = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(p))[: len(new)] - 1
    return text[new], p[new], p[last], a[new], h[a[new]]


ANCHORS = "anchor long, c1 long, c2 long, th long, tl long, start int, end int, at int"


def common_pieces(texts: DataFrame, words: int | None, group: int) -> np.ndarray:
    """Flags of the classes in common use (rows: pieces of bytes, pieces of words), from a count of all pieces; they decide cost, never results.

    A task passes on the classes that stand out among its own, and its number of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in blocks(offsets, STRETCH):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(part) >= GRAM:
                    np.add.at(total[0], (gram_hashes(part) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                if words is not None:
                    starts, ends, _ = word_places(part, own)
                    if len(starts) >= GRAM_WORDS:
                        np.add.at(total[1], (word_gram_hashes(span_hashes(part, starts, ends)) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        many = total.sum(1)
        met = np.flatnonzero(total > (2 * many / BUCKETS + 8)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, [-1, -2])), pa.array(np.append(total.ravel()[met], many))], ["class", "n"])

    held = Stored(map_arrow(texts.select("text"), run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")))
    sums = held.df
    mean = {r["class"]: r["n"] / BUCKETS for r in sums.where("class < 0").collect()}  # two rows
    least = [max(group, COMMON * mean.get(-1 - kind, 0)) for kind in (0, 1)]
    often = sums.where((F.col("class") >= 0) & (F.col("n") > F.when(F.col("class") < BUCKETS, least[0]).otherwise(least[1]))).select("class").toArrow()
    out = np.zeros(2 * BUCKETS, bool)  # of which a quarter can be in common use at most
    out[often["class"].to_numpy()] = True
    held.drop()
    return out.reshape(2, BUCKETS)


def _anchors(texts: DataFrame, size: int, words: int | None, common: np.ndarray) -> DataFrame:
    """A row per stretch: anchor (its lowest bit tells word windows from others), the content's name, the text's key, the bytes that the windows cover, and the letters before the anchor."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def rows(key: list[np.ndarray], text: np.ndarray, raw: bytes, width: int, found: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray, kind: int) -> pa.RecordBatch:
        _, lo, hi, at, anchor = found
        spans = zip((lo * width).tolist(), ((hi + (words if kind else size)) * width).tolist(), (at - lo).tolist(), strict=True)
        names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[x:y], z) for x, y, z in spans), "<i8").reshape(-1, 2)
        anchor = (anchor & ~np.uint64(1) | np.uint64(kind)).view(np.int64)
        columns = [anchor, names[:, 0], names[:, 1], *(k[text] for k in key), *(c.astype(np.int32) for c in (start, end, at - lo))]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [x.split()[0] for x in ANCHORS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            data, offsets = text_buffer(batch.column(2))
            for i, j in blocks(offsets, STRETCH):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                alone = j == i + 1  # a long text comes alone and in parts that overlap by a window
                for s in range(0, max(1, len(part) - size + 1), STRETCH) if alone else [0]:
                    piece = part[s : s + STRETCH + size - 1] if alone else part
                    if len(piece) >= size:
                        a, b = (np.array([0]), np.array([len(piece)])) if alone else (own[:-1], own[1:])
                        found = stretches(gram_hashes(piece), a, b, size, GRAM, shared.value[0])
                        base = s - own[found[0]]
                        yield rows(key, i + found[0], piece.tobytes(), 1, found, found[1] + base, found[2] + size + base, 0)
                if words is None:
                    continue
                starts, ends, first = word_places(part, own)
                letters = span_hashes(part, starts, ends)
                for s in range(0, max(1, len(letters) - words + 1), STRETCH) if alone else [0]:
                    piece = letters[s : s + STRETCH + words - 1] if alone else letters
                    if len(piece) >= words:
                        a, b = (np.array([0]), np.array([len(piece)])) if alone else (first[:-1], first[1:])
                        found = stretches(word_gram_hashes(piece), a, b, words, GRAM_WORDS, shared.value[1])
                        base = own[found[0]]
                        yield rows(key, i + found[0], piece.tobytes(), 8, found, starts[s + found[1]] - base, ends[s + found[2] + words - 1] - base, 1)

    return map_arrow(texts.select(*KEY, "text"), run, ANCHORS)


def _picked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per distinct text whose key is among the distinct ones of ``keys``."""
    few = keys.count() <= BROADCAST_KEYS
    return texts.join(F.broadcast(keys) if few else keys, KEY, "left_semi").dropDuplicates(KEY)


CONTEXT = ["anchor", "c1", "c2", *KEY, "start", "at"]


def _cut_contexts(texts: DataFrame, wanted: DataFrame) -> Stored:
    """The wanted stretches with the bytes that they cover."""
    lists = Stored(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "c1", "c2", "start", "end", "at", "large")).alias("which")))
    whole = _picked(texts, lists.df.select(*KEY)).join(lists.df, KEY).select(*KEY, F.encode("text", "utf-8").alias("raw"), F.explode("which").alias("w"))
    # substring() of binary counts bytes from 1
    out = Stored(whole.select("w.anchor", "w.c1", "w.c2", *KEY, "w.start", "w.at", "w.large", F.expr("substring(raw, w.start + 1, w.end - w.start)").alias("bytes")))
    lists.drop()
    return out


def digit_order(group: np.ndarray, loads: np.ndarray, place: np.ndarray, length: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix order within groups, from the most significant digit on: the order, and at each place of it the bytes shared with the one before (-1 where a group begins).

    Row r's letters are the ``length[r]`` bytes from ``place[r]`` on, whose 8-byte numbers are ``loads``; then bytes ``pad`` follow without end.
    """
    order = np.argsort(group, kind="stable")
    head = np.append(True, np.diff(group[order]) != 0)[: len(order)]
    shared = np.where(head, -1, FAR)
    fill, depth = np.uint64(pad * 0x0101010101010101), 0
    while True:
        lone = head & np.append(head[1:], True)[: len(head)]
        alive = np.flatnonzero(~lone)
        rows = order[alive]
        rest = length[rows] - depth
        if not len(alive) or rest.max() <= 0:
            return order, shared
        digit = loads[np.minimum(place[rows] + depth, len(loads) - 1)]
        if rest.min() < 8:
            cut = np.clip(8 - rest, 0, 8)
            over = np.where(cut >= 8, ~np.uint64(0), (np.uint64(1) << (cut.astype(np.uint64) % np.uint64(8) * np.uint64(8))) - np.uint64(1))
            digit = digit & ~over | fill & over
        of = np.cumsum(head)[alive]
        by = np.lexsort((digit, of))
        order[alive], digit = rows[by], digit[by]
        parts = np.flatnonzero((digit[1:] != digit[:-1]) & (of[1:] == of[:-1])) + 1
        unlike = digit[parts] ^ digit[parts - 1]
        same = np.zeros(len(parts), np.int64)
        for k in range(1, 8):
            same += (unlike >> np.uint64(64 - 8 * k)) == 0
        shared[alive[parts]], head[alive[parts]] = depth + same, True
        depth += 8


class Contexts:
    """Stretches of one kind with the letters around their anchors."""

    def __init__(self, group: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, size: int, gram: int, by_words: bool):
        self.at, self.size, self.width = at, size, size - gram + 1
        if by_words:
            self.starts, self.ends, self.first = word_places(data, offsets)
            pad, many = 9, np.diff(self.first)  # words hold no tab
            data, self.begin = _spelled(data, self.starts, self.ends, self.first)
            place, far = self.begin[self.first[:-1] + at], self.begin[self.first[1:] - 1] + 1 + (self.ends - self.starts)[self.first[1:] - 1]
            near = self.begin[self.first[:-1]] - 1
        else:
            pad, many = 0, np.diff(offsets)
            place, far, near = offsets[:-1] + at, offsets[1:], offsets[:-1]
        #: The least and the greatest number of letters that a window of the stretch has before the anchor.
        self.least, self.most = at - (many - size), at
        self.after = digit_order(group, big_endian(data), place, far - place, pad)
        self.before = digit_order(group, big_endian(data[::-1]), len(data) - place, place - near, pad)
        if by_words:
            word = self.first[:-1] + at
            self.after[1][:] = self._words(self.after, np.minimum(self.after[1], (far - place)[self.after[0]]) + place[self.after[0]], word, 1)
            self.before[1][:] = self._words(self.before, place[self.before[0]] - np.minimum(self.before[1], (place - near)[self.before[0]]), word, -1)

    def _words(self, order: tuple[np.ndarray, np.ndarray], upto: np.ndarray, word: np.ndarray, way: int) -> np.ndarray:
        """Bytes shared as whole words shared."""
        own = word[order[0]]
        if way > 0:  # the words before the last of which the next begins at ``upto`` or earlier, or the stretch ends
            last = np.searchsorted(self.begin, upto, "right") - 1
            whole = upto >= self.begin[last] + (self.ends - self.starts)[last] + 1
            count = last - own + whole
        else:  # a word counts with the space before it
            count = own - np.searchsorted(self.begin - 1, upto)
        return np.where(order[1] < 0, -1, np.maximum(count, 0))

    def repeated(self) -> np.ndarray:
        """Flags of (stretch, window), in order."""
        n = len(self.at)
        found, ranks = np.zeros((n, self.width + 1), bool), []
        for order, _ in (self.after, self.before):
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            ranks.append(rank)
        for i in range(self.width):  # letters of a window before its anchor
            rows = np.flatnonzero((self.least <= i) & (i <= self.most))
            if len(rows) < 2:
                continue
            right = np.cumsum(self.after[1] < self.size - i)[ranks[0][rows]]
            left = np.cumsum(self.before[1] < i)[ranks[1][rows]]
            key = right * (n + 1) + left
            by = np.argsort(key)
            same = key[by[1:]] == key[by[:-1]]
            hit = np.zeros(len(rows), bool)
            hit[by[1:][same]] = hit[by[:-1][same]] = True
            found[rows[hit], self.at[rows[hit]] - i] = True
        return found


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in lower case (A-Z) with a space after each, and one before each stretch's first; and where they begin."""
    size = ends - starts + 1
    lead = np.zeros(len(starts), np.int64)
    lead[first[:-1][np.diff(first) > 0]] = 1
    begin = np.cumsum(size + lead) - size
    out = np.full(int(begin[-1] + size[-1]) if len(begin) else 0, 32, np.uint8)
    count = ends - starts
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    letters = data[np.repeat(starts, count) + inside]
    out[np.repeat(begin, count) + inside] = letters + np.where((letters >= 65) & (letters <= 90), 32, 0).astype(np.uint8)
    return out, begin


SPANS = "th long, tl long, start int, end int, by_words boolean"


def _ordered(contexts: DataFrame, size: int, words: int | None) -> DataFrame:
    """The runs of repeated windows (columns of SPANS), for anchors of bounded groups."""

    def intervals(table: pa.Table, kind: int) -> pa.RecordBatch:
        data, offsets = text_buffer(table["bytes"].combine_chunks())
        anchor, th, tl, base, at = (table[c].to_numpy() for c in ("anchor", *KEY, "start", "at"))
        at = at.astype(np.int64)
        x = Contexts(anchor, at, data, offsets, words if kind else size, GRAM_WORDS if kind else GRAM, bool(kind))
        flags = x.repeated()
        step = np.flatnonzero(np.diff(flags.ravel().astype(np.int8), prepend=0))
        (w, a), b = np.divmod(step[::2], flags.shape[1]), step[1::2] % flags.shape[1] - 1 + x.size  # the last column is never set
        if kind:
            a, b = x.starts[x.first[w] + a] - offsets[w], x.ends[x.first[w] + b - 1] - offsets[w]
        columns = [th[w], tl[w], (base[w] + a).astype(np.int32), (base[w] + b).astype(np.int32), np.full(len(w), bool(kind))]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [c.split()[0] for c in SPANS.split(", ")])

    def both(table: pa.Table) -> Iterator[pa.RecordBatch]:
        odd = (table["anchor"].to_numpy() & 1).astype(bool)
        for kind in (0, 1):
            part = table.filter(pa.array(odd == bool(kind)))
            anchor = part["anchor"].to_numpy()
            a = 0
            while a < len(anchor):  # parts of about ROWS rows that never split an anchor
                b = int(np.searchsorted(anchor, anchor[min(a + ROWS, len(anchor)) - 1], "right"))
                yield intervals(part.slice(a, b - a), kind)
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole anchors, and the start of the last one
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < GATHERED:
                continue
            table = pa.Table.from_batches(held)
            anchor = table["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # sorted: the last anchor may go on
            yield from both(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from both(pa.Table.from_batches(held))

    parts = partitions(contexts.sparkSession, contexts.count() * 600)
    return map_arrow(contexts.repartition(parts, "anchor").sortWithinPartitions("anchor").select(*CONTEXT, "bytes"), run, SPANS)


ID = ["anchor", "c1", "c2"]


def _chunks(contexts: DataFrame, size: int, words: int | None, width: int) -> DataFrame:
    """Chunks of ``width`` neighbouring windows, by the letters that they have before the anchor (``wanted``: the wider chunks to cut, null for all).

    k1, k2: name of what all windows of the chunk hold; f: name of all that this stretch has of it; ``start``, ``end``: the bytes of its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, c1, c2, base, at, wanted, wider, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                depth, unit, places, many = size, 1, None, len(raw)
                text = raw
                if anchor & 1:
                    data, ends = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
                    starts, stops, first = word_places(data, ends)
                    text, begin = _spelled(data, starts, stops, first)
                    text, begin, depth, many = text.tobytes(), np.append(begin, len(text)), words, len(starts)
                cut = (lambda a, b: text[a:b]) if not anchor & 1 else (lambda a, b, t=text, g=begin: t[g[a] : g[b]])
                least, most = at - (many - depth), at
                ranges = [(0, most)] if wanted is None else [(w, w + wider - 1) for w in wanted]
                for lo, hi in ranges:
                    for x in range(max(lo, least) // width * width, min(hi, most) + 1, width):
                        y = x + width - 1
                        a, b = max(x, least), min(y, most)  # the stretch's own part of the chunk
                        # All windows hold what is after the anchor to depth - y and before it to x.
                        key = np.frombuffer(xxhash.xxh3_128_digest(cut(at - x, at + max(0, depth - y)) + x.to_bytes(4), width), "<i8")
                        full = xxhash.xxh3_64_intdigest(cut(at - b, at - a + depth), a << 32 | b) - (1 << 63)
                        start, end = at - b, at - a + depth
                        if anchor & 1:
                            start, end = int(starts[start]), int(stops[end - 1])
                        out.append((anchor, c1, c2, x, int(key[0]), int(key[1]), full, base + start, base + end))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), [*ID, "x", "k1", "k2", "f", "start", "end"])

    return map_arrow(contexts.select(*ID, "start", "at", "wanted", "wider", "bytes"), run, "anchor long, c1 long, c2 long, x int, k1 long, k2 long, f long, start int, end int")


def _refined(contexts: DataFrame, size: int, words: int | None) -> list[Stored]:
    """The same as ``_ordered`` for anchors with any number of contents, pass by pass: tables with the columns of SPANS."""
    out, todo = [], contexts.withColumns({"wanted": F.lit(None).cast("array<int>"), "wider": F.lit(0)})
    group, last = ["anchor", "x", "k1", "k2"], None
    for width in CHUNKS:
        made = Stored(_chunks(todo, size, words, width))
        often = made.df.groupBy(*group).agg(F.count("*").alias("m"), (F.min("f") == F.max("f")).alias("alike")).where("m > 1")
        often = Stored(often)
        state = Stored(hot_join(made.df, often.df, group, "m", "inner").select(*ID, "x", "start", "end", "alike"))
        often.drop()
        done = state.df if width == 1 else state.df.where("alike")
        own = contexts.select(*ID, *KEY)
        out.append(Stored(done.select(*ID, "start", "end").join(own, ID).select(*KEY, "start", "end", (F.col("anchor") % 2 != 0).alias("by_words"))))
        made.drop()
        more = state.df.where("NOT alike").groupBy(*ID).agg(F.sort_array(F.collect_list("x")).alias("wanted"))
        if last:
            last.drop()
        if width > 1:
            last = Stored(contexts.join(more, ID).withColumn("wider", F.lit(width)))
            todo = last.df
        state.drop()
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """docs with their text made non-null and its key."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"text": text, **text_key(text)})


def text_key(text) -> dict:
    return {"th": F.xxhash64(text), "tl": F.xxhash64(F.lit(1), text)}


def repeated(texts: DataFrame, size: int = 400, group: int = GROUP, words: int | None = None) -> Stored:
    """KEY and found: the sorted runs (start, end, by_words) of repeated windows, of the texts that have any; ``texts`` has KEY and text."""
    rows = Stored(_anchors(texts, size, words, common_pieces(texts, words, group)))
    differ = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    met = Stored(rows.df.groupBy("anchor").agg(F.count("*").alias("m"), differ.alias("several")).where("m > 1"))
    again = Stored(hot_join(rows.df, met.df, ["anchor"], "m", "inner"))
    for done in (rows, met):
        done.drop()
    by_words = (F.col("anchor") % 2 != 0).alias("by_words")
    span = [*KEY, "start", "end", by_words]
    several = again.df.where("several")
    contents = several.groupBy(*ID).agg(F.first("m").alias("m"), F.count("*").alias("same"), F.min(F.struct(*KEY, "start", "end", "at")).alias("one"))
    contents = Stored(contents.select(*ID, "m", "same", "one.*"))
    whole = hot_join(several, contents.df.where("same > 1").select(*ID, "same"), ID, "same", "left_semi").select(*span).union(again.df.where("NOT several").select(*span))
    large = contents.df.where(F.col("m") > group).groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > group).select("anchor", F.lit(True).alias("large"))
    large = Stored(large)
    kept = _cut_contexts(texts, contents.df.join(large.df, "anchor", "left").withColumn("large", F.col("large").isNotNull()))
    parts, used = whole.union(_ordered(kept.df.where("NOT large"), size, words)), [again, contents, large, kept]
    if not large.df.isEmpty():
        for made in _refined(kept.df.where("large").drop("large"), size, words):
            parts = parts.union(made.df)
            used.append(made)
    found = Stored(parts.distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "by_words"))).alias("found")))
    for done in used:
        done.drop()
    return found


RESULT = "th long, tl long, n_removed long, n_spans long, n_passages long, kept_sha256 string, kept string"


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs, by rising start, with those that touch made one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[new], np.append(reach[new[1:] - 1], reach[-1])


def cut(texts: DataFrame, found: DataFrame, with_words: bool) -> DataFrame:
    """What is left of each distinct text with repeated windows (columns of RESULT); windows of words go only ``with_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, text, spans in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                start, end, by_words = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                go = ~by_words | with_words
                a, b = merged(start[go], end[go])
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                rows.append((*(k.as_py() for k in key), int((b - a).sum()), len(a), len(merged(start[by_words], end[by_words])[0]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), [x.split()[0] for x in RESULT.split(", ")])

    return map_arrow(_picked(texts, found.select(*KEY)).join(found, KEY).select(*KEY, "text", "found"), run, RESULT)


def dedup_report(docs: DataFrame, size: int = 400, group: int = GROUP, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text), by windows of bytes; and n_passages, the runs of repeated windows of ``words`` words, which stay."""
    own = keyed(docs.select("doc_id", "text"))
    texts = own.select(*KEY, "text")
    left = cut(texts, repeated(texts, size, group, words).df, False).drop("kept")
    out = own.select("doc_id", *KEY, F.octet_length("text").alias("n"), F.sha2(F.encode("text", "utf-8"), 256).alias("all_sha256")).join(left, KEY, "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_bytes"), none("n_removed"), none("n_spans"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), none("n_passages"),
    )


def dedup(docs: DataFrame, size: int = 400, group: int = GROUP, words: int | None = None) -> DataFrame:
    """docs without repeated bytes and, with ``words``, without repeated windows of that many words (characters that are cut in two go as a whole); all columns stay, n_chars is set anew."""
    own = keyed(docs.select("text"))
    left = cut(own, repeated(own, size, group, words).df, True).select(*KEY, "kept")
    whole = packed(docs, **text_key(F.coalesce(docs["text"], F.lit("")))).join(left, KEY, "left")
    return unpacked(whole, docs, F.coalesce("kept", "row.text"))
