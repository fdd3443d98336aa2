"""SentencePiece encoding and decoding by suffix-array matching.

New stretches of text (a word with the space before it) are encoded in batches:

1. their bytes are joined into one text, whose suffixes are sorted by ``DEEP``
   bytes;
2. all pieces are searched in the suffix array at once by halving; each gives a
   range of places where it occurs (of a longer piece the rest is compared at
   each place);
3. the ranges become edges (begin, end, piece), sorted by end;
4. relaxing: a stretch's encoding up to a place ends with the one piece that
   goes with the last piece of the encoding up to the piece's begin.  All
   stretches advance together, one end at a time.

For a merging (BPE) model two pieces go together when merging the text of both
gives them back, which shows in the pieces that their merges leave at the seam:
a merge across the seam must come before either side's next own merge to spoil
it.  Characters outside the vocabulary become byte pieces and end a stretch, as
no piece holds them.  Runs of spaces, whose pieces all tie, are merged step by
step from a heap of possible merges.  Stretches that were seen before are looked
up.

Defined results: a null text is empty (no ids); rows repeat as often as they
occur; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPACE = "▁"
#: Stretches, and pairs of pieces, that a process remembers.
REMEMBER = 400_000
PAIRS = 1_000_000
#: Bytes of new stretches that are matched at a time.
BATCH = 1 << 19
#: Bytes to which suffixes are sorted; two numbers.
DEEP = 16
NEVER = np.iinfo(np.int64).max


class Pieces:
    """A model file's pieces; encodes and decodes texts as the file's merges ask."""

    _made: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.bytes_ = {int(self.texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = np.zeros(n, np.int64)
        order = sorted(normal, key=lambda i: -model.get_score(i))
        at, last = 0, None
        for k, i in enumerate(order):  # equal scores have equal ranks
            if model.get_score(i) != last:
                at, last = k, model.get_score(i)
            self.rank[i] = at
        self.ids = {self.texts[i]: i for i in normal}
        self.rank_of = {self.texts[i]: int(self.rank[i]) for i in normal}
        self.known = {t for t in self.ids if len(t) == 1}
        blank = [t for t in self.ids if set(t) == {SPACE} and len(t) > 1]
        if any(SPACE in t[1:] for t in self.ids if t not in blank):
            raise ValueError("pieces that hold a space inside are not supported")
        self.raw = [b"" for _ in range(n)]
        for i in normal:
            self.raw[i] = self.texts[i].replace(SPACE, " ").encode()
        for b, i in self.bytes_.items():
            self.raw[i] = bytes([b])
        one = "".join(map(re.escape, sorted(self.known)))
        self.parts, self.odd = re.compile(f"[{one}]+|[^{one}]+"), re.compile(f"  |[^ {one}]")
        #: What the model puts before a text.
        self.prefix = " " if model.encode("a", out_type=str)[0].startswith(SPACE) else ""
        self.lone_newline = not any("\n" in t for t in self.ids)
        self.stretch = re.compile(r" {2,}[^ \n]*| ?[^ \n]+| |\n" if self.lone_newline else r" {2,}[^ ]*| ?[^ ]+| ")
        self._merges([i for i in normal if self.texts[i] not in blank])
        self._clear()
        self.fit: dict[int, bool] = {}

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.starts, self.uses = np.zeros(REMEMBER + 1, np.int64), np.zeros(REMEMBER + 1, np.int64)

    # Merging of single stretches, step by step.

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a text, and the last merge's two sides: best score first, leftmost of equals."""
        parts, sides, n = list(text), None, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids, rank = self.ids, self.rank_of
        heap = [(rank[t], k, t) for k in range(n - 1) if (t := parts[k] + parts[k + 1]) in ids]
        heapify(heap)
        while heap:
            _, k, t = heappop(heap)
            j = after[k]
            if not parts[k] or j >= n or parts[k] + parts[j] != t:
                continue  # one of the two has been merged with another since
            sides = parts[k], parts[j]
            parts[k], parts[j], after[k] = t, "", after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (t := parts[x] + parts[after[x]]) in ids:
                    heappush(heap, (rank[t], x, t))
        return [p for p in parts if p], sides

    def _slow(self, text: str) -> list[int]:
        out = []
        for p in self.merged(text)[0]:
            out += [self.ids[p]] if p in self.ids else [self.bytes_[b] for b in p.encode()]
        return out

    # Tables over pieces.

    def _merges(self, normal: list[int]) -> None:
        n = len(self.texts)
        self.done = np.full(n, NEVER)  # when a piece's own last merge happens: the worst rank among its merges
        left, right = np.full(n, -1), np.full(n, -1)
        whole = []
        for i in sorted(normal, key=lambda i: len(self.texts[i])):
            t = self.texts[i]
            if len(t) == 1:
                self.done[i] = -1
                whole.append(i)
                continue
            parts, sides = self.merged(t)
            if len(parts) == 1:  # otherwise no text is ever encoded with it
                a, b = (self.ids[s] for s in sides)
                left[i], right[i] = a, b
                self.done[i] = max(self.rank[i], self.done[a], self.done[b])
                whole.append(i)

        def spine(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """A piece, its outer half, that half's outer half ...; with the time when each is merged away."""
            now, until = np.arange(n), np.full(n, NEVER)
            ids, ends = [], []
            while (now >= 0).any():
                ids.append(now)
                ends.append(until)
                until = np.where(now >= 0, self.done[now], 0)
                now = np.where(now >= 0, side[now], -1)
            return np.array(ids), np.array(ends)

        self.right_spine, self.left_spine = spine(right), spine(left)
        pairs = {}
        for i in normal:
            t = self.texts[i]
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # Pieces to search, sorted by bytes, as the first and the last key that a suffix with them can have.
        raw = sorted((self.texts[i].encode(), i) for i in whole)
        self.long = [(k, np.frombuffer(r[DEEP:], np.uint8)) for k, (r, _) in enumerate(raw) if len(r) > DEEP]
        self.wanted = np.array([i for _, i in raw], np.int64)
        self.sizes = np.array([len(r) for r, _ in raw], np.int64)
        keys = lambda fill: np.frombuffer(b"".join(r[:DEEP].ljust(DEEP, fill) for r, _ in raw), ">u8").reshape(-1, 2).astype(np.uint64)
        self.low, self.high = keys(b"\0"), keys(b"\xff")

    def go_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of pieces a and b, one after the other, gives a and b."""
        bad = np.zeros(len(a), bool)
        ra, ea = self.right_spine
        lb, eb = self.left_spine
        for x, until_x in zip(ra[:, a], ea[:, a], strict=True):
            some = np.flatnonzero((x >= 0) & ~bad)
            if not len(some):
                continue
            for y, until_y in zip(lb[:, b[some]], eb[:, b[some]], strict=True):
                key = x[some] << 32 | y
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                hit = (y >= 0) & (self.pair_keys[at] == key) if len(self.pair_keys) else np.zeros(len(y), bool)
                when = np.maximum(self.rank[self.pair_ids[at]], np.maximum(self.done[x[some]], self.done[np.maximum(y, 0)])) if hit.any() else 0
                bad[some] |= hit & (when < until_x[some]) & (when <= until_y)
        return ~bad

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """go_together with memory; a is -1 at the begin of a stretch."""
        key, back = np.unique(a * (1 << 32) + b, return_inverse=True)
        known = [self.fit.get(k) for k in key.tolist()]
        new = np.array([k is None for k in known], bool)
        out = np.array([bool(k) for k in known], bool)
        if new.any():
            x, y = key[new] >> 32, key[new] & 0xFFFFFFFF
            out[new] = np.where(x < 0, True, self.go_together(np.maximum(x, 0), y))
            if len(self.fit) > PAIRS:
                self.fit.clear()
            self.fit.update(zip(key[new].tolist(), out[new].tolist(), strict=True))
        return out[back]

    # Batches of stretches.

    def _suffixes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes in order of their first DEEP bytes, and those as two numbers."""
        padded = np.concatenate([data, np.zeros(DEEP + 8, np.uint8)])
        loads = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,)).astype(np.uint64)
        order = np.lexsort((loads[8 : 8 + len(data)], loads[: len(data)]))
        return order, loads[order], loads[order + 8]

    def _bound(self, one: np.ndarray, two: np.ndarray, probes: np.ndarray, after: bool) -> np.ndarray:
        """For each probe the number of sorted suffixes below it, or not above it: by the first number, then by halving."""
        lo, hi = np.searchsorted(one, probes[:, 0]), np.searchsorted(one, probes[:, 0], "right")
        while (some := np.flatnonzero(lo < hi)).size:
            mid = (lo[some] + hi[some]) // 2
            go = two[mid] <= probes[some, 1] if after else two[mid] < probes[some, 1]
            lo[some[go]], hi[some[~go]] = mid[go] + 1, mid[~go]
        return lo

    def match(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each stretch (of known characters, spaces as in pieces); 0 where relaxing finds no way."""
        data = np.frombuffer(("\0".join(stretches) + "\0").encode(), np.uint8)
        ends = np.flatnonzero(data == 0)
        starts = np.append(0, ends[:-1] + 1)
        order, one, two = self._suffixes(data)
        first, last = self._bound(one, two, self.low, False), self._bound(one, two, self.high, True)
        many = np.maximum(last - first, 0)
        for k, rest in self.long:
            if many[k]:
                held = order[first[k] : last[k]]
                keep = [p for p in held.tolist() if np.array_equal(data[p + DEEP : p + DEEP + len(rest)], rest)]
                order[first[k] : first[k] + len(keep)], many[k] = keep, len(keep)
        total = int(many.sum())
        place = order[np.arange(total) + np.repeat(first - (np.cumsum(many) - many), many)]
        piece, size = np.repeat(self.wanted, many), np.repeat(self.sizes, many)
        stretch_of = np.repeat(np.arange(len(ends)), ends + 1 - starts)
        own = stretch_of[place]
        depth = place + size - starts[own]
        by = np.argsort(depth, kind="stable")
        place, piece, size, depth = place[by], piece[by], size[by], depth[by]
        #: The last piece of the encoding up to each place: -1 at a begin, -2 where there is none.
        best, begin = np.full(len(data) + 1, -2), np.zeros(len(data) + 1, np.int64)
        best[starts] = -1
        cuts = np.flatnonzero(np.diff(depth, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), total], strict=True):
            a = best[place[i:j]]
            some = i + np.flatnonzero(a > -2)
            fits = some[self._fits(best[place[some]], piece[some])]
            to = place[fits] + size[fits]
            best[to], begin[to] = piece[fits], place[fits]
        # Walk back from the ends, all together.
        at, out, who = ends.copy(), [], []
        live = np.flatnonzero((best[ends] > -1))
        while len(live):
            out.append(best[at[live]])
            who.append(live)
            at[live] = begin[at[live]]
            live = live[at[live] > starts[live]]
        ids, who = (np.concatenate(x[::-1]) if x else np.zeros(0, int) for x in (out, who))
        sort = np.argsort(who, kind="stable")
        return ids[sort], np.bincount(who, minlength=len(ends))

    def _matched(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``match`` in batches, and step by step where it finds no way."""
        flat, counts, i = [], [], 0
        while i < len(stretches):
            j, size = i, 0
            while j < len(stretches) and (size == 0 or size + len(stretches[j]) < BATCH):
                size += len(stretches[j]) + 1
                j += 1
            ids, n = self.match(stretches[i:j])
            if not n.all():
                parts = np.split(ids, np.cumsum(n)[:-1])
                parts = [p if len(p) else np.array(self._slow(s), np.int64) for p, s in zip(parts, stretches[i:j], strict=True)]
                ids, n = np.concatenate(parts), np.array(list(map(len, parts)))
            flat.append(ids)
            counts.append(n)
            i = j
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _learn(self, words: list[str]) -> None:
        """Encode new stretches and remember them."""
        plain = [w for w in words if not self.odd.search(w)]
        ids, counts = self._matched("\0".join(plain).replace(" ", SPACE).split("\0") if plain else [])
        if len(plain) < len(words):
            odd = [w for w in words if self.odd.search(w)]
            more = [self._odd(w.replace(" ", SPACE)) for w in odd]
            plain += odd
            ids = np.concatenate([ids, *(np.array(m, np.int64) for m in more)])
            counts = np.concatenate([counts, np.array(list(map(len, more)))])
        self._append(plain, ids, counts)

    def _append(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        at = len(self.index)
        start = int(self.starts[at])
        ends = start + np.cumsum(counts)
        self.index.update(zip(words, range(at, at + len(words)), strict=True))
        self.starts[at + 1 : at + 1 + len(ends)] = ends
        while len(ends) and ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[start : start + len(ids)] = ids

    def _forget(self) -> None:
        """Keep the half of the memory that is used most, if it has been used again."""
        words = list(self.index)
        keep = np.sort(np.argsort(-self.uses[: len(words)], kind="stable")[: REMEMBER // 2])
        keep = keep[self.uses[keep] > 1]
        starts, counts = self.starts[keep], self.starts[keep + 1] - self.starts[keep]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts - (ends - counts), counts)]
        self._clear()
        self._append([words[k] for k in keep.tolist()], ids, counts)

    def _odd(self, text: str) -> list[int]:
        """A stretch with several spaces or unknown characters."""
        out: list[int] = []
        for part in self.parts.findall(text):
            if part[0] in self.known:
                out += self._slow(part) if SPACE + SPACE in part or len(part) < 64 else self._matched([part])[0].tolist()
            else:
                out += [self.bytes_[b] for b in part.encode()]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.stretch.findall(self.prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = set().union(*cut).difference(self.index)
        if len(self.index) + len(new) > REMEMBER:
            self._forget()
            new = set().union(*cut).difference(self.index)
        if len(self.index) + len(new) > REMEMBER:
            self._clear()
            new = set().union(*cut)
        if len(new) > REMEMBER:  # one after the other, then
            if len(texts) > 1:
                return [self.encode([t])[0] for t in texts]
            self.starts, self.uses = np.zeros(len(new) + 1, np.int64), np.zeros(len(new) + 1, np.int64)
        if new:
            self._learn(list(new))
        out = []
        for words in cut:
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            np.add.at(self.uses, at, 1)
            starts, counts = self.starts[at], self.starts[at + 1] - self.starts[at]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(starts - (ends - counts), counts)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(self.prefix)


SCHEMA = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each row of docs (doc_id, text): columns of SCHEMA; ``ids_crc32`` is of little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            rows, docs_, texts = [], batch.column(0).to_pylist(), batch.column(1)
            i = 0
            while i < len(docs_):
                part, size = [], 0
                while i + len(part) < len(docs_) and size < 3 << 20:
                    part.append(texts[i + len(part)].as_py() or "")
                    size += len(part[-1])
                for doc, text, ids in zip(docs_[i : i + len(part)], part, pieces.encode(part), strict=True):
                    back = pieces.decode(ids)
                    rows.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(SPACE, " ")))
                i += len(part)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
