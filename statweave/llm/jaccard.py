"""Exact n-gram Jaccard join by set-relation skipping, reported as components.

Sets of equal content are one *class*, stood for by its smallest document.
Classes are indexed by the prefixes of their sets: of two sets at similarity t
at least one shingle stands in both prefixes, the first  n - ceil(t n) + 1
shingles under any order that all sets share.  Here the order puts common
shingles last.  Three sorts of work are skipped:

* by position: an index list is cut into blocks of similar set sizes, and only
  blocks that can hold a partner meet; within them the places of the shingle in
  both sets bound the overlap from above;
* by relation: of each list the class that stands in most lists is the pivot.  First every class
  meets only the pivot that it shares most prefix shingles with.  A class that
  is verified against its pivot has, as far as components go, the pivot's
  answers; after that only members outside the pivot's component are looked up
  in its lists, so a large group of near copies costs its size, not its square;
* equal sets are never compared.

Candidates are verified on whole sets of 64-bit shingle hashes, which are made
again from the texts of the classes involved.

The lists' lengths and pivots come from an aggregate over all entries, which
combines before the shuffle, and every join by shingle, pivot or class has plain
tables on both sides, so that adaptive execution splits the long ones.

Counting for the order: each task counts the shingles of its own texts and passes
on those it has met twice.  The most frequent ones, at most ``COMMON`` and cut
where their numbers' classes are, go to all tasks (16 bytes each).  They only decide the order and with it the cost.

``linked`` gives classes and components; ``links`` all pairs of classes that are linked and
``counted`` their number for each document.

Defined results: a null or empty text has no shingles and links with nothing;
repeated rows are members of one class; rows that share a doc_id but not their
text are nodes of their own, and a component's id is the least doc_id in it; a
row with a null doc_id counts as a copy where its text has others, and has a null
component otherwise; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, Words, blocks, byte_table, free_shuffles, hot_join, map_arrow, mix, text_buffer
from .graph import components

#: Greatest number of shingles that are sent to all tasks as common: 8 MB.
COMMON = 1 << 19
#: Bytes of text in which a task looks for shingles that it meets twice.
COUNTED = 24 << 20
#: Greatest number of pairs whose classes are broadcast to pick their texts (about 100 bytes each in memory: 20 MB); beyond it the texts are joined.
BROADCAST_IDS = 200_000
NOT_SPACE = byte_table(np.setdiff1d(np.arange(256), [9, 10, 11, 12, 13, 32]))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_buffer(column)
    factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(width)]
    for i, j in blocks(offsets, 1 << 19):
        own = offsets[i : j + 1] - offsets[i]
        words = Words(data[offsets[i] : offsets[j]], own, NOT_SPACE)
        h, many = words.hashes, max(0, len(words.hashes) - width + 1)
        rolled = np.zeros(many, np.uint64)
        for k, f in enumerate(factors):
            rolled += h[k : k + many] * f
        rolled = mix(rolled)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mix(np.array([sum(int(x) * int(f) for x, f in zip(h[a:b], factors, strict=False)) + (b - a) & (1 << 64) - 1], np.uint64))
            else:
                yield h[:0]


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts share, sorted, and how often tasks met them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            held += shingle_sets(batch.column(0), width)
            size += batch.nbytes
            if size > COUNTED:
                yield often(np.concatenate(held))
                held, size = held[:1], 0
        yield often(np.concatenate(held))

    def often(found: np.ndarray) -> pa.RecordBatch:
        found.sort()
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
        times = np.diff(np.append(first, len(found)))
        more = times >= 2
        return pa.RecordBatch.from_arrays([pa.array(found[first[more]].view(np.int64)), pa.array(times[more])], ["token", "times"])

    counted = map_arrow(docs.select("text"), count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).where("times >= 8")
    counted = Stored(counted.withColumn("class", F.floor(F.log2("times") * 16).cast("int")))
    many, least = 0, None
    for c, n in sorted((tuple(r) for r in counted.df.groupBy("class").count().collect()), reverse=True):  # at most 1,024 classes of numbers
        if many + n > COMMON:
            break
        many, least = many + n, c
    top = counted.df.where("false" if least is None else f"class >= {least}").select("token", "times").toArrow()
    counted.drop()
    tokens, times = top["token"].to_numpy().view(np.uint64), top["times"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def _sets(docs: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, fp (digest of the set), and its prefix under the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = shared.value
        for batch in batches:
            n, fp, prefix = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                fp.append(_digest(s))
                if len(tokens) and len(s):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = np.where(tokens[at] == s, times[at], 0)
                    if often.any():
                        s = s[np.argsort(often, kind="stable")]
                prefix.append(s[: len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), _lists(prefix)], ["doc_id", "n", "fp", "prefix"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n int, fp binary, prefix array<long>")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, repeats: bool) -> Stored:
    """The pairs (u, v) of classes whose sets reach the similarity; classes: (k, c, fp). ``repeats``: whether rows share a doc_id.

    The set of each u goes to its partners once for each, the set of a v once.
    """
    told = Stored(pairs)
    few = told.df.count() <= BROADCAST_IDS

    def sets(wanted: DataFrame, more: str, schema: str) -> DataFrame:
        """The sets of the wanted classes (k, doc_id, fp, ...), made from their documents."""
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = list(shingle_sets(batch.column(batch.num_columns - 1), width))
                keep = np.flatnonzero([_digest(s) == fp for s, fp in zip(made, batch.column(0).to_pylist(), strict=True)])  # rows may share a doc_id but not their text
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep)) for i in range(1, batch.num_columns - 1)), _lists([made[i].view(np.int64) for i in keep])], names)

        kept = Stored(wanted)
        used.append(kept)
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        found = keyed.join(F.broadcast(kept.df) if few else kept.df, "doc_id").select("fp", *more.split(), "text")
        return map_arrow(found, run, schema)

    used: list[Stored] = [told]
    of = classes.select("k", F.col("c").alias("doc_id"), "fp")
    lists = told.df.groupBy("u").agg(F.collect_list("v").alias("vs"))
    left = sets(of.join(lists.withColumnRenamed("u", "k"), "k"), "k vs", "u long, vs array<long>, a array<long>").select("u", F.explode("vs").alias("v"), "a")
    right = sets(of.join(told.df.select(F.col("v").alias("k")).distinct(), "k"), "k", "v long, b array<long>")
    if repeats:
        left, right = left.dropDuplicates(["u", "v"]), right.dropDuplicates(["v"])
    shared = F.size(F.array_intersect("a", "b"))
    out = Stored(left.join(right, "v").where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v"))
    for done in used:
        done.drop()
    free_shuffles(docs.sparkSession)
    return out


def _possible(n: str, i: str, m: str, j: str, percent: int):
    """Whether sets of n and m shingles that share the ones at places i and j, and none before, can be similar."""
    n, i, m, j = map(F.col, (n, i, m, j))
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (1 + F.least(n - i - 1, m - j - 1) >= least)


class Index:
    """Rows, classes and the lists of prefix shingles of docs (doc_id, text), as stored tables."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        sets = Stored(_sets(docs, width, percent, common_shingles(docs, width)))
        self.rows = Stored(sets.df.select("doc_id", "n", "fp"))
        whole = sets.df.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("c"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        # A class is named by its smallest document; where unlike rows share an id, by a number (written once).
        again = self.rows.df.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.count("*").alias("m"), (F.min("fp") != F.max("fp")).alias("unlike")).where("m > 1")
        #: Whether rows share a doc_id.
        self.repeats, unlike = again.agg(F.count("*") > 0, F.coalesce(F.bool_or("unlike"), F.lit(False))).first()
        self.whole = Stored(whole.withColumn("k", F.monotonically_increasing_id() if unlike else F.col("c")))
        sets.drop()
        free_shuffles(docs.sparkSession)
        self.classes = self.whole.df.select("k", "c", "fp")
        entries = self.whole.df.where("c is not null").select("k", "n", F.posexplode("prefix").alias("i", "token"))
        long = Stored(entries.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"))
        #: token, k, n, i (the shingle's place in the class's prefix), many (classes in the list).
        self.lists = Stored(hot_join(entries, long.df, ["token"], "many", "inner"))
        long.drop()
        free_shuffles(docs.sparkSession)


def _blocks(lists: DataFrame, percent: int) -> DataFrame:
    """lists with the ``block`` of the set's size: sets that can be similar stand in the same or in neighbouring blocks."""
    return lists.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))))


def links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(u, v): all pairs of classes, named by their smallest documents, whose sets reach the similarity; of rows with a doc_id that is theirs alone.

    Nothing is inherited here, so a group of near copies costs the number of its links.
    """
    index = Index(docs, width, percent)
    blocks = _blocks(index.lists.df, percent)
    near = blocks.withColumn("block", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)))
    a, b = (d.select("token", "block", *[F.col(x).alias(x + y) for x in ("k", "n", "i")]) for d, y in ((near, "1"), (blocks, "2")))
    pairs = a.join(b, ["token", "block"]).where((F.col("k1") < F.col("k2")) & _possible("n1", "i1", "n2", "i2", percent)).select(F.col("k1").alias("u"), F.col("k2").alias("v")).distinct()
    found = _verified(docs, index.classes, pairs, width, percent, index.repeats)
    name = lambda x: index.classes.select(F.col("k").alias(x), F.col("c").alias(f"{x}_"))
    out = Stored(found.df.join(name("u"), "u").join(name("v"), "v").select(F.col("u_").alias("u"), F.col("v_").alias("v")))
    for done in (index.rows, index.whole, index.lists, found):
        done.drop()
    return out.df


def counted(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, class_id and n_links (the rows of equal set, itself not counted, and those of all classes linked with its own) for each row of docs; doc_id is a key here."""
    classes = linked(docs, width, percent).select("doc_id", "class_id", "n_shingles")
    own = Stored(classes.where("n_shingles > 0 and class_id is not null").groupBy("class_id").agg(F.count("*").alias("m")))
    pairs = links(docs, width, percent)
    both = pairs.union(pairs.select("v", "u")).join(own.df.select(F.col("class_id").alias("v"), "m"), "v").groupBy("u").agg(F.sum("m").alias("others"))
    whole = Stored(own.df.join(both.withColumnRenamed("u", "class_id"), "class_id", "left").select("class_id", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    own.drop()
    return classes.join(whole.df, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, and class_id (the smallest document of equal set) for each row of docs (doc_id, text)."""
    index = Index(docs, width, percent)
    rows, whole, classes, marked, repeats = index.rows, index.whole, index.classes, index.lists, index.repeats
    # The pivot of a list is the class that stands in most lists, long ones counting more: of near copies that is what they were made from.
    central = marked.df.join(marked.df.groupBy("k").agg(F.sum(F.log2("many")).alias("weight")), "k")
    pivots = central.groupBy("token").agg(F.max_by(F.struct("k", "n", "i"), F.struct("weight", -F.col("k"))).alias("x"))
    pivots = Stored(pivots.select("token", F.col("x.k").alias("p"), F.col("x.n").alias("m"), F.col("x.i").alias("j")))

    # Round one: each class against the pivot that it meets most often.
    meets = marked.df.join(pivots.df, "token").where("k <> p")
    can = _possible("n", "i", "m", "j", percent)
    often = meets.where((F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)).groupBy("k", "p").agg(F.count("*").alias("times"), F.max(can.cast("int")).alias("can"))
    first = often.where("can = 1").groupBy("k").agg(F.max_by("p", F.struct("times", -F.col("p"))).alias("p"))
    found = _verified(docs, classes, first.select(F.col("k").alias("u"), F.col("p").alias("v")), width, percent, repeats)
    known = components(found.df)

    # Round two: in each list, the members outside the pivot's component against all others of theirs.
    comp = known.df.select(F.col("node").alias("k"), "component")
    pivot = comp.select(F.col("k").alias("p"), F.col("component").alias("pc"))
    placed = (
        marked.df.join(pivots.df.select("token", "p"), "token").join(comp, "k", "left").join(pivot, "p", "left")
        .select("token", "k", "n", "i", F.coalesce("component", "k").alias("g"), (F.coalesce("component", "k") == F.coalesce("pc", "p")).alias("in"))
    )
    placed = Stored(_blocks(placed, percent))
    for done in (marked, pivots, known):
        done.drop()
    outside = placed.df.where(~F.col("in")).withColumn("block", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)))
    a, b = (d.select("token", "block", *[F.col(x).alias(x + y) for x in ("k", "n", "i", "g", "in")]) for d, y in ((outside, "1"), (placed.df, "2")))
    pairs = (
        a.join(b, ["token", "block"])
        .where((F.col("g1") != F.col("g2")) & (F.col("in2") | (F.col("k1") < F.col("k2"))) & _possible("n1", "i1", "n2", "i2", percent))
        .select(F.least("k1", "k2").alias("u"), F.greatest("k1", "k2").alias("v")).distinct()
    )
    more = _verified(docs, classes, pairs, width, percent, repeats)
    placed.drop()
    final = components(found.df.union(more.df))
    inside = Stored(final.df.join(classes.select(F.col("k").alias("node"), "c"), "node"))
    least = Stored(inside.df.groupBy("component").agg(F.min("c").alias("least")))
    linked_ = inside.df.join(least.df, "component").select(F.col("node").alias("k"), "least")
    of = Stored(classes.join(linked_, "k", "left").select("fp", "c", F.coalesce("least", "c").alias("component_id")))
    for done in (inside, least):
        done.drop()
    for done in (found, more, final, whole):
        done.drop()
    out = rows.df.join(of.df, "fp", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("class_id"))
