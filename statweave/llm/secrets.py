"""Secret scans with multipart credential linking; DataFrame functions only.

Two sorts of patterns are looked for in whole texts.  *Strong* ones (``assign``,
``access``, ``hex``) are reported as they stand.  *Weak* ones (``ident``, ``key``,
``endpoint``) look like a part of a credential and are reported only where the
parts that complete them stand within the same scope: a key needs an access
identifier, an identifier needs a secret, an endpoint needs both.

Catalyst has no expression that yields all match positions, so a text is split
at its matches, and running sums over the lengths of gaps and matches (a window
by document and kind, which spills) turn them into offsets in code points.  The
link is an interval join on (document, cell), a cell being ``scope`` characters
wide.  What stands in a cell is reduced to its least start and greatest end
before the join, so that a dense cell never pairs all with all.

Defined results: a null text counts as empty; repeated rows give repeated,
equal rows; rows with a null ``doc_id`` are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, stored, unpacked

#: kind -> (pattern, group whose length counts, least length), in the order in which kinds at one start are listed.
STRONG = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
WEAK = {
    "ident": (r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", 1, 4),
    "key": (r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": (r"""(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""", 0, 8),
}
KINDS = {**STRONG, **WEAK}
#: kind -> what it supplies to others
SUPPLIES = {"access": "identity", "ident": "identity", "assign": "secret", "hex": "secret", "key": "secret"}
#: weak kind -> what has to stand near it
NEEDS = {"key": ["identity"], "ident": ["secret"], "endpoint": ["identity", "secret"]}
SCOPE = 400


def _hits(text: Column, kind: str) -> Column:
    """All matches of a kind as array<struct<gap, size, good>>: characters since the last match, in the match, and whether it is long enough."""
    pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("all"), part.alias("part"))
    made = F.transform(
        F.filter(zipped, lambda x: x["all"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("size"), (F.length(x["part"]) >= least).alias("good")),
    )
    return F.when(text.rlike(pattern), made)


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per span of each distinct (doc_id, text): key, kind, ord, start, end, strong.

    ``key`` identifies the pair of doc_id and text; ``row_key`` makes it.
    """
    order = list(KINDS)
    found = docs.select(row_key(docs).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    arrays = F.array(*[F.struct(F.lit(i).alias("ord"), _hits(F.col("text"), k).alias("hits")) for i, k in enumerate(order)])
    rows = (
        found.select("key", F.explode(F.filter(arrays, lambda x: x["hits"].isNotNull())).alias("k"))
        .select("key", F.col("k.ord").alias("ord"), F.posexplode("k.hits").alias("i", "hit"))
        .select("key", "ord", "i", "hit.gap", "hit.size", "hit.good")
        .dropDuplicates(["key", "ord", "i"])
    )
    running = W.partitionBy("key", "ord").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = F.sum(F.col("gap") + F.col("size")).over(running)
    spans = stored(
        rows.withColumn("end", ends)
        .where("good")
        .select("key", "ord", F.element_at(F.array(*map(F.lit, order)), F.col("ord") + 1).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")
    )
    strong = spans.where(F.col("kind").isin(*STRONG))
    return strong.withColumn("strong", F.lit(True)).unionByName(_linked(spans, scope).withColumn("strong", F.lit(False)))


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans whose complements stand at most ``scope`` characters away."""
    chosen = lambda made: F.element_at(F.create_map(*[F.lit(x) for kv in made.items() for x in kv]), F.col("kind"))
    cell = lambda c: F.floor(c / F.lit(scope))
    supply = (
        spans.where(F.col("kind").isin(*SUPPLIES))
        .select("key", chosen(SUPPLIES).alias("what"), "start", "end", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
        .groupBy("key", "cell", "what")
        .agg(F.min("start").alias("from"), F.max("end").alias("to"))
    )
    lo, hi = F.col("start") - scope, F.col("end") + scope
    weak = spans.where(F.col("kind").isin(*WEAK)).withColumn("cell", F.explode(F.sequence(cell(lo), cell(hi))))
    near = weak.join(supply, ["key", "cell"]).where((F.col("from") <= hi) & (F.col("to") >= lo))
    # Of one class the span itself is no complement: keys need identities, identities and endpoints need secrets.
    got = near.groupBy("key", "ord", "kind", "start", "end").agg(F.collect_set("what").alias("got"))
    rules = [(F.col("kind") == k) & F.forall(F.array(*map(F.lit, need)), lambda x: F.array_contains(F.col("got"), x)) for k, need in NEEDS.items()]
    keep = rules[0]
    for r in rules[1:]:
        keep = keep | r
    return got.where(keep).drop("got")


def row_key(docs: DataFrame) -> Column:
    return F.concat_ws(":", docs["doc_id"].cast("string"), F.hex(F.xxhash64(F.coalesce(docs["text"], F.lit("")))))


def _listed(spans: Column) -> Column:
    made = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(made, ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: counts of strong spans by kind, a digest of them, and all reported spans as text."""
    span = F.struct("start", "ord", "kind", "end")
    by = find_spans(docs, scope).groupBy("key").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG],
        F.collect_list(F.when(F.col("strong"), span)).alias("base"),
        F.collect_list(span).alias("found"),
    )
    out = docs.select("doc_id", row_key(docs).alias("key")).join(by, "key", "left")
    text = F.coalesce(_listed(F.col("base")), F.lit(""))
    return out.select(
        "doc_id",
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in STRONG],
        F.sha2(text, 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("found")), F.lit("")).alias("spans"),
    )


#: Characters of the blocks that a text is cut into, so that a piece of it is found without going through all before it.
BLOCK = 1024


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) of a text given in blocks."""
    first = F.floor(start / F.lit(BLOCK)).cast("int")
    some = F.slice(blocks, first + 1, F.floor(end / F.lit(BLOCK)).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), (start - first * F.lit(BLOCK) + 1).cast("int"), (end - start).cast("int"))


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced by ``mask`` (overlapping spans by one); all columns stay, n_chars is set anew.

    What lies between spans is cut from blocks of the text, so the work grows with the text and the spans, not with their product.
    """
    before = W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = find_spans(docs, scope).select("key", "start", "end").withColumn("last", F.coalesce(F.max("end").over(before), F.lit(0)))
    gap = F.when(F.col("start") >= F.col("last"), F.struct(F.col("last").alias("a"), F.col("start").alias("b")))
    gaps = reach.groupBy("key").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("end").alias("last"))
    text = F.col("row.text")
    keyed = packed(docs, key=row_key(docs)).join(gaps, "key", "left")
    keyed = keyed.withColumn("blocks", F.when(F.col("gaps").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    whole = F.concat(F.transform("gaps", lambda g: _piece(F.col("blocks"), g["a"], g["b"])), F.array(_piece(F.col("blocks"), F.col("last"), F.length(text))))
    return unpacked(keyed, docs, F.when(F.col("gaps").isNull(), text).otherwise(F.array_join(whole, mask)))
