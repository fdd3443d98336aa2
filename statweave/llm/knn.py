"""Exact top-k search by greatest inner product with two cover trees.

Vectors are dealt by hash into blocks of bounded size, queries likewise; each
(data block, query block) is one group.  In a group both sides get a cover tree
and pairs of nodes are visited together.  With c, r the centre and covering
radius of a node, no product of a query under node Q and a vector under node R
exceeds  <cQ, cR> + |cQ| rR + rQ |cR| + rQ rR ; a pair goes when that lies below
the worst kth score among the queries under Q.  Rows that no child of a node
covers are nodes of radius 0, kept in one array per node, so that many are judged
at once.  Each group gives its k best, and a window over (query, block winners)
makes the final ranks.

The kth scores are carried over blocks: one block of vectors is searched first,
and what it gives is where all other blocks' worst scores start.

A stated query set against all rows in blocks is what the search has to do, so
its cost is queries x vectors at worst; nothing larger than a block is held.

Defined results: rows with a null id, a null vector, or null or non-finite
components take no part.  All rows are candidates, also those that repeat an id
or a whole row; of equal queries (id and vector) one counts, and where several
vectors have a query's id, the best of all their products count; rows with the
query's id are no candidates for it.  Only vectors of equal length are compared.
Ties go to the smaller id.  Scaled components beyond +-2**20 are outside the exact
range of the arithmetic (2**53 for a score).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored

#: Vectors in a leaf of the trees.
LEAF = 16
#: A child's covering radius over its parent's.
SHRINK = 0.6


class CoverTree:
    """A batch-built cover tree over the rows of ``x``.

    A node holds a centre row and the rows within its radius.  The children's
    centres are rows of the node, farther than SHRINK * radius from one
    another, the first being the node's own centre; each row goes to the first
    child centre within that distance.  Children that cover nothing but their
    centre are the node's ``lone`` rows, kept as an array, or with ``single`` they
    are nodes like others; a leaf's rows are all lone.
    """

    def __init__(self, x: np.ndarray, single: bool = False):
        self.x, self.norms = x, np.sqrt((x * x).sum(1))
        self.centre, self.radius, self.rows, self.children, self.lone = [], [], [], [], []
        stack = [(np.arange(len(x)), None)] if len(x) else []
        while stack:
            rows, parent = stack.pop()
            at = len(self.centre)
            if parent is not None:
                self.children[parent].append(at)
            away = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1))
            self.centre.append(rows[0])
            self.radius.append(float(away.max()))
            self.rows.append(rows)
            self.children.append([])
            self.lone.append(rows)
            if len(rows) <= LEAF or self.radius[at] == 0:
                continue
            limit, rest, parts, lone = SHRINK * self.radius[at], rows, [], [rows[:0]]
            while len(rest):
                near = away <= limit
                (parts if single or near.sum() > 1 else lone).append(rest[near])
                rest = rest[~near]
                if len(rest):
                    away = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(1))
            self.lone[at] = np.concatenate(lone)
            stack += [(p, at) for p in reversed(parts)]
        self.centre, self.radius = np.array(self.centre, int), np.array(self.radius)


class Best:
    """The k best (score, id) of each query so far; ``worst`` is the kth score, or what it is known to reach."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None):
        self.k, self.worst = k, np.full(n, -np.inf) if worst is None else worst.copy()
        self.scores, self.ids, self.rows = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        scores = np.where(own[:, None] == ids[None, :], -np.inf, scores)
        for j in np.flatnonzero((scores >= self.worst[queries, None]).any(1)):
            q = queries[j]
            take = np.flatnonzero((scores[j] >= self.worst[q]) & (scores[j] > -np.inf))
            s, i, r = np.concatenate([self.scores[q], scores[j][take]]), np.concatenate([self.ids[q], ids[take]]), np.concatenate([self.rows[q], rows[take]])
            first = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q], self.rows[q] = s[first], i[first], r[first]
            self.worst[q] = max(self.worst[q], self.scores[q][-1])


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, worst: np.ndarray | None = None) -> tuple[Best, int]:
    """All of one block: the best k of each row of q among the rows of x with another id, and the number of products computed (bounds included).

    ``worst``: scores that each query's kth best is known to reach; what lies below need not be found.
    """
    best, done = Best(len(q), k, worst), 0
    if not len(q) or not len(x):
        return best, done
    a, b = CoverTree(q, single=True), CoverTree(x)

    def bounds(qn: int, rows: np.ndarray, radius: np.ndarray | float) -> np.ndarray:
        cq, rq = a.centre[qn], a.radius[qn]
        most = x[rows] @ q[cq] + a.norms[cq] * radius + b.norms[rows] * rq + rq * radius
        return most + 1e-9 * (np.abs(most) + 1)  # above what rounding may have lost

    stack = [(np.inf, 0, 0)]
    while stack:
        bound, qn, rn = stack.pop()
        queries = a.rows[qn]
        least = best.worst[queries].min()
        if bound < least:
            continue
        if a.children[qn] and (len(b.lone[rn]) or a.radius[qn] > b.radius[rn]):
            kids = a.children[qn]
            most = [float(bounds(c, b.centre[[rn]], b.radius[rn])[0]) for c in kids]
            done += len(kids)
            stack += sorted((m, c, rn) for m, c in zip(most, kids, strict=True))
            continue
        rows = b.lone[rn]
        if len(rows) and len(queries) > 1:  # each of them is a node of radius 0
            done += len(rows)
            rows = rows[bounds(qn, rows, 0.0) >= least]
        if len(rows):
            best.add(queries, q[queries] @ x[rows].T, x_ids[rows], rows, q_ids[queries])
            done += len(queries) * len(rows)
        if b.children[rn]:
            kids = np.array(b.children[rn])
            most = bounds(qn, b.centre[kids], b.radius[kids])
            done += len(kids)
            keep = most >= best.worst[queries].min()
            stack += sorted((float(m), qn, int(c)) for m, c in zip(most[keep], kids[keep], strict=True))
    return best, done


#: ``qh``: hash of the query's vector; ``many``: how many rows are like the one found; ``done``: products computed in its block, in one row of each.
FOUND = "query_id long, qh long, vec_id long, score long, many long, done long"


def _searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each (data block, query block): columns of FOUND. vectors: (vec_id, v, many, part, grp); queries: (vec_id, qh, v, worst, part, grp)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in FOUND.split(", ")]
        x, q = (np.asarray(d["v"].combine_chunks().flatten(), np.float64).reshape(d.num_rows, -1) if d.num_rows else np.zeros((0, 1)) for d in (left, right))
        q_ids, qh = right["vec_id"].to_numpy(), right["qh"].to_numpy()
        worst = right["worst"].to_numpy().astype(np.float64)
        best, done = dual_search(q, q_ids, x, left["vec_id"].to_numpy(), k, np.where(np.isnan(worst), -np.inf, worst))
        full = best.scores > -np.inf
        per = full.sum(1)
        of = np.zeros(int(per.sum()), np.int64)
        of[:1] = done  # the group's products, in its first row
        columns = [np.repeat(q_ids, per), np.repeat(qh, per), best.ids[full], best.scores[full].astype(np.int64), left["many"].to_numpy()[best.rows[full]], of]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    keys = ["dim", "part", "grp"]
    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 1024, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``vectors`` for each row of ``queries``.

    Both have (vec_id, v array<long>).  ``block_rows``, ``query_rows``: rows of a block, about.
    """
    found = products(vectors, queries, k, block_rows, query_rows).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("many", F.lit(k)))))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def products(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int, query_rows: int) -> DataFrame:
    """What the blocks give (columns of FOUND), their worst scores carried on from the first block."""
    # Equal rows become one with their number, so that no block grows with it.
    vectors, queries = (d.select("vec_id", "v").where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.count("*").alias("many")).withColumn("dim", F.size("v")) for d in (vectors, queries))
    queries = queries.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), "dim", F.xxhash64("v").alias("qh"))
    n, m = vectors.count(), queries.count()
    parts, groups = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    vectors = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)))
    queries = queries.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    copied = lambda d: d.withColumn("grp", upto(groups))
    none = F.lit(None).cast("long")
    first = _searched(copied(vectors.where("part = 0")), queries.withColumn("worst", none).withColumn("part", F.lit(0).cast("long")), k)
    if parts == 1:
        return first
    first = Stored(first).df
    worst = first.groupBy("query_id", "qh").agg(F.count("*").alias("many"), F.min("score").alias("worst")).where(F.col("many") == k)
    known = queries.join(worst.select(F.col("query_id").alias("vec_id"), "qh", "worst"), ["vec_id", "qh"], "left")
    rest = known.withColumn("part", upto(parts)).where("part > 0")
    return first.union(_searched(copied(vectors.where("part > 0")), rest, k))


def scaled(embeddings: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors whose components are all present and finite."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    good = embeddings.where(x.isNotNull() & fine)
    return good.select("vec_id", F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))
