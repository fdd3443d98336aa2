"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

#: Edges up to which a table of nodes (two longs each) is broadcast: 8 MB; beyond it nodes are joined.
BROADCAST_EDGES = 250_000


def components(edges: DataFrame) -> Stored:
    """(node, component): the smallest node reachable; only nodes with an edge to another appear.

    ``edges``: (u, v). Each round hangs the larger neighbours of every node on
    its smallest one, then the smaller ones; rounds grow with the logarithm of
    the paths.  Both steps are a least-value aggregate, which combines before
    the shuffle, and a join: with few nodes a broadcast, else between two plain
    tables, so that adaptive execution splits the edges of a hot node.
    """
    now = Stored(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    mark = _mark(now.df)
    while True:
        few, used = mark[0] <= BROADCAST_EDGES, []

        def least(d: DataFrame, few: bool = few, used: list[Stored] = used) -> DataFrame:
            if few:
                return F.broadcast(d)
            used.append(Stored(d))
            return used[-1].df

        both = now.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.df.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        roots = least(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(roots, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        if not few:
            used.append(Stored(large))
            large = used[-1].df
        roots = least(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(roots, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        new = Stored(small.where("hi <> lo").distinct())
        for done in (now, *used):
            done.drop()
        last, mark, now = mark, _mark(new.df), new
        if mark == last:
            stars = now.df.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            out = Stored(stars.union(now.df.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()))
            now.drop()
            return out


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.sum((h % 1000003).cast("long"))).first())
