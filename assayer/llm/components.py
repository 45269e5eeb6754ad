"""Connected components of an edge table, by alternating large and small stars.

A large star links every larger neighbour of a node to the node's smallest one; a small star links smaller ones to
it. Both keep the components and make every tree a star after few rounds. A round is two grouped minima, which
combine before their shuffle, and two joins, whose busy sides the runtime can split, so a hub needs no task of its
own; each round is checkpointed, so no lineage grows and a lost executor repeats one round at most. Edges lie in partitions
that follow their number, so a round over few of them shuffles nothing.

Loops and repeated edges are ignored; null ends are dropped; without edges the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.cutting import narrowed, swept, together

MAX_ROUNDS = 100


def _pair(x: str, y: str, first: str, second: str) -> Column:
    return F.struct(F.col(x).alias(first), F.col(y).alias(second))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component."""
    x, y = F.col(a), F.col(b)
    now = narrowed(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct()
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.select(F.inline(F.array(_pair("hi", "lo", "u", "v"), _pair("lo", "hi", "u", "v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m")
        )
        large = together(
            both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")), now
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("w"), "m")
        small = together(
            large.join(low, F.col("hi") == F.col("w"))
            .select(F.inline(F.array(_pair("lo", "m", "hi", "lo"), _pair("hi", "m", "hi", "lo")))).where("hi != lo"), now
        )
        now = narrowed(small.distinct())
        swept(now.sparkSession)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    named = now.select(F.inline(F.array(_pair("hi", "lo", "node", "component"), _pair("lo", "lo", "node", "component"))))
    named = narrowed(named.distinct())
    del both, least, large, low, small, now
    swept(named.sparkSession)
    return named
