"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation (minimum neighbour of each node, combined on the map side) and a join of the edges with
these minima, which adaptive execution splits where a node has many neighbours; no task holds a component.  The edges
of each round are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> node, root: the smallest node reachable, for every node that can reach a smaller one.

    Null ends, loops and repeated edges are ignored; an empty table gives no rows.
    """
    u, v = F.col("u"), F.col("v")
    e = stage(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("u", "v").unionByName(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where(v > u).join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        # the edge of a node to its own minimum stays
        large = large.unionByName(least.where(u != F.col("m")).select("u", F.col("m").alias("v"))).distinct()
        large = stage(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        new = stage(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large)
        discard(e)
        e, before, seen = new, seen, mark(new)
        if before == seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(u.alias("node"), v.alias("root"))
