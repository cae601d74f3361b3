"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of ``edges (a long, b long)`` with the smallest node each can reach.

    Alternates large-star and small-star rounds until the edges no longer change;
    every edge then points at its component's smallest node. Each round is two
    aggregations with map-side combination and two joins, which AQE splits when a
    star is large; the edges are written to the shared folder after each round, so
    neither the driver nor a task ever holds a component. Nulls, loops and repeated
    edges are ignored; an empty input gives an empty result. Returns
    ``(node long, component long)`` for nodes that have an edge to another node.
    """
    u, v = F.col("u"), F.col("v")
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = materialise(pairs.where("u > v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = pairs.unionAll(pairs.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u, F.col("m").alias("v")))).alias("e"))
        old, pairs = pairs, materialise(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        discard(old)
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return pairs.select(u.alias("node"), v.alias("component")).unionAll(pairs.select(v.alias("node"), v.alias("component")).distinct())
        before = after
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
