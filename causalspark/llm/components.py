"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


EDGES_A_FILE = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge, the smallest node it can reach.

    Alternates large-star and small-star steps on the edge table: each links a node's
    neighbours to the smallest of them. No neighbourhood is gathered: a step is a grouped
    minimum and a join, both of which spread a node with many edges. Ends when a step
    leaves the edges as they were.
    """
    e = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "cc-edges"
    )
    # steps keep or lower the number of edges: as many files as these need, not as shuffles have partitions
    parts = max(8, -(-e.count() // EDGES_A_FILE))
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = materialize(both.groupBy(F.col("hi").alias("u")).agg(F.least(F.min("lo"), F.first("hi")).alias("m")), "cc-min", parts)
        large = both.where("lo > hi").join(least, F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.where("hi <> lo").distinct(), "cc-large", parts)
        least = materialize(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "cc-min", parts)
        small = large.join(least, F.col("hi") == F.col("u")).select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
        e = materialize(small.where("hi <> lo").distinct(), "cc-small", parts)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
