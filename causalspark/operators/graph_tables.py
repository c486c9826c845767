"""Graphs as tables of edges (src, dst): closure, degrees, components and comparison by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node): all pairs with a directed path.

    A round joins the pairs found last with all pairs, so that paths double in length, and
    keeps what is new; it ends when nothing is. Nodes on a cycle are their own ancestors.
    """
    pairs = new = written(edges.select(F.col("src").alias("ancestor"), F.col("dst").alias("node")).where("ancestor is not null and node is not null").distinct())
    while new.take(1):
        x = new.select("ancestor", F.col("node").alias("via"))
        y = pairs.select(F.col("ancestor").alias("via"), "node")
        back = pairs.select("ancestor", F.col("node").alias("via")).join(new.select(F.col("ancestor").alias("via"), "node"), "via")
        new = written(x.join(y, "via").select("ancestor", "node").union(back.select("ancestor", "node")).distinct().join(pairs, ["ancestor", "node"], "left_anti"))
        pairs = written(pairs.union(new))
    return pairs


def degrees(edges: DataFrame) -> DataFrame:
    """(node, parents, children)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("p"), F.lit(1).alias("c")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("c").alias("children"), F.sum("p").alias("parents"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected part.

    Each round links a node's larger neighbours to its smallest neighbour, then a node and its
    smaller neighbours to the smallest of these; it ends when links stay as they are, which
    takes a number of rounds like the logarithm of the longest path. Grouped minima and joins
    only: no neighbourhood is gathered.
    """
    named = edges.where("src is not null and dst is not null")
    links = written(named.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    nodes = links.select(F.col("hi").alias("node")).union(links.select("lo")).distinct()
    links = links.where("hi <> lo")
    before = None
    while (now := tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())) != before:
        before = now
        both = links.union(links.select("lo", "hi"))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        wide = both.where("lo > hi").join(least, F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        wide = written(wide.where("hi <> lo").distinct())
        least = wide.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        near = wide.join(least, F.col("hi") == F.col("u")).select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
        links = written(near.where("hi <> lo").distinct())
    named = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def colliders(edges: DataFrame) -> DataFrame:
    """(a, b, child): pairs of parents of a child that are not adjacent."""
    e, f = edges.select(F.col("src").alias("a"), F.col("dst").alias("child")), edges.select(F.col("src").alias("b"), F.col("dst").alias("child"))
    adjacent = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return e.join(f, "child").where("a < b").join(adjacent, ["a", "b"], "left_anti").select("a", "b", "child").distinct()


def _pairs(edges: DataFrame, name: str) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("src").alias(name))


def adjacency_confusion(est: DataFrame, truth: DataFrame) -> DataFrame:
    e, t = _pairs(est, "e").dropDuplicates(["a", "b"]), _pairs(truth, "t").dropDuplicates(["a", "b"])
    return e.join(t, ["a", "b"], "full").agg(
        F.count_if(F.col("e").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("e").isNull()).alias("fn")
    )


def directed_shd(est: DataFrame, truth: DataFrame) -> DataFrame:
    """Distance of two tables of directed edges: 2 for a missing or extra edge, 1 for a reversed one."""
    both = _pairs(est, "e").join(_pairs(truth, "t"), ["a", "b"], "full")
    return both.agg(F.sum(F.when(F.col("e").isNull() | F.col("t").isNull(), 2).when(F.col("e") != F.col("t"), 1).otherwise(0)).alias("shd"))
