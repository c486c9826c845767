"""Mixed graphs as tables (src, dst, ep_src, ep_dst), one row for each edge: changes, checks and comparisons by joins.

Marks are `-` (tail), `>` (arrowhead) and `o` (either). Rows with a null node or mark count as
no edge in checks and comparisons. Empty tables give empty results, and counts of nought.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["src", "dst", "ep_src", "ep_dst"]


def _is(a: str, b: str) -> Column:
    return (F.col("ep_src") == a) & (F.col("ep_dst") == b)


def bidirected(edges: DataFrame) -> DataFrame:
    return edges.where(_is(">", ">"))


def drop_bidirected(edges: DataFrame) -> DataFrame:
    return edges.where(~_is(">", ">"))


def bidirected_to_undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", *[F.when(_is(">", ">"), "-").otherwise(F.col(c)).alias(c) for c in ("ep_src", "ep_dst")])


def undirected_to_bidirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", *[F.when(_is("-", "-"), ">").otherwise(F.col(c)).alias(c) for c in ("ep_src", "ep_dst")])


def unoriented(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit("-").alias("ep_src"), F.lit("-").alias("ep_dst"))


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes replaced by names (old, new); a node without a row there keeps its name."""
    out = edges
    for c in ("src", "dst"):
        n = names.select(F.col("old").alias(c), F.col("new").alias("to"))
        out = out.join(n, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return out.select(COLUMNS)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, at_a, at_b): each edge seen from either end."""
    one = edges.dropna(subset=COLUMNS).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("ep_src").alias("at_a"), F.col("ep_dst").alias("at_b"))
    return one.union(one.select("b", "a", "at_b", "at_a"))


def adjacencies(edges: DataFrame) -> DataFrame:
    """(a, b): adjacent pairs, a before b, each once."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def adjacencies_missing(edges: DataFrame, other: DataFrame) -> DataFrame:
    """(a, b): adjacencies that the other graph does not have."""
    return adjacencies(edges).join(adjacencies(other), ["a", "b"], "left_anti")


def unshielded(edges: DataFrame) -> DataFrame:
    """(a, b, c, collider): a and c adjacent to b but not to each other, a before c."""
    w = both_ways(edges)
    x = w.select("a", "b", F.col("at_b").alias("left"))
    y = w.select(F.col("a").alias("c"), "b", F.col("at_b").alias("right"))
    triples = x.join(y, "b").where("a < c").join(adjacencies(edges).withColumnRenamed("b", "c"), ["a", "c"], "left_anti")
    return triples.select("a", "b", "c", ((F.col("left") == ">") & (F.col("right") == ">")).alias("collider"))


def directed_neighbours(edges: DataFrame) -> DataFrame:
    """(node, all_directed): whether each edge of the node has a tail at one end and an arrowhead at the other."""
    w = both_ways(edges)
    return w.groupBy(F.col("a").alias("node")).agg(F.bool_and(((F.col("at_a") == "-") & (F.col("at_b") == ">")) | ((F.col("at_a") == ">") & (F.col("at_b") == "-"))).alias("all_directed"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b): pairs with a directed edge either way, a before b."""
    d = edges.where(_is("-", ">")).select("src", "dst").union(edges.where(_is(">", "-")).select("dst", "src")).distinct()
    return d.select(F.col("src").alias("a"), F.col("dst").alias("b")).intersect(d.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a < b")


def _kind(src: str, dst: str) -> Column:
    """An edge's form from the pair's first node on: left mark, line, right mark."""
    left = F.when(F.col(src) == ">", "<").otherwise(F.col(src))
    return F.concat(left, F.lit("-"), F.col(dst))


def forms(edges: DataFrame) -> DataFrame:
    """(a, b, form): the edge of each pair, a before b, such as `--->` or `<->` without its middle sign."""
    return both_ways(edges).where("a < b").select("a", "b", _kind("at_a", "at_b").alias("form"))


def pair_forms(edges: DataFrame) -> DataFrame:
    """(a, b, form): one row for each pair, with the forms of all its edges, such as both of a two-cycle, joined by a plus sign."""
    return forms(edges).groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("form")), "+").alias("form"))


def misclassification(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(true_form, estimated_form, n) over pairs that either graph has; `none` where one has no edge."""
    t, e = pair_forms(truth).withColumnRenamed("form", "true_form"), pair_forms(estimate).withColumnRenamed("form", "estimated_form")
    both = t.join(e, ["a", "b"], "full").na.fill("none", ["true_form", "estimated_form"])
    return both.groupBy("true_form", "estimated_form").agg(F.count("*").alias("n"))


def direction_errors(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(n): arrowheads of the estimate, on adjacencies of both, where the truth has none."""
    e = both_ways(estimate).where("at_b = '>'").select("a", "b")
    t = both_ways(truth).select("a", "b", F.col("at_b").alias("true_mark"))
    return e.join(t, ["a", "b"]).agg(F.count_if(F.col("true_mark") != ">").alias("n"))


def hamming(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(shd): pairs whose edges differ in being there or in a mark; repeated edges count once."""
    t, e = pair_forms(truth).withColumnRenamed("form", "t"), pair_forms(estimate).withColumnRenamed("form", "e")
    return t.join(e, ["a", "b"], "full").agg(F.count_if(~F.col("t").eqNullSafe(F.col("e"))).alias("shd"))


def agreement(graphs: list[DataFrame]) -> DataFrame:
    """(a, b, graphs, forms): in how many graphs each adjacency is, and with how many forms."""
    every = reduce(lambda x, y: x.union(y), [forms(g).select("a", "b", "form", F.lit(k).alias("graph")) for k, g in enumerate(graphs)])
    return every.groupBy("a", "b").agg(F.count_distinct("graph").alias("graphs"), F.count_distinct("form").alias("forms"))


def violations(edges: DataFrame) -> DataFrame:
    """(rule, n): edges that break each of the usual constraints on graphs."""
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    one = edges.agg(
        F.count_if(F.col("src") == F.col("dst")).alias("no_edges_to_self"),
        F.count_if(~(_is("-", ">") | _is(">", "-"))).alias("directed_only"),
        F.count_if(~(_is("-", ">") | _is(">", "-") | _is("-", "-"))).alias("directed_or_undirected"),
    ).join(pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("at_most_one_edge")))
    return one.unpivot([], one.columns, "rule", "n")


def cliques(edges: DataFrame, size: int) -> DataFrame:
    """(nodes): sorted arrays of so many nodes, all adjacent; each round joins one node more to the cliques so far."""
    adj = adjacencies(edges)
    out = adj.select(F.array("a", "b").alias("nodes"), F.col("b").alias("last"))
    for _ in range(size - 2):
        step = adj.select(F.col("a").alias("last"), F.col("b").alias("more"))
        grown = out.join(step, "last").select("nodes", "more")
        need = grown.select("nodes", "more", F.explode("nodes").alias("a"))
        whole = need.join(adj.select("a", F.col("b").alias("more")), ["a", "more"]).groupBy("nodes", "more").agg(F.count("*").alias("n"))
        out = whole.where(F.col("n") == F.size("nodes")).select(F.concat("nodes", F.array("more")).alias("nodes"), F.col("more").alias("last"))
    return out.select("nodes")


def maximal(cliques_: DataFrame, edges: DataFrame) -> DataFrame:
    """The cliques (nodes) that no further node is adjacent to all of."""
    w = both_ways(edges).select("a", F.col("b").alias("more")).distinct()
    near = cliques_.select("nodes", F.explode("nodes").alias("a")).join(w, "a").groupBy("nodes", "more").agg(F.count("*").alias("n"))
    open_ = near.where(F.col("n") == F.size("nodes")).select("nodes").distinct()
    return cliques_.join(open_, "nodes", "left_anti")
