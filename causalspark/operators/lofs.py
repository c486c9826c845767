"""Directions from non-Gaussian data: pairwise rules on aggregates, and orientation of a pattern's edges."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.special import digamma
from .graph import ARROW, TAIL, Graph
from .independence import Test
from .statistics import skew_directions, spacing_entropy

RULES = ("skew", "rskew", "tanh")


def pairwise_directions(df: DataFrame, cols: list[str], rule: str = "rskew") -> dict[tuple[str, str], float]:
    """{(a, b): strength} with a positive strength for a --> b, for all pairs from one aggregation."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    out = {}
    for r in skew_directions(df, cols).collect():  # a row for each pair of columns
        v = float(r[rule])
        out[(r["var_i"], r["var_j"]) if v > 0 else (r["var_j"], r["var_i"])] = abs(v)
    return out


def orient(graph: Graph, df: DataFrame, rule: str = "rskew", only_undirected: bool = True) -> Graph:
    """The graph with its (undirected) edges pointed by a pairwise rule."""
    g = graph.copy()
    known = pairwise_directions(df, g.nodes, rule)
    for a, b, _, _ in g.edges():
        if not only_undirected or g.undirected(a, b):
            x, y = (a, b) if (a, b) in known else (b, a)
            g.set_mark(x, y, ARROW)
            g.set_mark(y, x, TAIL)
    return g


def igci(df: DataFrame, x: str, y: str) -> float:
    """Difference of spacing entropies h(y) - h(x) of the standardised columns; negative speaks for x --> y."""
    n = df.select(x, y).dropna().count()
    h = {r["var"]: r["s"] + digamma(n) - digamma(1) for r in spacing_entropy(df, [x, y]).collect()}
    return h[y] - h[x]


def skeleton_fdr(test: Test, depth: int = -1, q: float = 0.05) -> Graph:
    """A stable skeleton whose edges' largest p-values pass a false-discovery bound at q.

    An edge's p-value is the largest of the tests made for it while its ends were adjacent.
    """
    g = Graph.complete(test.variables)
    top = {frozenset(p): 0.0 for p in combinations(test.variables, 2)}
    d = 0
    while depth < 0 or d <= depth:
        adj = {v: g.adj(v) for v in g.nodes}
        if all(len(a) - 1 < d for a in adj.values()):
            break
        for x in g.nodes:
            for y in adj[x]:
                for z in combinations([v for v in adj[x] if v != y], d):
                    top[frozenset((x, y))] = max(top[frozenset((x, y))], test.p_value(x, y, z))
        ordered = sorted(top.values())
        m = len(ordered)
        bound = max((p for k, p in enumerate(ordered, 1) if p <= q * k / m), default=-1.0)
        for pair, p in top.items():
            a, b = sorted(pair)
            if p > bound and g.adjacent(a, b):
                g.remove_edge(a, b)
        d += 1
    return g


def total_strength(stats, order: list[str]) -> np.ndarray:
    """Coefficients b[i, j] of earlier variables in later ones, by regressions in a causal order."""
    k = len(order)
    out = np.zeros((k, k))
    for i in range(1, k):
        out[i, :i] = stats.regress(order[i], order[:i])[0]
    return out
