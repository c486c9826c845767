"""Pure measurement clusters from vanishing differences of covariance products of four variables, and exploratory factors."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from ..plans.suffstats import SuffStats
from .graph import Graph
from .independence import quartet_differences


def _pure(stats: SuffStats, quad, alpha: float) -> bool:
    return all(p > alpha for _, p in quartet_differences(stats, *quad))


def one_factor_clusters(stats: SuffStats, alpha: float = 0.01) -> list[list[str]]:
    """Sets of four and more variables of which every three are pure.

    A triple is pure if with every other correlated variable its differences vanish; pure triples
    seed clusters that grow by what keeps all triples pure, and the largest come first.
    """
    names = stats.names
    r, bound = np.abs(stats.corr), 2.58 / np.sqrt(max(stats.n, 1))
    linked = lambda vs: all(r[stats.index[a], stats.index[b]] > bound for a, b in combinations(vs, 2))
    whole = {
        frozenset(t)
        for t in combinations(names, 3)
        if linked(t) and all(_pure(stats, (*t, v), alpha) for v in names if v not in t and linked([*t, v]))
    }
    found: list[list[str]] = []
    for triple in sorted(whole, key=lambda t: sorted(map(names.index, t))):
        cluster = sorted(triple, key=names.index)
        for v in names:
            if v not in cluster and all(frozenset((a, b, v)) in whole for a, b in combinations(cluster, 2)):
                cluster.append(v)
        if len(cluster) >= 4:
            found.append(cluster)
    out, used = [], set()
    for c in sorted(found, key=lambda c: (-len(c), [names.index(v) for v in c])):
        if not used & set(c):
            out.append(sorted(c, key=names.index))
            used |= set(c)
    return out


def measurement_graph(clusters: list[list[str]]) -> Graph:
    """Each cluster under a latent node L1, L2, ..."""
    g = Graph()
    for k, c in enumerate(clusters, 1):
        g.add_node(f"L{k}")
        g.latent.add(f"L{k}")
        for v in c:
            g.add_edge(f"L{k}", v)
    return g


def purify(stats: SuffStats, clusters: list[list[str]], alpha: float = 0.01) -> list[list[str]]:
    """Clusters less the variables that spoil most quartets, one after the other, until none fails."""
    out = []
    for c in clusters:
        c = list(c)
        while len(c) >= 4:
            bad = {v: 0 for v in c}
            for q in combinations(c, 4):
                if not _pure(stats, q, alpha):
                    for v in q:
                        bad[v] += 1
            worst = max(c, key=lambda v: (bad[v], -c.index(v)))
            if not bad[worst]:
                break
            c.remove(worst)
        out.append(c)
    return out


def principal_factors(stats: SuffStats, k: int, rounds: int = 100) -> np.ndarray:
    """Loadings (p, k) of iterated principal-axis factors of the correlations."""
    r = stats.corr
    h = 1 - 1 / np.diag(np.linalg.inv(r))
    for _ in range(rounds):
        m = r.copy()
        np.fill_diagonal(m, h)
        values, vectors = np.linalg.eigh(m)
        top = np.argsort(-values)[:k]
        load = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
        new = np.minimum((load**2).sum(axis=1), 0.9999)
        if np.abs(new - h).max() < 1e-8:
            break
        h = new
    return load


def varimax(load: np.ndarray, rounds: int = 200) -> np.ndarray:
    p, k = load.shape
    rot, last = np.eye(k), 0.0
    for _ in range(rounds):
        x = load @ rot
        u, s, v = np.linalg.svd(load.T @ (x**3 - x * (x**2).sum(axis=0) / p))
        rot = u @ v
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    return load @ rot
