"""Linear models with latent variables, fitted to the covariances that one pass over the rows gives.

`fit_latent_sem` estimates the coefficients and error variances of a graph with latent nodes by
expectation-maximisation. `fit_clusters` fits a measurement model of clusters, one latent each, by
minimising the discrepancy of covariances along its gradient; `latent_structure` searches the
graph of the latents with the covariances found. Nothing goes back to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.special import chi2_sf
from ..plans.suffstats import SuffStats
from .graph import Graph
from .independence import FisherZ, Test
from .search import cpc


def discrepancy(sample: np.ndarray, implied: np.ndarray) -> float:
    """ln|implied| - ln|sample| + tr(sample implied^-1) - p; infinite where implied is not positive definite."""
    sign, log_det = np.linalg.slogdet(implied)
    if sign <= 0:
        return math.inf
    return float(log_det - np.linalg.slogdet(sample)[1] + np.trace(np.linalg.solve(implied, sample)) - len(sample))


@dataclass
class LatentFit:
    """Coefficients, error variances, covariances that they imply (of all nodes, in the graph's order), and the fit to the measured ones."""

    graph: Graph
    edges: dict[tuple[str, str], float]
    variances: dict[str, float]
    implied: np.ndarray
    chi2: float
    df: int
    p: float
    converged: bool
    rounds: int

    def to_df(self, spark):
        rows = [(a, b, "coefficient", c) for (a, b), c in self.edges.items()] + [(v, v, "error", x) for v, x in self.variances.items()]
        return spark.createDataFrame(rows, "src string, dst string, kind string, value double")


def fit_latent_sem(stats: SuffStats, graph: Graph, fixed: dict[tuple[str, str], float] | None = None, rounds: int = 20_000, tolerance: float = 1e-12, seed: int = 0, starts: int = 1) -> LatentFit:
    """A DAG with latent nodes and independent errors.

    fixed: coefficients that stay; where none of a latent's is fixed, that of its first measured
    child is 1, which sets its scale. Each of so many starts from seeded coefficients runs until
    the discrepancy falls by less than the tolerance; the best is kept, and `converged` tells
    whether it did within the rounds.
    """
    names = graph.nodes
    at = {v: k for k, v in enumerate(names)}
    seen, hidden = [at[v] for v in names if v not in graph.latent], [at[v] for v in names if v in graph.latent]
    s = stats.select([names[k] for k in seen]).cov
    fixed = dict(fixed or {})
    for v in names:
        if v in graph.latent and not any(a == v for a, _ in fixed):
            child = next((c for c in graph.children(v) if c not in graph.latent), None)
            if child is not None:
                fixed[v, child] = 1.0
    parents = {v: [p for p in graph.parents(v)] for v in names}
    free = {v: [p for p in parents[v] if (p, v) not in fixed] for v in names}

    def implied(b: np.ndarray, errors: np.ndarray) -> np.ndarray:
        total = np.linalg.inv(np.eye(len(names)) - b)
        return total @ np.diag(errors) @ total.T

    def run(start: int) -> tuple[float, np.ndarray, np.ndarray, bool, int]:
        r = np.random.default_rng([seed, start])
        b, errors = np.zeros((len(names), len(names))), np.ones(len(names))
        errors[seen] = 0.5 * np.diag(s)
        scale = {v: math.sqrt(s[k, k]) for k, v in enumerate([names[k] for k in seen])}
        for v in names:
            for p in parents[v]:
                b[at[v], at[p]] = fixed.get((p, v), (0.3 + 0.4 * r.random()) * scale.get(v, 1.0))
        before = math.inf
        for k in range(rounds):
            sigma = implied(b, errors)
            value = discrepancy(s, sigma[np.ix_(seen, seen)])
            if before - value <= tolerance * max(abs(value), 1e-3) and k > 10:
                return value, b, errors, True, k
            before = value
            full = np.empty_like(sigma)
            full[np.ix_(seen, seen)] = s
            if hidden:
                cross = sigma[np.ix_(seen, hidden)]
                weight = np.linalg.solve(sigma[np.ix_(seen, seen)], cross)
                full[np.ix_(seen, hidden)] = s @ weight
                full[np.ix_(hidden, seen)] = full[np.ix_(seen, hidden)].T
                full[np.ix_(hidden, hidden)] = sigma[np.ix_(hidden, hidden)] - cross.T @ weight + weight.T @ s @ weight
            for v in names:
                i = at[v]
                row = np.zeros(len(names))
                for p in parents[v]:
                    row[at[p]] = fixed.get((p, v), 0.0)
                if free[v]:
                    j = [at[p] for p in free[v]]
                    row[j] = np.linalg.solve(full[np.ix_(j, j)], full[j, i] - full[j] @ row)
                b[i] = row
                errors[i] = max(full[i, i] - 2 * row @ full[:, i] + row @ full @ row, 1e-10)
        return before, b, errors, False, rounds

    value, b, errors, converged, k = min((run(start) for start in range(starts)), key=lambda x: x[0])
    m = len(seen)
    df = m * (m + 1) // 2 - sum(map(len, free.values())) - len(names)
    chi2 = (stats.n - 1) * value
    edges = {(p, v): float(b[at[v], at[p]]) for v in names for p in parents[v]}
    variances = {v: float(errors[at[v]]) for v in names}
    return LatentFit(graph, edges, variances, implied(b, errors), chi2, df, chi2_sf(max(chi2, 0.0), df) if df > 0 else float("nan"), converged, k)


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 2000, tolerance: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """(point, value, whether the gradient vanished) by quasi-Newton steps with halved lengths; f gives value and gradient."""
    value, slope = f(x)
    inverse, fresh = np.eye(len(x)), True
    for _ in range(rounds):
        if np.abs(slope).max(initial=0.0) < tolerance * (1 + abs(value)):
            return x, value, True
        step = -inverse @ slope
        if step @ slope >= 0:
            inverse, step = np.eye(len(x)), -slope
        length = 1.0
        while length > 1e-12:
            new_value, new_slope = f(x + length * step)
            if new_value <= value + 1e-4 * length * (step @ slope):
                break
            length /= 2
        else:
            if fresh:
                return x, value, bool(np.abs(slope).max() < 1e-5 * (1 + abs(value)))
            inverse, fresh = np.eye(len(x)), True
            continue
        fresh = False
        d, g = length * step, new_slope - slope
        x, value, slope = x + d, new_value, new_slope
        if d @ g > 1e-14:
            rho = 1 / (d @ g)
            left = np.eye(len(x)) - rho * np.outer(d, g)
            inverse = left @ inverse @ left.T + rho * np.outer(d, d)
    return x, value, False


@dataclass
class ClusterFit:
    """Loadings and error variances of indicators, and the correlations of their latents (unit variances)."""

    latents: SuffStats
    loadings: dict[str, float]
    errors: dict[str, float]
    chi2: float
    df: int
    p: float
    converged: bool


def fit_clusters(stats: SuffStats, clusters: list[list[str]], names: list[str] | None = None) -> ClusterFit:
    """Each cluster measures one latent; latents may be correlated in any way. Signs: a cluster's first loading is positive."""
    names = names or [f"L{k}" for k in range(1, len(clusters) + 1)]
    seen = [v for c in clusters for v in c]
    s = stats.select(seen).cov
    spread = np.sqrt(np.diag(s))
    s = s / np.outer(spread, spread)
    m, q = len(seen), len(clusters)
    of = np.repeat(np.arange(q), [len(c) for c in clusters])
    upper = np.triu_indices(q, 1)
    base = np.linalg.slogdet(s)[1]

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        load = np.zeros((m, q))
        load[np.arange(m), of] = x[:m]
        phi = np.eye(q)
        phi[upper] = x[2 * m :]
        phi.T[upper] = x[2 * m :]
        return load, phi, np.exp(x[m : 2 * m])

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        load, phi, errors = parts(x)
        if np.linalg.eigvalsh(phi)[0] <= 1e-8:
            return math.inf, np.zeros_like(x)
        sigma = load @ phi @ load.T + np.diag(errors)
        inverse = np.linalg.inv(sigma)
        value = float(np.linalg.slogdet(sigma)[1] - base + np.trace(inverse @ s) - m)
        g = inverse - inverse @ s @ inverse
        by_load = (2 * g @ load @ phi)[np.arange(m), of]
        return value, np.concatenate((by_load, np.diag(g) * errors, 2 * (load.T @ g @ load)[upper]))

    signs = np.ones(m)
    for k in range(q):
        inside = np.flatnonzero(of == k)
        signs[inside] = np.where(s[inside[0], inside] < 0, -1.0, 1.0)
    start = np.concatenate((0.7 * signs, np.full(m, math.log(0.5)), np.zeros(len(upper[0]))))
    x, value, converged = minimised(objective, start)
    load, phi, errors = parts(x)
    flip = np.sign([load[np.flatnonzero(of == k)[0], k] for k in range(q)])
    phi = phi * np.outer(flip, flip)
    df = m * (m + 1) // 2 - len(start)
    chi2 = (stats.n - 1) * value
    return ClusterFit(
        SuffStats(names, stats.n, phi, np.zeros(q)),
        {v: float(load[k, of[k]] * flip[of[k]] * spread[k]) for k, v in enumerate(seen)},
        {v: float(errors[k] * spread[k] ** 2) for k, v in enumerate(seen)},
        chi2, df, chi2_sf(max(chi2, 0.0), df) if df > 0 else float("nan"), converged,
    )


def latent_structure(
    stats: SuffStats, clusters: list[list[str]], names: list[str] | None = None, alpha: float = 0.001, smallest: int = 3, search: Callable[[Test], Graph] = cpc
) -> tuple[Graph, ClusterFit]:
    """(graph of latents with their indicators, the measurement model it rests on).

    Clusters of fewer than `smallest` variables are left out, with their names. The search gets
    a test on the latents' correlations as if they had been seen in all rows.
    """
    names = names or [f"L{k}" for k in range(1, len(clusters) + 1)]
    large = [(n, c) for n, c in zip(names, clusters, strict=True) if len(c) >= smallest]
    fit = fit_clusters(stats, [c for _, c in large], [n for n, _ in large])
    g = search(FisherZ(fit.latents, alpha))
    g.latent |= set(fit.latents.names)
    for n, c in large:
        for v in c:
            g.add_edge(n, v)
    return g, fit
