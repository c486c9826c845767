"""Markov blankets by subsets, hybrid and penalised searches, and models of graphs with bidirected edges.

All work on sufficient statistics or on tests and scores that are made of these, so rows are
read once, in Spark, whatever the number of steps.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

from ..plans.suffstats import SuffStats
from .graph import Graph, cpdag
from .independence import Test
from .scores import Score


def inter_iamb(test: Test, target: str) -> list[str]:
    """Grow by the strongest remaining dependence, and shrink after each step; a set that comes back ends it."""
    blanket: list[str] = []
    seen = set()
    while frozenset(blanket) not in seen:
        seen.add(frozenset(blanket))
        rest = [v for v in test.variables if v != target and v not in blanket]
        found = [(test.score(target, v, blanket), -k, v) for k, v in enumerate(rest) if not test.independent(target, v, blanket)]
        if not found:
            break
        blanket.append(max(found)[2])
        for v in list(blanket):
            if test.independent(target, v, [u for u in blanket if u != v]):
                blanket.remove(v)
    return sorted(blanket, key=test.variables.index)


def _subsets(items: list[str], depth: int):
    for k in range(min(len(items), depth) + 1):
        yield from combinations(items, k)


def parents_and_children(test: Test, target: str, depth: int = 3, greedy: bool = True) -> list[str]:
    """Variables that no subset (of up to `depth`) of the others found separates from the target.

    greedy: the next one is that whose weakest dependence over all subsets is strongest, and is
    checked against the others at once; else all are added first, by their plain dependence. Each
    must have the target among its own, too.
    """

    def one_way(t: str) -> list[str]:
        chosen: list[str] = []
        out = set()
        while True:
            best = None
            for v in (u for u in test.variables if u != t and u not in chosen and u not in out):
                weakest = math.inf
                for z in _subsets(chosen, depth) if greedy else [()]:
                    if test.independent(t, v, z):
                        out.add(v)
                        break
                    weakest = min(weakest, test.score(t, v, z))
                else:
                    if best is None or weakest > best[0]:
                        best = (weakest, v)
            if best is None:
                break
            chosen.append(best[1])
            if not greedy:  # interleaved elimination
                for v in list(chosen):
                    if any(test.independent(t, v, z) for z in _subsets([u for u in chosen if u != v], depth)):
                        chosen.remove(v)
                        out.add(v)
        return [v for v in chosen if not any(test.independent(t, v, z) for z in _subsets([u for u in chosen if u != v], depth))]

    return [v for v in one_way(target) if target in one_way(v)]


def blanket_by_subsets(test: Test, target: str, depth: int = 3, greedy: bool = True) -> list[str]:
    """Parents, children, and those parents of children that depend on the target given the child."""
    near = parents_and_children(test, target, depth, greedy)
    out = set(near)
    for c in near:
        for s in parents_and_children(test, c, depth, greedy):
            if s == target or s in out:
                continue
            z = next((set(z) for z in _subsets([v for v in test.variables if v not in (s, target, c)], depth) if test.independent(target, s, z)), None)
            if z is not None and not test.independent(target, s, sorted(z | {c})):
                out.add(s)
    return sorted(out, key=test.variables.index)


def hill_climb(score: Score, allowed: set[frozenset[str]], most_steps: int = 10_000) -> Graph:
    """A DAG by single-edge changes (add, remove, turn) among allowed pairs, the best change first, until none gains."""
    parents: dict[str, set[str]] = {v: set() for v in score.variables}

    def reaches(a: str, b: str) -> bool:
        stack, seen = [b], set()
        while stack:
            v = stack.pop()
            if v == a:
                return True
            if v not in seen:
                seen.add(v)
                stack += parents[v]
        return False

    def gain(v: str, new: set[str]) -> float:
        return score.local(v, new) - score.local(v, parents[v])

    for _ in range(most_steps):
        best = (1e-9, None)
        for pair in sorted(map(sorted, allowed)):
            for a, b in (pair, pair[::-1]):
                if a in parents[b]:
                    drop = gain(b, parents[b] - {a})
                    best = max(best, (drop, ("drop", a, b)), key=lambda x: x[0])
                    parents[b].remove(a)
                    free = not reaches(a, b)
                    parents[b].add(a)
                    if free:
                        best = max(best, (drop + gain(a, parents[a] | {b}), ("turn", a, b)), key=lambda x: x[0])
                elif b not in parents[a] and not reaches(b, a):
                    best = max(best, (gain(b, parents[b] | {a}), ("add", a, b)), key=lambda x: x[0])
        if best[1] is None:
            break
        what, a, b = best[1]
        if what != "add":
            parents[b].remove(a)
        if what != "drop":
            (parents[b] if what == "add" else parents[a]).add(a if what == "add" else b)
    g = Graph(score.variables)
    for v, ps in parents.items():
        for p in sorted(ps):
            g.add_edge(p, v)
    return g


def max_min_hill_climb(test: Test, score: Score, depth: int = 3) -> Graph:
    """The pattern of a hill climb among the pairs of parents-and-children sets."""
    allowed = {frozenset((v, u)) for v in test.variables for u in parents_and_children(test, v, depth)}
    return cpdag(hill_climb(score, allowed))


def graphical_lasso(stats: SuffStats, penalty: float, rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, Graph]:
    """(precision, graph of its entries) of the correlations under an L1 penalty, column after column."""
    s = stats.corr
    p = len(s)
    w = s + penalty * np.eye(p)
    coef = np.zeros((p, p))
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            v, target, b = w[np.ix_(rest, rest)], s[rest, j], coef[rest, j]
            for _ in range(1000):
                last = b.copy()
                for i in range(p - 1):
                    r = target[i] - v[i] @ b + v[i, i] * b[i]
                    b[i] = np.sign(r) * max(abs(r) - penalty, 0) / v[i, i]
                if np.abs(b - last).max(initial=0) < tol:
                    break
            coef[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - before).max() < tol:
            break
    else:
        raise RuntimeError(f"the penalised precision matrix did not settle in {rounds} rounds")
    inverse = np.zeros((p, p))
    for j in range(p):
        rest = np.arange(p) != j
        inverse[j, j] = 1 / (w[j, j] - w[rest, j] @ coef[rest, j])
        inverse[rest, j] = -coef[rest, j] * inverse[j, j]
    inverse = (inverse + inverse.T) / 2
    g = Graph(stats.names)
    for i, j in combinations(range(p), 2):
        if abs(inverse[i, j]) > 1e-8:
            g.add_edge(stats.names[i], stats.names[j], "-", "-")
    return inverse, g


def fit_mixed_graph(stats: SuffStats, graph: Graph, rounds: int = 2000, tol: float = 1e-10) -> tuple[dict[tuple[str, str], float], dict[tuple[str, str], float], np.ndarray]:
    """(coefficients, error covariances, implied covariances) of an acyclic graph with bidirected edges.

    Residual iterative conditional fitting: each variable is regressed on its parents and on
    pseudo-variables of the errors that it may share, the others held, until nothing moves.
    """
    s = stats.select(graph.nodes)
    names, p = s.names, len(graph.nodes)
    parents = [[s.index[v] for v in graph.parents(u)] for u in names]
    spouses = [[s.index[v] for v in names if v != u and graph.adjacent(u, v) and graph.bidirected(u, v)] for u in names]
    b, omega = np.zeros((p, p)), np.diag(np.diag(s.cov)).astype(float)
    for _ in range(rounds):
        before = np.concatenate((b.ravel(), omega.ravel()))
        for i in range(p):
            rest = [k for k in range(p) if k != i]
            inv = np.linalg.inv(omega[np.ix_(rest, rest)])
            at = [rest.index(k) for k in spouses[i]]
            pseudo = (inv @ (np.eye(p) - b)[rest])[at]  # linear in the variables
            x = np.concatenate((np.eye(p)[parents[i]], pseudo))
            if len(x):
                coef = np.linalg.lstsq(x @ s.cov @ x.T, x @ s.cov[:, i], rcond=None)[0]
                residual = float(s.cov[i, i] - coef @ (x @ s.cov[:, i]))
            else:
                coef, residual = np.empty(0), float(s.cov[i, i])
            b[i, parents[i]] = coef[: len(parents[i])]
            shared = coef[len(parents[i]) :]
            omega[i, spouses[i]] = omega[spouses[i], i] = shared
            omega[i, i] = residual + float(shared @ inv[np.ix_(at, at)] @ shared)
        if np.abs(np.concatenate((b.ravel(), omega.ravel())) - before).max() < tol:
            break
    else:
        raise RuntimeError(f"the fit did not settle in {rounds} rounds")
    paths = np.linalg.inv(np.eye(p) - b)
    edges = {(names[k], names[i]): float(b[i, k]) for i in range(p) for k in parents[i]}
    errors = {(names[min(i, k)], names[max(i, k)]): float(omega[i, k]) for i in range(p) for k in [*spouses[i], i]}
    return edges, errors, paths @ omega @ paths.T


def two_stage_least_squares(stats: SuffStats, y: str, x: list[str], instruments: list[str]) -> dict[str, float]:
    """Coefficients of x in y, where x may share errors with y and the instruments do not."""
    at = lambda vs: [stats.index[v] for v in vs]
    zz, zx, zy = stats.cov[np.ix_(at(instruments), at(instruments))], stats.cov[np.ix_(at(instruments), at(x))], stats.cov[at(instruments), stats.index[y]]
    first = np.linalg.solve(zz, zx)
    coef = np.linalg.solve(zx.T @ first, first.T @ zy)
    return dict(zip(x, map(float, coef), strict=True))


def standardized_coefficients(stats: SuffStats, edges: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Coefficients as if all variables had deviation 1."""
    sd = np.sqrt(np.diag(stats.cov))
    return {(a, b): c * float(sd[stats.index[a]] / sd[stats.index[b]]) for (a, b), c in edges.items()}


def expected_given(stats: SuffStats, evidence: dict[str, float]) -> dict[str, tuple[float, float]]:
    """(mean, variance) of each other variable of a joint normal distribution, given values of some."""
    known, rest = [stats.index[v] for v in evidence], [k for k, v in enumerate(stats.names) if v not in evidence]
    shift = np.array([evidence[stats.names[k]] for k in known]) - stats.means[known]
    gain = np.linalg.solve(stats.cov[np.ix_(known, known)], stats.cov[np.ix_(known, rest)]).T if known else np.zeros((len(rest), 0))
    mean = stats.means[rest] + gain @ shift
    var = np.diag(stats.cov)[rest] - (gain * stats.cov[np.ix_(rest, known)]).sum(axis=1)
    return {stats.names[k]: (float(m), float(v)) for k, m, v in zip(rest, mean, var, strict=True)}
