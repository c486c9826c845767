"""Structural equations of any form, fitted by maximum likelihood without derivatives.

An equation is a formula of the calculator over a node's causes, parameters and an additive error
with a distribution of its own. The mean log-likelihood of many parameter vectors is one
aggregation: each vector is a column that Spark compiles, and one row of numbers comes back. A
round takes two: one for the values around the present point, from which slopes and curvatures
follow by differences, and one for steps of several lengths.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calculator import compile_expression, parse
from .graph import Graph
from .kernel import anderson_darling_normal

_ERROR = re.compile(r"\s*([A-Za-z]+)\s*\(([^()]*)\)\s*")


def _log_density(name: str, e: Column, a: list[Column]) -> Column | None:
    """Log-density of an error under a distribution with these parameters; null outside its range."""
    match name, len(a):
        case "Normal", 2:
            return -0.5 * ((e - a[0]) / a[1]) ** 2 - F.log(a[1]) - 0.5 * math.log(2 * math.pi)
        case "Laplace", 2:
            return -F.abs(e - a[0]) / a[1] - F.log(2 * a[1])
        case "Logistic", 2:
            z = F.abs(e - a[0]) / a[1]
            return -z - 2 * F.log(1 + F.exp(-z)) - F.log(a[1])
        case "Exponential", 1:
            return F.when(e >= 0, F.log(a[0]) - a[0] * e)
        case "Uniform", 2:
            return F.when((e >= a[0]) & (e <= a[1]), -F.log(a[1] - a[0]))
    return None


def _names(tree: tuple) -> set[str]:
    if tree[0] == "var":
        return {tree[1]}
    return set().union(*map(_names, tree[2])) if tree[0] == "call" else set()


@dataclass
class Equation:
    """node = formula + error; parameters of both with starting values; all other names of the formula are causes."""

    node: str
    formula: str
    error: str
    start: dict[str, float]
    causes: list[str] = field(init=False)

    def __post_init__(self) -> None:
        m = _ERROR.fullmatch(self.error)
        if not m:
            raise ValueError(f"an error is a distribution such as Normal(0, s), not {self.error!r}")
        self.kind, self.terms = m[1], [t.strip() for t in m[2].split(",")]
        names = _names(parse(self.formula))
        self.causes = sorted(names - set(self.start))
        unknown = set().union(*(_names(parse(t)) for t in self.terms)) - set(self.start)
        if unknown:
            raise ValueError(f"parameters without a starting value: {sorted(unknown)}")

    def _with(self, text: str, values: dict[str, float]) -> Column:
        for name, x in values.items():
            text = re.sub(rf"(?<![\w.]){re.escape(name)}(?![\w.(])", f"({float(x)!r})", text)
        return compile_expression(text)

    def residual(self, values: dict[str, float]) -> Column:
        return F.col(f"`{self.node}`").cast("double") - self._with(self.formula, values)

    def log_likelihood(self, values: dict[str, float]) -> Column:
        """Of a row; null where the parameters or the error are out of range."""
        out = _log_density(self.kind, self.residual(values), [self._with(t, values) for t in self.terms])
        if out is None:
            raise ValueError(f"no density of {self.error}")
        return out


@dataclass
class EquationFit:
    equation: Equation
    values: dict[str, float]
    log_likelihood: float  # mean over the rows
    rows: int
    converged: bool
    rounds: int


def mean_log_likelihoods(df: DataFrame, equation: Equation, points: list[dict[str, float]]) -> tuple[list[float], int]:
    """(the mean over the rows for each point, -inf where a row is impossible; rows), in one aggregation."""
    cells = [equation.log_likelihood(p) for p in points]
    good = [F.when(c.isNotNull() & ~F.isnan(c), c) for c in cells]
    r = df.agg(F.count("*").alias("n"), *[F.struct(F.count(g).alias("n"), F.avg(g).alias("m")).alias(f"p{k}") for k, g in enumerate(good)]).first()
    return [r[f"p{k}"]["m"] if r["n"] and r[f"p{k}"]["n"] == r["n"] and math.isfinite(r[f"p{k}"]["m"]) else -math.inf for k in range(len(points))], r["n"]


def fit_equation(df: DataFrame, equation: Equation, rounds: int = 40, tolerance: float = 1e-9) -> EquationFit:
    """The most likely parameters from the starting values on, over rows that have the node and its causes.

    `converged` tells whether no step gained more than the tolerance in the mean log-likelihood,
    at the finest differences, within so many rounds.
    """
    rows = df.select(equation.node, *equation.causes).dropna()
    names = list(equation.start)
    x = np.array([equation.start[v] for v in names], dtype=np.float64)
    d, width, converged = len(names), 0.03, False
    named = lambda p: dict(zip(names, map(float, p), strict=True))
    best, n = mean_log_likelihoods(rows, equation, [named(x)])
    best = best[0]
    if not math.isfinite(best):
        raise ValueError("the starting values make some row impossible")
    for k in range(rounds):
        h = width * np.maximum(np.abs(x), 0.1)
        unit = np.diag(h)
        points = [x, *(x + u for u in unit), *(x - u for u in unit), *(x + unit[i] + unit[j] for i, j in combinations(range(d), 2))]
        f, _ = mean_log_likelihoods(rows, equation, [named(p) for p in points])
        f = -np.array(f)
        up, down, cross = f[1 : d + 1], f[d + 1 : 2 * d + 1], f[2 * d + 1 :]
        steps = []
        if np.isfinite(f).all():
            slope = (up - down) / (2 * h)
            bend = np.diag((up - 2 * f[0] + down) / h**2)
            for c, (i, j) in zip(cross, combinations(range(d), 2), strict=True):
                bend[i, j] = bend[j, i] = (c - up[i] - up[j] + f[0]) / (h[i] * h[j])
            values, vectors = np.linalg.eigh(bend)
            values = np.maximum(np.abs(values), 1e-8 * max(np.abs(values).max(initial=0), 1e-8))
            newton = -vectors @ ((vectors.T @ slope) / values)
            steps = [t * newton for t in (1.0, 0.5, 0.2, 0.05, 0.01, 2.0)]
            steps += [-t * h * np.sign(slope) for t in (1.0, 5.0)]
        seen = [p for p, v in zip(points, f, strict=True) if math.isfinite(v)]
        trial = [x + s for s in steps if np.isfinite(s).all()]
        g = mean_log_likelihoods(rows, equation, [named(p) for p in trial])[0] if trial else []
        top = max([(v, -i) for i, v in enumerate([-v for v in f if math.isfinite(v)] + g)])
        gain, x = top[0] - best, (seen + trial)[-top[1]]
        best = max(best, top[0])
        if gain < tolerance:
            if width <= 1e-3:
                converged = True
                break
            width /= 6
    return EquationFit(equation, named(x), best, n, converged, k + 1)


@dataclass
class GeneralizedFit:
    graph: Graph
    fits: dict[str, EquationFit]

    def to_df(self, spark) -> DataFrame:
        """(node, parameter, value)."""
        return spark.createDataFrame([(v, p, x) for v, f in self.fits.items() for p, x in f.values.items()], "node string, parameter string, value double")

    def normality(self, df: DataFrame, node: str) -> tuple[float, float]:
        """(Anderson-Darling statistic of the residuals, p-value) for a node with normal errors."""
        return anderson_darling_normal(df.select(self.fits[node].equation.residual(self.fits[node].values).alias("residual")), "residual")


def fit_equations(df: DataFrame, equations: list[Equation]) -> GeneralizedFit:
    """All equations of an acyclic system; errors do not depend on each other, so each is fitted for itself."""
    g = Graph()
    for e in equations:
        g.add_node(e.node)
        for c in e.causes:
            g.add_node(c)
            if g.adjacent(c, e.node) or c == e.node:
                raise ValueError("the equations have a cycle")
            g.add_edge(c, e.node)
    if g.has_directed_cycle():
        raise ValueError("the equations have a cycle")
    return GeneralizedFit(g, {e.node: fit_equation(df, e) for e in equations})
