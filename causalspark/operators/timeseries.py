"""Searches and models of time series: lagged variables `X`, `X:1`, `X:2`, earlier ones in earlier tiers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from ..plans.suffstats import SuffStats, sufficient_stats
from .graph import Graph
from .independence import FisherZ
from .knowledge import Knowledge
from .scores import SemBic
from .search import fci, fges, gfci, pc
from .transforms import lagged


def lag_stats(df: DataFrame, cols: list[str], order: str, lags: int, by: list[str] | None = None) -> SuffStats:
    """Statistics of all columns at lags 0..lags from one windowed pass."""
    wide = lagged(df, cols, order, lags, by)
    names = {f"{c}_lag{k}": f"{c}:{k}" for k in range(1, lags + 1) for c in cols}
    s = sufficient_stats(wide, [*cols, *names])
    return SuffStats([*cols, *names.values()], s.n, s.cov, s.means)


def lag_knowledge(cols: list[str], lags: int) -> Knowledge:
    return Knowledge([[f"{c}:{k}" for c in cols] for k in range(lags, 0, -1)] + [list(cols)])


def _place(v: str) -> tuple[str, int]:
    name, _, k = v.partition(":")
    return name, int(k or 0)


def repeat_edges(g: Graph, lags: int) -> Graph:
    """Every edge copied to all times at which both ends exist; earlier copies follow the latest one."""
    out = Graph(g.nodes)
    at = lambda name, k: f"{name}:{k}" if k else name
    for a, b, x, y in g.edges():
        (u, i), (v, j) = _place(a), _place(b)
        if min(i, j) == 0:
            for s in range(lags - max(i, j) + 1):
                out.add_edge(at(u, i + s), at(v, j + s), x, y)
    return out


def ts_search(df: DataFrame, cols: list[str], order: str, lags: int, method: str = "pc", alpha: float = 0.05, by: list[str] | None = None) -> Graph:
    """A graph over lagged variables by pc, fci, gfci or fges, homogeneous over time."""
    s, k = lag_stats(df, cols, order, lags, by), lag_knowledge(cols, lags)
    match method:
        case "pc":
            g = pc(FisherZ(s, alpha), knowledge=k)
        case "fci":
            g = fci(FisherZ(s, alpha), knowledge=k)
        case "gfci":
            g = gfci(FisherZ(s, alpha), SemBic(s), knowledge=k)
        case "fges":
            g = fges(SemBic(s), k)
        case _:
            raise ValueError(f"unknown method {method}")
    return repeat_edges(g, lags)


def var_model(df: DataFrame, cols: list[str], order: str, lags: int, by: list[str] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(coefficient matrices of lags 1.., residual covariance) of a vector autoregression."""
    s = lag_stats(df, cols, order, lags, by)
    p = len(cols)
    a = np.linalg.solve(s.cov[p:, p:], s.cov[p:, :p]).T
    return [a[:, k * p : (k + 1) * p] for k in range(lags)], s.cov[:p, :p] - a @ s.cov[p:, :p]


def granger(df: DataFrame, x: str, y: str, order: str, lags: int, by: list[str] | None = None) -> float:
    """p-value of x's lags in y's autoregression, by the likelihood ratio."""
    s = lag_stats(df, [x, y], order, lags, by)
    own = [f"{y}:{k}" for k in range(1, lags + 1)]
    both = own + [f"{x}:{k}" for k in range(1, lags + 1)]
    small, big = s.regress(y, own)[1], s.regress(y, both)[1]
    return chi2_sf(s.n * math.log(small / big), lags)


def best_shifts(df: DataFrame, cols: list[str], order: str, most: int) -> dict[str, int]:
    """For each column the shift (0..most, one at a time) that gives the best total score of a search."""
    from .graph import dag_from_pattern

    s = lag_stats(df, cols, order, most)
    shift = dict.fromkeys(cols, 0)

    def value(choice: dict[str, int]) -> float:
        names = [f"{c}:{k}" if k else c for c, k in choice.items()]
        score = SemBic(s.select(names))
        return score.graph(dag_from_pattern(fges(score)))

    for c in cols:
        shift[c] = max(range(most + 1), key=lambda k: (value(shift | {c: k}), -k))
    return shift


def autocorrelation(df: DataFrame, col: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """(lag, r)."""
    wide = lagged(df, [col], order, lags, by)
    one = wide.agg(*[F.corr(col, f"{col}_lag{k}").alias(str(k)) for k in range(1, lags + 1)])
    return one.unpivot([], [str(k) for k in range(1, lags + 1)], "lag", "r").withColumn("lag", F.col("lag").cast("int"))
