"""Decomposable scores: `local(y, parents)`, higher is better, on statistics of one pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.suffstats import SuffStats, sufficient_stats
from .graph import Graph
from .independence import _Discrete


class Score:
    variables: list[str]

    def __init__(self) -> None:
        self._memo: dict = {}

    def local(self, y: str, parents) -> float:
        key = (y, frozenset(parents))
        if key not in self._memo:
            self._memo[key] = self._local(y, sorted(parents))
        return self._memo[key]

    def diff(self, x: str, y: str, parents) -> float:
        """What the edge x --> y adds to y's score given other parents."""
        return self.local(y, {*parents, x}) - self.local(y, parents)

    def graph(self, dag: Graph) -> float:
        return sum(self.local(v, dag.parents(v)) for v in dag.nodes)


class SemBic(Score):
    """Gaussian BIC: -n ln(s2 n / (n - k)) - c k ln n with k = 2 p + 1; NaN for no residual variance."""

    def __init__(self, data: DataFrame | SuffStats, penalty: float = 1.0) -> None:
        super().__init__()
        self.stats = data if isinstance(data, SuffStats) else sufficient_stats(data)
        self.variables, self.penalty = self.stats.names, penalty

    def _local(self, y, parents):
        try:
            _, s2 = self.stats.regress(y, parents)
        except np.linalg.LinAlgError:
            return float("nan")
        n, k = self.stats.n, 2 * len(parents) + 1
        if s2 <= 0 or n <= k:
            return float("nan")
        return -n * math.log(s2 * n / (n - k)) - self.penalty * k * math.log(n)


class Images(Score):
    """Mean of the scores of several data sets."""

    def __init__(self, scores: list[Score]) -> None:
        super().__init__()
        self.scores, self.variables = scores, scores[0].variables

    def _local(self, y, parents):
        values = [v for v in (s.local(y, parents) for s in self.scores) if not math.isnan(v)]
        return sum(values) / len(values) if values else float("nan")


class _Counts(Score):
    def __init__(self, data: DataFrame | _Discrete, cols: list[str] | None = None) -> None:
        super().__init__()
        self.counts = data if isinstance(data, _Discrete) else _Discrete(data, cols)
        self.variables = self.counts.variables

    def cells(self, y: str, parents: list[str]) -> tuple[dict[tuple, dict], int, int]:
        """(counts by parent values, categories of y, number of parent configurations)."""
        out: dict[tuple, dict] = {}
        for key, n in self.counts.counts((y, *parents)).items():
            out.setdefault(key[1:], {})[key[0]] = n
        return out, len(self.counts.counts((y,))), math.prod(len(self.counts.counts((p,))) for p in parents)


class DiscreteBic(_Counts):
    """2 ln L - c r (k - 1) ln n."""

    def __init__(self, data, cols=None, penalty: float = 1.0) -> None:
        super().__init__(data, cols)
        self.penalty = penalty

    def _local(self, y, parents):
        cells, k, r = self.cells(y, parents)
        fit = sum(n * math.log(n / sum(row.values())) for row in cells.values() for n in row.values())
        n = sum(sum(row.values()) for row in cells.values())
        return 2 * fit - self.penalty * r * (k - 1) * math.log(n)


class BDeu(_Counts):
    """Dirichlet marginal likelihood with prior sample / (k r) in a cell, and a prior on the number of parents."""

    def __init__(self, data, cols=None, sample: float = 1.0, structure: float = 1.0) -> None:
        super().__init__(data, cols)
        self.sample, self.structure = sample, structure

    def _prior(self, k: int, r: int) -> float:
        return self.sample / (k * r)

    def _local(self, y, parents):
        cells, k, r = self.cells(y, parents)
        a = self._prior(k, r)
        out = 0.0
        for row in cells.values():
            out += math.lgamma(k * a) - math.lgamma(k * a + sum(row.values()))
            out += sum(math.lgamma(a + n) - math.lgamma(a) for n in row.values())
        e, m = self.structure, len(self.variables) - 1
        if e > 0 and m > 0:
            p = min(e / m, 1 - 1e-12)
            out += len(parents) * math.log(p) + (m - len(parents)) * math.log(1 - p)
        return out


class BDe(BDeu):
    """Dirichlet marginal likelihood with one pseudo-count in each cell and no structure prior."""

    def __init__(self, data, cols=None) -> None:
        super().__init__(data, cols, 1.0, 0.0)

    def _prior(self, k, r):
        return 1.0


class DSeparationScore(Score):
    """The oracle of a known DAG: an edge gains if its ends are d-connected given the other parents."""

    def __init__(self, dag: Graph) -> None:
        super().__init__()
        self.dag = dag
        self.variables = [v for v in dag.nodes if v not in dag.latent]

    def diff(self, x, y, parents):
        return -1.0 if self.dag.d_separated(x, y, parents) else 1.0

    def _local(self, y, parents):
        raise TypeError("the oracle only knows differences")


class ConditionalGaussian(Score):
    """Mixed likelihood: joint of child and parents less that of the parents, by discrete cells.

    One aggregation for each variable set gives every cell's count, means and products. A cell
    with k + 5 rows or fewer borrows the covariance of all rows.
    """

    def __init__(self, df: DataFrame, discrete: list[str], continuous: list[str], penalty: float = 1.0) -> None:
        super().__init__()
        self.variables, self.penalty = [*discrete, *continuous], penalty
        self._df, self.discrete, self.continuous = df.select(*self.variables).dropna(), list(discrete), list(continuous)
        self.stats = sufficient_stats(self._df, self.continuous) if continuous else None
        self._joint: dict = {}
        self.n = self._df.count()
        self._levels = {v: self._df.select(v).distinct().count() for v in discrete}

    def _cells(self, disc: tuple, cont: tuple) -> list[tuple[int, np.ndarray]]:
        c = len(cont)
        pairs = [(i, j) for i in range(c) for j in range(i, c)]
        centred = [F.col(v).cast("double") - float(self.stats.means[self.stats.index[v]]) for v in cont]
        aggs = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(centred)], *[F.sum(centred[i] * centred[j]).alias(f"q{i}_{j}") for i, j in pairs]]
        out = []
        for r in self._df.groupBy(*disc).agg(*aggs).collect():  # one row for each attested cell
            n, s, q = r["n"], np.array([r[f"s{i}"] for i in range(c)]), np.zeros((c, c))
            for i, j in pairs:
                q[i, j] = q[j, i] = r[f"q{i}_{j}"]
            out.append((n, (q - np.outer(s, s) / n) / n if c else q))
        return out

    def _loglik(self, names: frozenset) -> float:
        if names not in self._joint:
            disc, cont = (tuple(v for v in self.variables if v in names and v in kind) for kind in (self.discrete, self.continuous))
            total = 0.0
            pooled = self.stats.select(list(cont)).cov if cont else None
            for n, cov in self._cells(disc, cont) if disc or cont else []:
                total += n * math.log(n / self.n)
                if cont:
                    k = len(cont)
                    use = cov
                    sign, det = np.linalg.slogdet(use)
                    if n <= k + 5 or sign <= 0:
                        use = pooled
                        sign, det = np.linalg.slogdet(use)
                    total += -0.5 * n * (det + k * math.log(2 * math.pi) + float(np.trace(np.linalg.solve(use, cov))))
            self._joint[names] = total
        return self._joint[names]

    def likelihood(self, y: str, parents: list[str]) -> tuple[float, int]:
        """(log-likelihood of y given parents, number of parameters)."""
        names = frozenset(parents)
        cells = math.prod(self._levels[v] for v in parents if v in self.discrete)
        c = sum(v in self.continuous for v in parents)
        free = cells * (c + 2) if y in self.continuous else (self._levels[y] - 1) * cells * (1 + c + c * (c + 1) // 2)
        return self._loglik(names | {y}) - self._loglik(names), free

    def _local(self, y, parents):
        like, free = self.likelihood(y, parents)
        return 2 * like - self.penalty * free * math.log(self.n)
