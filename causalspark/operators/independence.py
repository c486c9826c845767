"""Conditional-independence tests on sufficient statistics, contingency counts, or known graphs.

A test has `variables`, `alpha`, `p_value(x, y, z)` and `independent(x, y, z)`. Tests on data
hold statistics that one Spark pass (Gaussian), or one aggregation for each variable set
(discrete, mixed), has gathered; a search never goes back to the rows otherwise.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, normal_cdf, normal_quantile, t_cdf
from ..plans.suffstats import SuffStats, sufficient_stats
from .graph import Graph


class Test:
    variables: list[str]
    alpha: float = 0.05

    def p_value(self, x: str, y: str, z=()) -> float:
        raise NotImplementedError

    def independent(self, x: str, y: str, z=()) -> bool:
        return self.p_value(x, y, z) > self.alpha

    def score(self, x: str, y: str, z=()) -> float:
        """Larger for stronger dependence."""
        return self.alpha - self.p_value(x, y, z)


class _Gaussian(Test):
    def __init__(self, data: DataFrame | SuffStats, alpha: float = 0.05) -> None:
        self.stats = data if isinstance(data, SuffStats) else sufficient_stats(data)
        self.variables, self.alpha = self.stats.names, alpha


class FisherZ(_Gaussian):
    """Fisher's z of the partial correlation; a singular submatrix counts as independent."""

    def z(self, x: str, y: str, z=()) -> float:
        r = self.stats.partial_correlation(x, y, list(z))
        if math.isnan(r):
            return 0.0
        if abs(r) >= 1:
            return math.inf
        return 0.5 * math.sqrt(max(self.stats.n - 3 - len(z), 0)) * math.log((1 + r) / (1 - r))

    def p_value(self, x, y, z=()):
        return 2 * (1 - normal_cdf(abs(self.z(x, y, z))))

    def independent(self, x, y, z=()):
        return abs(self.z(x, y, z)) < normal_quantile(1 - self.alpha / 2)

    def score(self, x, y, z=()):
        return abs(self.z(x, y, z)) - normal_quantile(1 - self.alpha / 2)


class CorrelationT(_Gaussian):
    """t test of the partial correlation with n - 2 degrees of freedom whatever the size of z."""

    def p_value(self, x, y, z=()):
        r = self.stats.partial_correlation(x, y, list(z))
        if math.isnan(r):
            return 1.0
        if abs(r) >= 1:
            return 0.0
        df = self.stats.n - 2
        return 2 * (1 - t_cdf(abs(r) * math.sqrt(df / (1 - r * r)), df))


class CramerT(_Gaussian):
    """t test of the partial correlation with n - 2 - |z| degrees of freedom."""

    def p_value(self, x, y, z=()):
        r = self.stats.partial_correlation(x, y, list(z))
        if math.isnan(r):
            return 1.0
        if abs(r) >= 1:
            return 0.0
        df = self.stats.n - 2 - len(z)
        return 2 * (1 - t_cdf(abs(r) * math.sqrt(df / (1 - r * r)), df))


class PartialCorrelation(FisherZ):
    """Fisher's z given all other variables, whatever z is asked for."""

    def z(self, x, y, z=()):
        return super().z(x, y, [v for v in self.variables if v not in (x, y)])


class GeneralizedInverse(FisherZ):
    """Fisher's z where singular submatrices are inverted by the pseudo-inverse."""

    def z(self, x, y, z=()):
        at = [self.stats.index[v] for v in (x, y, *z)]
        p = np.linalg.pinv(self.stats.cov[np.ix_(at, at)])
        r = float(np.clip(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]), -1, 1)) if p[0, 0] * p[1, 1] > 0 else 0.0
        if abs(r) >= 1:
            return math.inf
        return 0.5 * math.sqrt(max(self.stats.n - 3 - len(z), 0)) * math.log((1 + r) / (1 - r))


class Regression(_Gaussian):
    """t test of y's coefficient in the regression of x on y and z."""

    def p_value(self, x, y, z=()):
        at = [self.stats.index[v] for v in (y, *z)]
        try:
            inv = np.linalg.inv(self.stats.cov[np.ix_(at, at)])
        except np.linalg.LinAlgError:
            return 1.0
        i, df = self.stats.index[x], self.stats.n - len(at) - 1
        b = inv @ self.stats.cov[at, i]
        rss = (self.stats.n - 1) * (self.stats.cov[i, i] - self.stats.cov[at, i] @ b)
        if df <= 0 or rss <= 0:
            return 0.0 if rss <= 0 and b[0] else 1.0
        se = math.sqrt(rss / df * inv[0, 0] / (self.stats.n - 1))
        return 2 * (1 - t_cdf(abs(b[0]) / se, df))


class _Discrete(Test):
    """Counts of one table over all asked-for variable sets come from a cached aggregate of the whole table.

    The cells of the full cross table are aggregated once if there are at most `cells` of
    them; otherwise each variable set is one aggregation of the rows.
    """

    def __init__(self, df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05, cells: int = 200_000) -> None:
        self.variables, self.alpha = list(cols or df.columns), alpha
        self._df = df.select(*[F.col(c).cast("string").alias(c) for c in self.variables])
        sizes = self._df.agg(*[F.approx_count_distinct(c) for c in self.variables]).first()
        self._table = None
        if math.prod(2 * (s + 1) for s in sizes) <= cells or len(self.variables) <= 6 and math.prod(s + 1 for s in sizes) <= cells:
            rows = self._df.groupBy(*self.variables).count().limit(cells + 1).collect()
            if len(rows) <= cells:
                self._table = [(tuple(r)[:-1], r["count"]) for r in rows]
        self._seen: dict = {}

    def counts(self, names: tuple[str, ...]) -> dict[tuple, int]:
        """Counts by values of these variables, over the rows that have all of them."""
        if names not in self._seen:
            out: dict[tuple, int] = {}
            if self._table is not None:
                at = [self.variables.index(v) for v in names]
                for cell, n in self._table:
                    key = tuple(cell[i] for i in at)
                    out[key] = out.get(key, 0) + n
            else:
                for r in self._df.groupBy(*names).count().collect():  # one row for each attested cell
                    out[tuple(r)[:-1]] = r["count"]
            self._seen[names] = {k: n for k, n in out.items() if None not in k}
        return self._seen[names]

    def statistic(self, x: str, y: str, z=()) -> tuple[float, int]:
        """(statistic, degrees of freedom) summed over the strata of z, by attested rows and columns."""
        strata: dict[tuple, dict] = {}
        for key, n in self.counts((x, y, *z)).items():
            strata.setdefault(key[2:], {})[key[:2]] = n
        total, df = 0.0, 0
        for cells in strata.values():
            rows: dict = {}
            cols: dict = {}
            for (a, b), n in cells.items():
                rows[a], cols[b] = rows.get(a, 0) + n, cols.get(b, 0) + n
            d = (len(rows) - 1) * (len(cols) - 1)
            if d > 0:
                size = sum(rows.values())
                total += sum(self._term(cells.get((a, b), 0), rows[a] * cols[b] / size) for a in rows for b in cols)
                df += d
        return total, df

    def p_value(self, x, y, z=()):
        stat, df = self.statistic(x, y, z)
        return chi2_sf(stat, df) if df else 1.0


class ChiSquare(_Discrete):
    """Pearson's test within the strata of z."""

    @staticmethod
    def _term(seen: int, expected: float) -> float:
        return (seen - expected) ** 2 / expected


class GSquare(_Discrete):
    """Likelihood-ratio test within the strata of z."""

    @staticmethod
    def _term(seen: int, expected: float) -> float:
        return 2 * seen * math.log(seen / expected) if seen else 0.0


class ScoreTest(Test):
    """Independent where a score does not gain from the edge."""

    def __init__(self, score, alpha: float = 0.05) -> None:
        self.variables, self._score, self.alpha = score.variables, score, alpha

    def score(self, x, y, z=()):
        return self._score.diff(x, y, list(z))

    def p_value(self, x, y, z=()):
        return 1.0 if self.independent(x, y, z) else 0.0

    def independent(self, x, y, z=()):
        return not self.score(x, y, z) > 0


class LikelihoodRatio(Test):
    """Twice the gain in log-likelihood from x in the model of y given z, against chi-square."""

    def __init__(self, likelihood, alpha: float = 0.05) -> None:
        self.variables, self._like, self.alpha = likelihood.variables, likelihood, alpha

    def p_value(self, x, y, z=()):
        (big, k), (small, j) = (self._like.likelihood(y, [x, *z]), self._like.likelihood(y, list(z)))
        return chi2_sf(2 * (big - small), k - j) if k > j else 1.0


class DSeparation(Test):
    """The oracle of a known graph over its measured nodes."""

    def __init__(self, graph: Graph) -> None:
        self.graph = graph
        self.variables = [v for v in graph.nodes if v not in graph.latent]

    def independent(self, x, y, z=()):
        return self.graph.d_separated(x, y, z)

    def p_value(self, x, y, z=()):
        return 1.0 if self.independent(x, y, z) else 0.0


class Facts(Test):
    """The oracle of a list of (x, y, z) facts, symmetric in x and y."""

    def __init__(self, facts, variables: list[str] | None = None) -> None:
        self._facts = {(frozenset((x, y)), frozenset(z)) for x, y, z in facts}
        self.variables = variables or sorted({v for pair, z in self._facts for v in pair | z})

    def independent(self, x, y, z=()):
        return (frozenset((x, y)), frozenset(z)) in self._facts

    def p_value(self, x, y, z=()):
        return 1.0 if self.independent(x, y, z) else 0.0


class Pooled(Test):
    """One decision from the p-values of several tests over the same variables.

    Methods: fisher, tippett, worsleyfriston, stouffer, mudholkergeorge, average, majority,
    percent (share of tests that find independence, against `share`), fdr.
    """

    def __init__(self, tests: list[Test], method: str = "fisher", alpha: float = 0.05, share: float = 0.5) -> None:
        self.tests, self.method, self.alpha, self.share = tests, method, alpha, share
        self.variables = tests[0].variables

    def p_value(self, x, y, z=()):
        p = [min(max(t.p_value(x, y, z), 1e-300), 1 - 1e-16) for t in self.tests]
        k = len(p)
        match self.method:
            case "fisher":
                return chi2_sf(-2 * sum(map(math.log, p)), 2 * k)
            case "tippett":
                return 1 - (1 - min(p)) ** k
            case "worsleyfriston":
                return max(p) ** k
            case "stouffer":
                return 1 - normal_cdf(sum(normal_quantile(1 - q) for q in p) / math.sqrt(k))
            case "mudholkergeorge":
                c = math.sqrt(3 * (5 * k + 4) / (k * math.pi**2 * (5 * k + 2)))
                t = -c * sum(math.log(q / (1 - q)) for q in p)
                return 1 - t_cdf(t, 5 * k + 4)
            case "average":
                return sum(p) / k
            case "majority":
                return 1.0 if sum(q > self.alpha for q in p) > k / 2 else 0.0
            case "percent":
                return 1.0 if sum(q > self.alpha for q in p) >= self.share * k else 0.0
            case "fdr":
                ordered = sorted(p)
                return 0.0 if any(q <= self.alpha * (i + 1) / k for i, q in enumerate(ordered)) else 1.0
        raise ValueError(f"unknown method {self.method}")


def all_pairs(test: Test, z=()) -> list[tuple[str, str, float]]:
    return [(x, y, test.p_value(x, y, z)) for x, y in combinations([v for v in test.variables if v not in z], 2)]


def precision_edges(stats: SuffStats, threshold: float) -> Graph:
    """Undirected edges where the scaled inverse correlation passes the threshold."""
    p = np.linalg.inv(stats.corr)
    g = Graph(stats.names)
    for i, j in combinations(range(len(stats.names)), 2):
        if abs(p[i, j]) / math.sqrt(p[i, i] * p[j, j]) > threshold:
            g.add_edge(stats.names[i], stats.names[j], "-", "-")
    return g


def canonical_rank(stats: SuffStats, xs: list[str], ys: list[str], alpha: float = 0.05) -> int:
    """Rank of the cross-covariance of two sets by Bartlett's tests of canonical correlations."""
    i, j = ([stats.index[v] for v in s] for s in (xs, ys))
    r = stats.corr
    whiten = lambda m: np.linalg.inv(np.linalg.cholesky(m))
    s = np.linalg.svd(whiten(r[np.ix_(i, i)]) @ r[np.ix_(i, j)] @ whiten(r[np.ix_(j, j)]).T, compute_uv=False)
    p, q = len(xs), len(ys)
    for k in range(min(p, q)):
        stat = -(stats.n - (p + q + 3) / 2) * float(np.log1p(-np.minimum(s[k:] ** 2, 1 - 1e-15)).sum())
        if chi2_sf(stat, (p - k) * (q - k)) > alpha:
            return k
    return min(p, q)


def quartet_differences(stats: SuffStats, a: str, b: str, c: str, d: str) -> list[tuple[float, float]]:
    """(difference, Wishart p-value) of the three differences of covariance products of four variables."""
    out = []
    for w, x, y, z in ((a, b, c, d), (a, b, d, c), (a, c, d, b)):
        i, j, k, m = (stats.index[v] for v in (w, x, y, z))
        s, n = stats.cov, stats.n
        diff = s[i, j] * s[k, m] - s[i, k] * s[j, m]
        minor = lambda u, v: s[u, u] * s[v, v] - s[u, v] ** 2
        det = np.linalg.det(s[np.ix_([i, j, k, m], [i, j, k, m])])
        var = (minor(i, m) * minor(j, k) * (n + 1) / (n - 1) - det) / (n - 2)
        out.append((float(diff), 2 * (1 - normal_cdf(abs(diff) / math.sqrt(var))) if var > 0 else 1.0))
    return out
