"""Simultaneous tests of vanishing tetrads and sextads, and clusters found with them.

A tetrad is a difference of covariance products, s(a,b) s(c,d) - s(a,c) s(b,d); a sextad is the
determinant of the covariances of three variables with three others. Several are tested together
by the delta method: T = n t' (D' S D)^-1 t, where t holds the differences, D their derivatives by
the covariances that occur, and S the asymptotic covariances of these. S comes from fourth moments
of the rows, or from the covariances alone where the rows are taken as Gaussian.

Fourth moments are gathered in one pass over the rows for the products that the chosen sets
need, and for no others. Searches test their quartets and sextets as Spark tasks, which get the
covariances and return the sets that vanish.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, normal_cdf
from ..plans.suffstats import SuffStats, merged_sums, sufficient_stats
from .graph import Graph

#: Products of a batch of rows that are held at once.
CELLS = 1 << 22


@dataclass
class FourthMoments:
    """Means of products of four centred variables (divisor n), by sorted names."""

    n: int
    values: dict[tuple[str, ...], float] = field(repr=False)

    def __call__(self, *names: str) -> float:
        return self.values[tuple(sorted(names))]

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(*k, v) for k, v in sorted(self.values.items())], "var_i string, var_j string, var_k string, var_l string, value double")


def _occurring(differences: Iterable[Sequence[str]]) -> list[tuple[str, str]]:
    """The covariances that the differences hold, as sorted pairs."""
    found: dict[tuple[str, str], None] = {}
    for d in differences:
        pairs = ((0, 1), (2, 3), (0, 2), (1, 3)) if len(d) == 4 else ((i, j) for i in range(3) for j in range(3, 6))
        for i, j in pairs:
            found[tuple(sorted((d[i], d[j])))] = None
    return list(found)


def needed_products(groups: Iterable[Iterable[Sequence[str]]]) -> list[tuple[str, ...]]:
    """The fourth moments that tests of these groups of differences ask for."""
    out: set[tuple[str, ...]] = set()
    for differences in groups:
        out |= {tuple(sorted((*x, *y))) for x, y in combinations_with_replacement(_occurring(differences), 2)}
    return sorted(out)


def fourth_moments(df: DataFrame, products: list[tuple[str, ...]], stats: SuffStats) -> FourthMoments:
    """Moments about the means of stats, over the rows in which all its variables are present and finite; one pass."""
    names = stats.names
    means, at = stats.means, np.array([[stats.index[v] for v in p] for p in products], dtype=np.int64).reshape(-1, 4)
    # products of two are made once each
    pairs, where = np.unique(np.sort(np.concatenate((at[:, :2], at[:, 2:])), axis=1), axis=0, return_inverse=True)
    left, right = where.ravel()[: len(at)], where.ravel()[len(at) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(at))
        step = max(CELLS // max(len(pairs), 1), 1)
        for b in batches:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in b.columns], axis=1)
            x = x[np.isfinite(x).all(axis=1)] - means
            n += len(x)
            for k in range(0, len(x), step):
                two = x[k : k + step, pairs[:, 0]] * x[k : k + step, pairs[:, 1]]
                if 4 * len(at) > len(pairs) ** 2:  # most products of two meet
                    total += (two.T @ two)[left, right]
                else:
                    for j in range(0, len(at), len(pairs)):
                        total[j : j + len(pairs)] += np.einsum("ij,ij->j", two[:, left[j : j + len(pairs)]], two[:, right[j : j + len(pairs)]])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, "n long, total binary")
    found = next(iter(merged_sums(rows)), None)
    n, total = (found["n"], np.frombuffer(found["total"])) if found else (0, np.zeros(len(at)))
    return FourthMoments(n, {tuple(sorted(p)): float(v) / max(n, 1) for p, v in zip(products, total, strict=True)})


class DeltaTest:
    """Tests whether tetrads (four names) or sextads (six names) vanish together.

    With `fourth` no distribution is assumed; without, S is that of Gaussian rows, for
    covariances or for correlations. The differences must not depend on each other.
    """

    def __init__(self, stats: SuffStats, fourth: FourthMoments | None = None, correlations: bool = False) -> None:
        if fourth is not None and correlations:
            raise ValueError("fourth moments are of covariances")
        self.stats, self.fourth, self.correlations = stats, fourth, correlations
        self.s = stats.corr if correlations else stats.cov

    def _value(self, a: str, b: str) -> float:
        return float(self.s[self.stats.index[a], self.stats.index[b]])

    def _spread(self, x: tuple[str, str], y: tuple[str, str]) -> float:
        """n times the asymptotic covariance of two sample covariances."""
        v, (e, f), (g, h) = self._value, x, y
        if self.fourth is not None:
            return self.fourth(e, f, g, h) - v(e, f) * v(g, h)
        both = v(e, g) * v(f, h) + v(e, h) * v(f, g)
        if not self.correlations:
            return both
        squares = v(e, g) ** 2 + v(e, h) ** 2 + v(f, g) ** 2 + v(f, h) ** 2
        return 0.5 * v(e, f) * v(g, h) * squares + both - v(e, f) * (v(f, g) * v(f, h) + v(e, g) * v(e, h)) - v(g, h) * (v(e, g) * v(f, g) + v(e, h) * v(f, h))

    def _difference(self, d: Sequence[str]) -> tuple[float, dict[tuple[str, str], float]]:
        """(the difference, its derivatives by the covariances in it)."""
        v, slope = self._value, {}

        def add(a: str, b: str, by: float) -> None:
            key = tuple(sorted((a, b)))
            slope[key] = slope.get(key, 0.0) + by

        if len(d) == 4:
            a, b, c, e = d
            add(a, b, v(c, e))
            add(c, e, v(a, b))
            add(a, c, -v(b, e))
            add(b, e, -v(a, c))
            return v(a, b) * v(c, e) - v(a, c) * v(b, e), slope
        m = np.array([[v(x, y) for y in d[3:]] for x in d[:3]])
        for i in range(3):
            for j in range(3):
                minor = np.delete(np.delete(m, i, axis=0), j, axis=1)
                add(d[i], d[3 + j], (-1) ** (i + j) * float(minor[0, 0] * minor[1, 1] - minor[0, 1] * minor[1, 0]))
        return float(np.linalg.det(m)), slope

    def chi_square(self, *differences: Sequence[str]) -> float:
        """The statistic, with as many degrees of freedom as there are differences; NaN where they depend on each other."""
        found = [self._difference(d) for d in differences]
        pairs = _occurring(differences)
        spread = np.array([[self._spread(x, y) for y in pairs] for x in pairs])
        slopes = np.array([[slope.get(p, 0.0) for _, slope in found] for p in pairs])
        t, around = np.array([value for value, _ in found]), slopes.T @ spread @ slopes
        scale = np.sqrt(np.diag(around))
        if not (scale > 0).all() or np.linalg.cond(around / np.outer(scale, scale)) > 1e12:
            return float("nan")
        return float(self.stats.n * t @ np.linalg.solve(around, t))

    def p_value(self, *differences: Sequence[str]) -> float:
        x = self.chi_square(*differences)
        return x if np.isnan(x) else chi2_sf(max(x, 0.0), len(differences))


def tetrads(a: str, b: str, c: str, d: str) -> list[tuple[str, str, str, str]]:
    """The three tetrads of four variables; any two imply the third."""
    return [(a, b, c, d), (a, b, d, c), (a, c, d, b)]


def sextads(six: Sequence[str]) -> list[tuple[str, ...]]:
    """The ten sextads of six variables, by the halves with the first of them."""
    rows = [(six[0], x, y) for x, y in combinations(six[1:], 2)]
    return [(*r, *[v for v in six if v not in r]) for r in rows]


def vanishes(test: DeltaTest, names: Sequence[str], alpha: float) -> bool:
    """Whether all tetrads of four variables, or all sextads of six, vanish.

    Four variables are tested by two tetrads (one common factor: two degrees of freedom), six by
    the four sextads that two common factors imply, in four orders of the variables.
    """
    if len(names) == 4:
        return test.p_value(*tetrads(*names)[:2]) > alpha
    for order in ((0, 1, 2, 3, 4, 5), (2, 1, 0, 5, 4, 3), (3, 4, 5, 0, 1, 2), (5, 4, 3, 2, 1, 0)):
        n = [names[k] for k in order]
        halves = ((0, 3, 5, 1, 2, 4), (0, 2, 5, 1, 3, 4), (0, 1, 3, 2, 4, 5), (0, 1, 4, 2, 3, 5))
        p = test.p_value(*[tuple(n[k] for k in h) for h in halves])
        if not p > alpha:  # NaN, too
            return False
    return True


def vanishing_sets(spark, test: DeltaTest, size: int, alpha: float) -> set[frozenset]:
    """The sets of so many variables (4 or 6) that vanish; tasks share the sets out by their first two."""
    names = test.stats.names
    heads = [(i, j) for i, j in combinations(range(len(names)), 2) if len(names) - j - 1 >= size - 2]
    if not heads:
        return set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sets = ([names[k] for k in (i, j, *rest)] for rest in combinations(range(j + 1, len(names)), size - 2))
                found = [s for s in sets if vanishes(test, s, alpha)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["names"])

    rows = spark.createDataFrame(heads, "i int, j int").repartition(min(4 * spark.sparkContext.defaultParallelism, len(heads)))
    return {frozenset(r["names"]) for r in rows.mapInArrow(run, "names array<string>").collect()}


def _uncorrelated(stats: SuffStats, a: str, b: str, alpha: float) -> bool:
    r = float(np.clip(stats.corr[stats.index[a], stats.index[b]], -1 + 1e-15, 1 - 1e-15))
    return 2 * (1 - normal_cdf(abs(0.5 * sqrt(max(stats.n - 3, 0)) * log((1 + r) / (1 - r))))) > alpha


def _disjoint(clusters: Iterable[list[str]], names: list[str], first: list[str] | None = None) -> list[list[str]]:
    """`first`, then the largest clusters, each without a variable of those before."""
    out, used = [], set()
    for c in sorted(clusters, key=lambda c: (c != first, -len(c), [names.index(v) for v in c])):
        if not used & set(c):
            out.append(c)
            used |= set(c)
    return sorted(out, key=lambda c: names.index(c[0]))


def _grown(seeds: set[frozenset], names: list[str]) -> list[list[str]]:
    """Seeds, each with the variables that make seeds with all its smaller parts."""
    out = []
    for seed in seeds:
        cluster = sorted(seed, key=names.index)
        for v in names:
            if v not in seed and all(frozenset((*part, v)) in seeds for part in combinations(cluster, len(seed) - 1)):
                cluster.append(v)
        out.append(sorted(cluster, key=names.index))
    return out


def two_factor_clusters(spark, test: DeltaTest, alpha: float = 1e-3) -> list[list[str]]:
    """Clusters of six or more variables that share two common causes.

    Five variables are pure if with every other one all sextads vanish and fewer than four of
    their pairs are uncorrelated. Pure fives grow by what keeps all their fives pure.
    """
    names, stats = test.stats.names, test.stats
    whole = vanishing_sets(spark, test, 6, alpha)
    apart = {frozenset(p) for p in combinations(names, 2) if _uncorrelated(stats, *p, alpha)}
    pure = {
        frozenset(five)
        for five in combinations(names, 5)
        if len(names) > 5 and all(frozenset((*five, v)) in whole for v in names if v not in five) and sum(frozenset(p) in apart for p in combinations(five, 2)) < 4
    }
    return _disjoint((c for c in _grown(pure, names) if len(c) > 5), names)


def _cliques(near: dict[str, set[str]]) -> Iterator[set[str]]:
    """Maximal sets of mutual neighbours, after Bron and Kerbosch with pivots."""

    def step(held: set[str], free: set[str], done: set[str]) -> Iterator[set[str]]:
        if not free and not done:
            yield held
            return
        pivot = max(free | done, key=lambda v: (len(near[v] & free), v))
        for v in sorted(free - near[pivot]):
            yield from step(held | {v}, free & near[v], done & near[v])
            free = free - {v}
            done = done | {v}

    yield from step(set(), set(near), set())


def may_share_a_cause(test: DeltaTest, whole: set[frozenset], alpha: float = 1e-3) -> dict[str, set[str]]:
    """For each variable those that may have a common cause with it; `whole` are the sets of four that vanish.

    x and y have none if they are uncorrelated, or if there are u, w and v, z such that the
    tetrads of x, y, u, w and those of x, y, v, z all vanish but s(x,u) s(y,v) - s(x,v) s(u,y)
    does not.
    """
    names, stats = test.stats.names, test.stats
    near: dict[str, set[str]] = {v: set() for v in names}

    def split(x: str, y: str) -> bool:
        sides = [s - {x, y} for s in whole if x in s and y in s]
        for s, t in combinations(sides, 2):
            if s & t:
                continue
            for p, q in ((s, t), (t, s)):
                if any(not test.p_value((x, u, v, y)) > alpha for u in p for v in q):
                    return True
        return False

    for x, y in combinations(names, 2):
        if not _uncorrelated(stats, x, y, alpha) and not split(x, y):
            near[x].add(y)
            near[y].add(x)
    return near


def build_pure_clusters(spark, test: DeltaTest, alpha: float = 1e-3) -> list[list[str]]:
    """Clusters of three or more variables that each have one common cause and nothing else in common with the rest.

    Cliques of variables that may share a cause are candidates, as they are and without what
    other cliques have. Each is tried as the first of clusters without a common variable, the others by size. Then variables that spoil most of
    the tetrads within a cluster, or of three of it with one of another cluster, go one by one.
    The clusters that keep most variables win.
    """
    names = test.stats.names
    whole = vanishing_sets(spark, test, 4, alpha)
    near = may_share_a_cause(test, whole, alpha)
    cliques = list(_cliques(near))
    alone = [{v for v in c if sum(v in o for o in cliques) == 1} for c in cliques]
    candidates = [list(c) for c in sorted({tuple(sorted(c, key=names.index)) for c in cliques + alone if len(c) >= 3})]

    def purified(clusters: list[list[str]]) -> list[list[str]]:
        while clusters:
            bad: dict[str, int] = {}
            for k, c in enumerate(clusters):
                others = [v for j, o in enumerate(clusters) if j != k for v in o]
                fours = [*combinations(c, 4), *((*three, v) for three in combinations(c, 3) for v in others)]
                for v in (v for four in fours if frozenset(four) not in whole for v in four):
                    bad[v] = bad.get(v, 0) + 1
            if not bad:
                break
            worst = max(bad, key=lambda v: (bad[v], -names.index(v)))
            clusters = [c for c in ([v for v in c if v != worst] for c in clusters) if len(c) >= 3]
        return clusters

    tried = [purified(_disjoint(candidates, names, first)) for first in candidates]
    return max(tried, key=lambda cs: (sum(map(len, cs)), -len(cs)), default=[])


def factor_graph(clusters: list[list[str]], factors: int = 1) -> Graph:
    """Each cluster under so many latent nodes L1, L2, ..."""
    g = Graph()
    for k, c in enumerate(clusters):
        for j in range(factors):
            name = f"L{k * factors + j + 1}"
            g.add_node(name)
            g.latent.add(name)
            for v in c:
                g.add_edge(name, v)
    return g


def delta_test(df: DataFrame, names: list[str], differences: Iterable[Sequence[str]] | None = None, groups: Iterable[Iterable[Sequence[str]]] | None = None) -> DeltaTest:
    """A test on rows: one pass for means and covariances, one for the fourth moments of the differences (or groups of them)."""
    stats = sufficient_stats(df, names)
    return DeltaTest(stats, fourth_moments(df, needed_products([list(differences)] if differences is not None else groups or []), stats))
