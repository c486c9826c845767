"""Regressions, structural equation models and Bayesian networks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import chi2_sf, normal_cdf, t_cdf
from ..plans.suffstats import SuffStats, merged_sums, sufficient_stats
from .graph import Graph


@dataclass
class RegressionResult:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    r2: float
    n: int

    def to_df(self, spark):
        rows = [(v, *map(float, x)) for v, *x in zip(self.names, self.coef, self.se, self.t, self.p, strict=True)]
        return spark.createDataFrame(rows, "var string, coef double, se double, t double, p double")


def ols(data: DataFrame | SuffStats, target: str, predictors: list[str]) -> RegressionResult:
    """Least squares with intercept from means and covariances."""
    s = data if isinstance(data, SuffStats) else sufficient_stats(data, [target, *predictors])
    s = s.select([target, *predictors])
    sxx, sxy = s.cov[1:, 1:], s.cov[1:, 0]
    inv = np.linalg.inv(sxx)
    b = inv @ sxy
    rss = (s.n - 1) * (s.cov[0, 0] - sxy @ b)
    df = s.n - len(predictors) - 1
    s2 = rss / df
    coef = np.concatenate(([s.means[0] - b @ s.means[1:]], b))
    var0 = s2 * (1 / s.n + s.means[1:] @ inv @ s.means[1:] / (s.n - 1))
    se = np.sqrt(np.concatenate(([var0], s2 * np.diag(inv) / (s.n - 1))))
    t = coef / se
    p = np.array([2 * (1 - t_cdf(abs(x), df)) for x in t])
    return RegressionResult(["const", *predictors], coef, se, t, p, 1 - rss / ((s.n - 1) * s.cov[0, 0]), s.n)


def logistic(df: DataFrame, target: str, predictors: list[str], rounds: int = 30) -> RegressionResult:
    """Newton's method; a round is one pass that returns (p + 1)^2 numbers from each task. Raises an error if it does not settle."""
    rows = df.select(F.col(target).cast("double"), *[F.col(c).cast("double") for c in predictors]).dropna()
    p = len(predictors) + 1
    w = np.zeros(p)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            h, g, like, n = np.zeros((p, p)), np.zeros(p), 0.0, 0
            for b in batches:
                if b.num_rows:
                    y = b.column(0).to_numpy()
                    x = np.stack([np.ones(b.num_rows), *(c.to_numpy() for c in b.columns[1:])], axis=1)
                    q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
                    h += (x * (q * (1 - q))[:, None]).T @ x
                    g += x.T @ (y - q)
                    like += float(np.where(y == 1, np.log(q), np.log1p(-q)).sum())
                    n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()]), pa.array([g.tobytes()]), pa.array([like]), pa.array([n], pa.int64())], names=["h", "g", "l", "n"])

        r = merged_sums(rows.mapInArrow(run, "h binary, g binary, l double, n long"))[0]
        h, g, n = np.frombuffer(r["h"]).reshape(p, p), np.frombuffer(r["g"]), r["n"]
        step = np.linalg.solve(h + 1e-10 * np.eye(p), g)
        w = w + step
        if np.abs(step).max() < 1e-10 * (1 + np.abs(w).max()):
            break
    else:
        raise RuntimeError(f"the coefficients did not settle in {rounds} rounds; predictors may separate the outcomes")
    if not np.isfinite(w).all() or np.linalg.cond(h) > 1e14:
        raise RuntimeError("predictors separate the outcomes or depend on each other")
    se = np.sqrt(np.diag(np.linalg.inv(h + 1e-10 * np.eye(p))))
    z = w / se
    return RegressionResult(["const", *predictors], w, se, z, np.array([2 * (1 - normal_cdf(abs(v))) for v in z]), float("nan"), n)


# structural equation models


@dataclass
class SemFit:
    graph: Graph
    edges: dict[tuple[str, str], float]
    variances: dict[str, float]
    implied: np.ndarray
    chi2: float
    df: int
    p: float
    bic: float


def fit_sem(data: DataFrame | SuffStats, dag: Graph) -> SemFit:
    """Each node regressed on its parents; the fit of the covariances that this implies."""
    s = data if isinstance(data, SuffStats) else sufficient_stats(data, dag.nodes)
    s = s.select(dag.nodes)
    k = len(s.names)
    b, err, edges, var = np.zeros((k, k)), np.zeros(k), {}, {}
    for v in s.names:
        parents = dag.parents(v)
        c, s2 = s.regress(v, parents)
        i = s.index[v]
        err[i] = var[v] = s2
        for q, x in zip(parents, c, strict=True):
            b[i, s.index[q]] = edges[q, v] = float(x)
    inv = np.linalg.inv(np.eye(k) - b)
    implied = inv @ np.diag(err) @ inv.T
    f = np.linalg.slogdet(implied)[1] - np.linalg.slogdet(s.cov)[1] + np.trace(s.cov @ np.linalg.inv(implied)) - k
    chi2, df = (s.n - 1) * float(f), k * (k + 1) // 2 - k - len(edges)
    return SemFit(dag, edges, var, implied, chi2, df, chi2_sf(chi2, df), chi2 - df * math.log(s.n))


def total_effect(fit: SemFit, x: str, y: str) -> float:
    """Sum over directed paths of the products of coefficients."""
    if x == y:
        return 1.0
    return sum(c * total_effect(fit, b, y) for (a, b), c in fit.edges.items() if a == x)


def ida(stats: SuffStats, pattern: Graph, x: str, y: str) -> list[float]:
    """Possible effects of x on y: a regression for each set of neighbours that may be parents."""
    from itertools import combinations

    parents = pattern.parents(x)
    near = [v for v in pattern.adj(x) if pattern.undirected(v, x)]
    out = []
    for d in range(len(near) + 1):
        for extra in combinations(near, d):
            if any(not pattern.adjacent(a, b) for a in extra for b in [*extra, *parents] if a != b):
                continue
            given = [*parents, *extra]
            out.append(0.0 if y in given else float(stats.regress(y, [x, *given])[0][0]))
    return sorted(out)


def simulate_sem(spark, dag: Graph, n: int, seed: int = 0, low: float = 0.5, high: float = 1.5, partitions: int | None = None) -> DataFrame:
    """`row_id` and a column for each node of a random linear Gaussian model, in topological order."""
    r = np.random.default_rng(seed)
    df = spark.range(n, numPartitions=partitions).withColumnRenamed("id", "row_id") if partitions else spark.range(n).withColumnRenamed("id", "row_id")
    for k, v in enumerate(dag.topological_order()):
        terms = [F.col(p) * float(r.uniform(low, high) * r.choice([-1, 1])) for p in dag.parents(v)]
        df = df.withColumn(v, reduce(lambda a, b: a + b, terms, F.randn(seed * 1000 + k)))
    return df.select("row_id", *dag.nodes)


# Bayesian networks: tables of (parents..., node, p)


def cpt(df: DataFrame, node: str, parents: list[str], prior: float = 0.0) -> DataFrame:
    """Conditional probabilities of the attested values, with a Dirichlet pseudo-count for each cell.

    With a prior, all combinations of attested parent configurations and values are listed.
    """
    rows = df.dropna(subset=[node, *parents])
    cells = rows.groupBy(*parents, node).agg(F.count("*").alias("n"))
    if prior:
        values = cells.select(node).distinct()
        grid = cells.select(*parents).distinct().crossJoin(values) if parents else values  # configurations x values of one node
        cells = grid.join(cells, [*parents, node], "left").na.fill(0, ["n"])
    w = W.partitionBy(*parents)
    return cells.select(*parents, node, ((F.col("n") + prior) / (F.sum("n").over(w) + prior * F.count("*").over(w))).alias("p"))


class BayesNet:
    """A DAG with a conditional probability table for each node."""

    def __init__(self, dag: Graph, tables: dict[str, DataFrame]) -> None:
        self.dag, self.tables = dag, tables

    @classmethod
    def fit(cls, df: DataFrame, dag: Graph, prior: float = 0.0) -> BayesNet:
        return cls(dag, {v: cpt(df, v, dag.parents(v), prior) for v in dag.nodes})

    def marginal(self, target: list[str], evidence: dict[str, object] | None = None) -> DataFrame:
        """(target..., p) given evidence, by variable elimination: joins of factors and grouped sums."""
        evidence = evidence or {}
        keep = set(target) | set(evidence)
        needed = self.dag.ancestors(keep)
        factors = []
        for v in self.dag.nodes:
            if v in needed:
                f = self.tables[v]
                for e, value in evidence.items():
                    if e in f.columns:
                        f = f.where(F.col(e) == F.lit(value))
                factors.append(f)
        left = [v for v in needed if v not in keep]
        while left:
            size = lambda v: len({c for f in factors if v in f.columns for c in f.columns})
            v = min(left, key=lambda u: (size(u), u))
            left.remove(v)
            own = [f for f in factors if v in f.columns]
            product = reduce(_times, own)
            rest = [c for c in product.columns if c not in (v, "p")]
            factors = [f for f in factors if v not in f.columns] + [product.groupBy(*rest).agg(F.sum("p").alias("p"))]
        joint = reduce(_times, factors).groupBy(*target).agg(F.sum("p").alias("p"))
        return joint.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy()))  # target values only

    def em(self, df: DataFrame, rounds: int = 20) -> BayesNet:
        """Expected counts where one hidden node of `latent` has no column; needs starting tables."""
        hidden = [v for v in self.dag.nodes if v not in df.columns]
        tables = self.tables
        seen = [v for v in self.dag.nodes if v in df.columns]
        cells = df.groupBy(*seen).agg(F.count("*").alias("_n")).toPandas()
        spark = df.sparkSession
        for _ in range(rounds):
            pieces = {v: {tuple(r)[:-1]: r["p"] for r in t.select(*self.dag.parents(v), v, "p").collect()} for v, t in tables.items()}
            values = {h: sorted({k[-1] for k in pieces[h]}) for h in hidden}
            counts: dict[str, dict] = {v: {} for v in self.dag.nodes}
            for row in cells.to_dict("records"):
                states = [{}]
                for h in hidden:
                    states = [s | {h: x} for s in states for x in values[h]]
                weights = []
                for s in states:
                    full = row | s
                    weights.append(math.prod(pieces[v].get((*(full[p] for p in self.dag.parents(v)), full[v]), 0.0) for v in self.dag.nodes))
                total = sum(weights)
                for s, w in zip(states, weights, strict=True):
                    full = row | s
                    for v in self.dag.nodes:
                        key = (*(full[p] for p in self.dag.parents(v)), full[v])
                        counts[v][key] = counts[v].get(key, 0.0) + (row["_n"] * w / total if total else 0.0)
            new = {}
            for v, c in counts.items():
                sums: dict = {}
                for k, n in c.items():
                    sums[k[:-1]] = sums.get(k[:-1], 0.0) + n
                new[v] = spark.createDataFrame([(*k, n / sums[k[:-1]]) for k, n in c.items() if sums[k[:-1]]], [*self.dag.parents(v), v, "p"])
            tables = new
        return BayesNet(self.dag, tables)


def _times(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns and c != "p"]
    b = b.withColumnRenamed("p", "_q")
    both = a.join(b, shared) if shared else a.crossJoin(b)  # factors of a network, not data
    return both.withColumn("p", F.col("p") * F.col("_q")).drop("_q")


# clusters


def kmeans(df: DataFrame, cols: list[str], centres: list[list[float]], rounds: int = 50) -> tuple[list[list[float]], DataFrame]:
    """(centres, df with `cluster`): assign and move until no centre moves; a round is one aggregation."""
    out = assign_clusters(df, cols, centres)
    for _ in range(rounds):
        got = {r["cluster"]: [r[c] for c in cols] for r in out.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).collect()}
        new = [got.get(k, c) for k, c in enumerate(centres)]
        moved = max((abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)), default=0.0)
        centres = new
        out = assign_clusters(df, cols, centres)
        if moved < 1e-12:
            break
    return centres, out


def assign_clusters(df: DataFrame, cols: list[str], centres: list[list[float]]) -> DataFrame:
    """df with `cluster`, the nearest centre, the first of equals, and `distance2` from it."""
    d = [F.struct(reduce(lambda a, b: a + b, [(F.col(c) - float(x)) ** 2 for c, x in zip(cols, centre, strict=True)]).alias("d"), F.lit(k).alias("k")) for k, centre in enumerate(centres)]
    best = F.array_min(F.array(*d))
    return df.withColumn("_b", best).withColumns({"cluster": F.col("_b.k"), "distance2": F.col("_b.d")}).drop("_b")
