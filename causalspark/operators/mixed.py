"""Mixed graphical models, stability selection, and selection of variables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.suffstats import SuffStats, _merge, merged_moments, merged_sums
from .graph import Graph
from .independence import FisherZ
from .search import skeleton
from .transforms import standardize, subsamples


#: Rows that the driver may hold for the discrete conditionals of a mixed model.
LOCAL_ROWS = 1_000_000


@dataclass
class MixedModel:
    """Pairwise model: beta among continuous columns, rho of continuous with levels, phi among levels."""

    continuous: list[str]
    discrete: list[str]
    levels: list[int]
    beta: np.ndarray
    rho: np.ndarray
    phi: np.ndarray
    objective: float

    def graph(self, tol: float = 1e-6) -> Graph:
        g = Graph([*self.continuous, *self.discrete])
        at = np.cumsum([0, *self.levels])
        for i, j in combinations(range(len(self.continuous)), 2):
            if abs(self.beta[i, j]) > tol:
                g.add_edge(self.continuous[i], self.continuous[j], "-", "-")
        for i, c in enumerate(self.continuous):
            for j, d in enumerate(self.discrete):
                if np.abs(self.rho[i, at[j] : at[j + 1]]).max() > tol:
                    g.add_edge(c, d, "-", "-")
        for i, j in combinations(range(len(self.discrete)), 2):
            if np.abs(self.phi[at[i] : at[i + 1], at[j] : at[j + 1]]).max() > tol:
                g.add_edge(self.discrete[i], self.discrete[j], "-", "-")
        return g


def mgm(df: DataFrame, continuous: list[str], discrete: list[str], lam: tuple[float, float, float], rounds: int = 200, tol: float = 1e-5) -> MixedModel:
    """Penalised pseudo-likelihood by accelerated proximal gradient steps.

    Penalties are for continuous pairs, continuous-discrete pairs and discrete pairs. The
    conditionals of continuous columns only need the count, sums and products of each discrete
    cell, from one pass. Those of discrete columns need the rows: up to LOCAL_ROWS they are
    held by the driver as arrays; beyond, every evaluation is a pass that returns sums.
    """
    p, q = len(continuous), len(discrete)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in continuous], *[F.col(c).cast("string").alias(c) for c in discrete]).dropna()
    z = (standardize(rows, continuous) if continuous else rows).cache()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns[:p]], axis=1) if p else np.zeros((b.num_rows, 0))
            keys = list(zip(*(c.to_pylist() for c in b.columns[p:]), strict=True)) if q else [()] * b.num_rows
            at: dict = {}
            for k, key in enumerate(keys):
                at.setdefault(key, []).append(k)
            for key, rows_ in at.items():
                y = x[rows_]
                n, s, m = held.get(key, (0, np.zeros(p), np.zeros((p, p))))
                held[key] = (n + len(rows_), s + y.sum(axis=0), m + y.T @ y)
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(k) for k in keys], pa.list_(pa.string())), pa.array([held[k][0] for k in keys], pa.int64()), *(pa.array([held[k][j].tobytes() for k in keys], pa.binary()) for j in (1, 2))], names=["k", "n", "s", "m"]
        )

    sums = merged_sums(z.mapInArrow(run, "k array<string>, n long, s binary, m binary"), "k")
    cells = {tuple(r["k"]): (r["n"], np.frombuffer(r["s"]), np.frombuffer(r["m"]).reshape(p, p)) for r in sums}
    keys = sorted(cells)
    total = sum(cells[k][0] for k in keys)
    names = [sorted({k[j] for k in keys}) for j in range(q)]
    levels = [len(v) for v in names]
    at = np.cumsum([0, *levels])
    width = int(at[-1])
    count = np.array([cells[k][0] for k in keys], dtype=float) / total
    mean = np.array([cells[k][1] / cells[k][0] for k in keys]).reshape(len(keys), p)
    second = np.array([cells[k][2] / cells[k][0] for k in keys]).reshape(len(keys), p, p)
    dummy = np.zeros((len(keys), width))
    for i, k in enumerate(keys):
        for j in range(q):
            dummy[i, at[j] + names[j].index(k[j])] = 1
    block = np.zeros((width, width), dtype=bool)
    for j in range(q):
        block[at[j] : at[j + 1], at[j] : at[j + 1]] = True
    number = [{v: int(at[j]) + k for k, v in enumerate(names[j])} for j in range(q)]

    def discrete_part(x: np.ndarray, code: np.ndarray, w) -> tuple:
        """(negative log-likelihood of the discrete columns, its sums for alpha2, rho, phi) over rows with level numbers."""
        f = np.triu(w["phi"], 1)
        f = np.where(block, 0, f + f.T)
        base = w["alpha2"] + x @ w["rho"]
        for j in range(q):
            base = base + f[code[:, j]]
        diff = np.zeros_like(base)
        value = 0.0
        for j in range(q):
            s = slice(at[j], at[j + 1])
            score = base[:, s] - base[:, s].max(axis=1, keepdims=True)
            prob = np.exp(score)
            norm = prob.sum(axis=1, keepdims=True)
            own = code[:, j] - at[j]
            value -= float((score[np.arange(len(x)), own] - np.log(norm[:, 0])).sum())
            prob /= norm
            prob[np.arange(len(x)), own] -= 1
            diff[:, s] = prob
        d = np.zeros((len(x), width))
        for j in range(q):
            d[np.arange(len(x)), code[:, j]] = 1
        return value, diff.sum(axis=0), x.T @ diff, d.T @ diff

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:p]], axis=1) if p else np.zeros((b.num_rows, 0))
        return x, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[p:]], axis=1)

    code = [F.element_at(F.create_map(*[F.lit(v) for pair in n.items() for v in pair]), F.col(d)).cast("int").alias(d) for d, n in zip(discrete, number, strict=True)]
    coded = z.select(*continuous, *code).cache()
    held = [arrays(b) for b in coded.toArrow().to_batches()] if q and total <= LOCAL_ROWS else None

    def level_sums(w) -> tuple:
        if held is not None:
            parts = [discrete_part(x, c, w) for x, c in held if len(x)]
        else:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        v, *g = discrete_part(*arrays(b), w)
                        yield pa.RecordBatch.from_arrays([pa.array([v]), *(pa.array([m.tobytes()], pa.binary()) for m in g)], names=["v", "a", "r", "f"])

            shapes = ((width,), (p, width), (width, width))
            rows_ = merged_sums(coded.mapInArrow(run, "v double, a binary, r binary, f binary"))
            parts = [(r["v"], *(np.frombuffer(r[k]).reshape(shape) for k, shape in zip("arf", shapes, strict=True))) for r in rows_]
        return tuple(sum(x[k] for x in parts) / total for k in range(4))

    sizes = {"beta": (p, p), "betad": (p,), "rho": (p, width), "phi": (width, width), "alpha1": (p,), "alpha2": (width,)}

    def smooth(w):
        """(negative pseudo-log-likelihood for each row, gradient)."""
        beta, d, rho = w["beta"], w["betad"], w["rho"]
        b = np.triu(beta, 1)
        b = b + b.T
        g = {k: np.zeros(v) for k, v in sizes.items()}
        value = 0.0
        if p:
            # residual of column s: x_s - (alpha_s + dummies rho_s + x b_s) / d_s
            lin = w["alpha1"] + dummy @ rho.T  # cells x p
            m = np.eye(p) - b / d  # x m: the part in x
            c = lin / d
            xm = mean @ m
            sq = np.einsum("kij,is,js->ks", second, m, m) - 2 * xm * c + c * c
            value += float((count[:, None] * (sq * d / 2)).sum() - np.log(d).sum() / 2)
            r = xm - c  # mean residual of each cell
            xr = np.einsum("kij,js->kis", second, m) - mean[:, :, None] * c[:, None, :]  # E[x_i r_s]
            g["alpha1"] = -(count[:, None] * r).sum(axis=0)
            g["rho"] = -np.einsum("k,ks,kl->sl", count, r, dummy)
            gb = -np.einsum("k,kis->is", count, xr)
            g["beta"] = np.triu(gb + gb.T, 1)
            # with the residual x - e / d: derivative in d of d (x - e / d)^2 / 2 is (x^2 - e^2 / d^2) / 2
            e2 = np.einsum("kij,is,js->ks", second, b, b) + 2 * (mean @ b) * lin + lin * lin
            g["betad"] = (count[:, None] * (np.einsum("kii->ki", second) - e2 / d**2) / 2).sum(axis=0) - 1 / (2 * d)
        if q:
            extra, ga, gr, gf = level_sums(w)
            value += extra
            g["alpha2"], g["rho"], g["phi"] = ga, g["rho"] + gr, gf
        gphi = g["phi"] + g["phi"].T
        g["phi"] = np.where(block, 0, np.triu(gphi, 1))
        return value, g

    sd = [np.sqrt(count @ dummy * (1 - count @ dummy))[at[j] : at[j + 1]] for j in range(q)]
    weight = [float(np.sqrt((s * s).sum())) for s in sd]

    def prox(w, step):
        out = dict(w)
        out["beta"] = np.sign(w["beta"]) * np.maximum(np.abs(w["beta"]) - step * lam[0], 0)
        out["betad"] = np.maximum(w["betad"], 1e-3)
        rho, phi = w["rho"].copy(), w["phi"].copy()
        for j in range(q):
            s = slice(at[j], at[j + 1])
            size = np.linalg.norm(rho[:, s], axis=1, keepdims=True)
            rho[:, s] *= np.maximum(1 - step * lam[1] * weight[j] / np.maximum(size, 1e-300), 0)
            for i in range(j):
                u = slice(at[i], at[i + 1])
                size = np.linalg.norm(phi[u, s])
                phi[u, s] *= max(1 - step * lam[2] * weight[i] * weight[j] / max(size, 1e-300), 0)
        out["rho"], out["phi"] = rho, phi
        return out

    w = {k: np.zeros(v) for k, v in sizes.items()}
    w["betad"] = np.ones(p)
    ahead, t, step, last = w, 1.0, 1.0, math.inf
    for _ in range(rounds):
        value, grad = smooth(ahead)
        while True:  # halve the step until the quadratic bound holds
            new = prox({k: ahead[k] - step * grad[k] for k in w}, step)
            move = {k: new[k] - ahead[k] for k in w}
            bound = value + sum(float((grad[k] * move[k]).sum()) for k in w) + sum(float((v * v).sum()) for v in move.values()) / (2 * step)
            trial = smooth(new)[0]
            if trial <= bound + 1e-12 or step < 1e-12:
                break
            step /= 2
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = {k: new[k] + (t - 1) / t_next * (new[k] - w[k]) for k in w}
        ahead["betad"] = np.maximum(ahead["betad"], 1e-3)
        done = abs(last - trial) < tol * max(1.0, abs(trial)) and max(float(np.abs(new[k] - w[k]).max(initial=0)) for k in w) < tol * 10
        w, t, last = new, t_next, trial
        if done:
            break
    coded.unpersist()
    z.unpersist()
    return MixedModel(list(continuous), list(discrete), levels, w["beta"], w["rho"], w["phi"], last)


# stability


def _unit(ids: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from row ids, a replicate and a seed (SplitMix64)."""
    x = ids.astype(np.uint64) + np.uint64((replicate * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def bootstrap_stats(df: DataFrame, cols: list[str], replicates: int, seed: int, row_id: str, share: float | None = None) -> dict[int, SuffStats]:
    """Statistics of weighted replicates from one pass over the rows, which are never copied.

    A row's weight in a replicate comes from a hash of its id: Poisson(1), or 1 with
    probability `share` for subsamples; so a repeated task draws the same.
    """
    p = len(cols)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(0, np.zeros(p), np.zeros((p, p)))] * replicates
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            for r in range(replicates):
                u = _unit(ids, r, seed)
                w = np.searchsorted(steps, u, side="right").astype(float) if share is None else (u < share).astype(float)
                n = int(w.sum())
                if n:
                    mu = w @ x / n
                    d = x - mu
                    held[r] = _merge(held[r], (n, mu, (d * w[:, None]).T @ d))
        for r, (n, mean, m2) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()]), pa.array([m2.tobytes()])], names=["r", "n", "mean", "m2"])

    rows = df.select(F.col(row_id).cast("long").alias(row_id), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    parts = merged_moments(rows.mapInArrow(run, "r int, n long, mean binary, m2 binary"), p, "r")
    return {r["r"]: SuffStats(list(cols), r["n"], np.frombuffer(r["m2"]).reshape(p, p) / max(r["n"] - 1, 1), np.frombuffer(r["mean"])) for r in sorted(parts, key=lambda r: r["r"])}


def edge_frequencies(stats: dict[int, SuffStats], alpha: float, depth: int = -1) -> dict[tuple[str, str], float]:
    """How often each adjacency is in the skeleton of a replicate."""
    out: dict[tuple[str, str], float] = {}
    for s in stats.values():
        g, _ = skeleton(FisherZ(s, alpha), depth)
        for a, b, _, _ in g.edges():
            key = (min(a, b), max(a, b))
            out[key] = out.get(key, 0.0) + 1 / len(stats)
    return out


def bootstrap_frequencies(df: DataFrame, cols: list[str], replicates: int, seed: int, row_id: str, alpha: float = 0.05) -> DataFrame:
    """(src, dst, frequency) over weighted bootstrap replicates."""
    f = edge_frequencies(bootstrap_stats(df, cols, replicates, seed, row_id), alpha)
    return df.sparkSession.createDataFrame([(a, b, v) for (a, b), v in sorted(f.items())], "src string, dst string, frequency double")


def stability(frequencies: dict[tuple[str, str], float], p: int) -> float:
    """Mean of 2 f (1 - f) over all pairs."""
    return sum(2 * f * (1 - f) for f in frequencies.values()) / (p * (p - 1) / 2)


def stars(df: DataFrame, cols: list[str], alphas: list[float], row_id: str, replicates: int = 20, threshold: float = 0.05, seed: int = 0) -> float:
    """The largest alpha, from the largest down, whose instability does not pass the threshold; the smallest if none."""
    n = df.count()
    share = min(0.75, 10 * math.sqrt(n) / n)
    stats = bootstrap_stats(df, cols, replicates, seed, row_id, share)
    for a in sorted(alphas, reverse=True):
        if stability(edge_frequencies(stats, a), len(cols)) <= threshold:
            return a
    return min(alphas)


def steps(df: DataFrame, continuous: list[str], discrete: list[str], lambdas: list[float], row_id: str, replicates: int = 10, threshold: float = 0.05, seed: int = 0) -> tuple[float, float, float]:
    """A penalty for each kind of edge: the smallest with all larger ones stable, over subsamples of a mixed model."""
    n = df.count()
    share = min(0.75, 10 * math.sqrt(n) / n)
    rows = subsamples(df.select(row_id, *continuous, *discrete), replicates, share, seed, row_id)
    kind = lambda a, b: (a in discrete) + (b in discrete)
    pairs = [len(continuous) * (len(continuous) - 1) / 2, len(continuous) * len(discrete), len(discrete) * (len(discrete) - 1) / 2]
    best, open_ = [max(lambdas)] * 3, [True] * 3
    for lam in sorted(lambdas, reverse=True):
        counts: dict = {}
        for r in range(replicates):
            for a, b, _, _ in mgm(rows.where(F.col("replicate") == r), continuous, discrete, (lam, lam, lam)).graph().edges():
                counts[frozenset((a, b))] = counts.get(frozenset((a, b)), 0) + 1
        for k in range(3):
            f = [c / replicates for e, c in counts.items() if kind(*e) == k]
            unstable = sum(2 * x * (1 - x) for x in f) / pairs[k] if pairs[k] else 0.0
            open_[k] = open_[k] and unstable <= threshold
            if open_[k]:
                best[k] = lam
    return tuple(best)


def complementary_pairs_bound(q: float, p: float, tau: float, pairs: int) -> float:
    """Expected number of wrongly selected edges among p with q selected on average, at threshold tau (unimodal bound)."""
    theta = q / p
    if tau <= 0.5:
        return p
    if tau <= 0.75:
        spread = 2 * tau - 1 - 1 / (2 * pairs)
        return theta * theta * p / (2 * spread) if spread > 0 else p
    return 4 * (1 - tau + 1 / (2 * pairs)) / (1 + 1 / pairs) * theta * theta * p


def preferential_diversity(relevance: dict[str, float], stats: SuffStats, k: int, radius: float = 0.5, share: float = 0.5) -> list[str]:
    """k variables of high relevance that are not redundant: among each k best, one whose correlation with a chosen one
    passes the radius is put off; at least a share of each round is taken as it comes."""
    order = sorted(relevance, key=lambda v: (-relevance[v], v))
    corr, chosen, put_off = np.abs(stats.corr), [], []
    near = lambda a, b: corr[stats.index[a], stats.index[b]] > radius
    while order and len(chosen) < k:
        head, order = order[:k], order[k:]
        need, taken = math.ceil(share * len(head)), 0
        later = []
        for v in head:
            if len(chosen) >= k:
                break
            if any(near(v, u) for u in chosen):
                later.append(v)
            else:
                chosen.append(v)
                taken += 1
        for v in later:
            if taken < need and len(chosen) < k:
                chosen.append(v)
                taken += 1
            else:
                put_off.append(v)
    return (chosen + put_off)[:k] if len(chosen) < k else chosen
