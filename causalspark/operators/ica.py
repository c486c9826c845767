"""Linear models with non-normal errors from independent components, over all rows.

Components are found by fixed-point rounds on whitened rows. A round is one pass over the table
that returns p x p sums from each task, so no row reaches the driver. `lingam` reads an acyclic
model from the unmixing matrix; `ling` lists all models, cycles allowed, that fit it, and which of
them come to rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.suffstats import SuffStats, merged_sums, sufficient_stats
from .graph import ARROW, TAIL, Graph
from .search import assignment


@dataclass
class Unmixing:
    """w: rows give the components of centred variables, each with variance 1."""

    stats: SuffStats
    w: np.ndarray
    converged: bool
    rounds: int


def _orthogonal(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(values**-0.5) @ vectors.T @ w


def independent_components(df: DataFrame, cols: list[str], rounds: int = 200, tolerance: float = 1e-5, seed: int = 0) -> Unmixing:
    """All components at once, with the logarithm of cosh as contrast; rows with missing values do not count.

    Ends where no component turns by more than the tolerance (1 less the cosine); `converged`
    tells whether it did within so many rounds.
    """
    stats = sufficient_stats(df, cols)
    p = len(cols)
    values, vectors = np.linalg.eigh(stats.cov)
    if values[0] <= 1e-12 * values[-1]:
        raise ValueError("some variables are linear combinations of others")
    whiten = (vectors / np.sqrt(values)).T
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    w = _orthogonal(np.random.default_rng(seed).normal(size=(p, p)))
    for k in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w=w, means=stats.means) -> Iterator[pa.RecordBatch]:
            n, first, second = 0, np.zeros((p, p)), np.zeros(p)
            for b in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                z = (x[np.isfinite(x).all(axis=1)] - means) @ whiten.T
                g = np.tanh(z @ w.T)
                n += len(z)
                first += g.T @ z
                second += (1 - g * g).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([first.tobytes()], pa.binary()), pa.array([second.tobytes()], pa.binary())], names=["n", "first", "second"])

        r = merged_sums(rows.mapInArrow(run, "n long, first binary, second binary"))[0]
        step = np.frombuffer(r["first"]).reshape(p, p) / r["n"] - np.diag(np.frombuffer(r["second"]) / r["n"]) @ w
        new = _orthogonal(step)
        turned = float(np.max(1 - np.abs((new * w).sum(axis=1))))
        w = new
        if turned < tolerance:
            return Unmixing(stats, w @ whiten, True, k + 1)
    return Unmixing(stats, w @ whiten, False, rounds)


def lingam(found: Unmixing, threshold: float = 0.05) -> tuple[Graph, np.ndarray]:
    """(DAG, coefficients b[i, j] of j in i): causes first, then regressions on all earlier variables; small ones go."""
    names, stats, p = found.stats.names, found.stats, len(found.stats.names)
    w = found.w[assignment(1 / np.maximum(np.abs(found.w), 1e-12))]
    b = np.eye(p) - w / np.diag(w)[:, None]
    left, order = list(range(p)), []
    while left:  # the row with the least dependence on those left is the next cause
        k = min(left, key=lambda i: sum(b[i, j] ** 2 for j in left if j != i))
        order.append(k)
        left.remove(k)
    coef, g = np.zeros((p, p)), Graph(names)
    for k, i in enumerate(order[1:], 1):
        coef[i, order[:k]] = stats.regress(names[i], [names[j] for j in order[:k]])[0]
    coef[np.abs(coef) <= threshold] = 0.0
    for i, j in np.argwhere(coef).tolist():
        g.add_edge(names[j], names[i])
    return g, coef


@dataclass
class CyclicModel:
    """b[i, j]: effect of j on i; stable if effects around cycles die away."""

    names: list[str]
    b: np.ndarray
    stable: bool

    def edges(self) -> list[tuple[str, str, float]]:
        return [(self.names[j], self.names[i], float(self.b[i, j])) for i, j in np.argwhere(self.b).tolist()]

    def graph(self) -> Graph:
        """Edges of the model; two variables that cause each other get an arrow at both ends."""
        g = Graph(self.names)
        for a, b, _ in self.edges():
            if g.adjacent(a, b):
                g.set_mark(a, b, ARROW)
            else:
                g.add_edge(a, b, TAIL, ARROW)
        return g


def zeroless_orders(some: np.ndarray) -> Iterator[list[int]]:
    """Every order of rows that leaves no empty cell on the diagonal; some[i, j] tells whether a cell is not empty."""
    p = len(some)
    columns = sorted(range(p), key=lambda j: int(some[:, j].sum()))  # those with fewest choices first

    def place(k: int, rows: dict[int, int]) -> Iterator[dict[int, int]]:
        if k == p:
            yield rows
            return
        j = columns[k]
        for i in np.flatnonzero(some[:, j]).tolist():
            if i not in rows.values():
                yield from place(k + 1, rows | {j: i})

    for rows in place(0, {}):
        yield [rows[j] for j in range(p)]


def ling(found: Unmixing, threshold: float = 0.1) -> list[CyclicModel]:
    """All models that the unmixing matrix allows, the stable ones first.

    Cells whose size is under the threshold times the largest of their row count as empty. Models
    of one list have the same distribution.
    """
    w, p = found.w, len(found.stats.names)
    some = np.abs(w) >= threshold * np.abs(w).max(axis=1)[:, None]
    pruned = np.where(some, w, 0.0)
    out = []
    for order in zeroless_orders(some):
        d = pruned[order]
        b = np.eye(p) - d / np.diag(d)[:, None]
        np.fill_diagonal(b, 0.0)
        out.append(CyclicModel(list(found.stats.names), b, bool(np.abs(np.linalg.eigvals(b)).max() < 1)))
    return sorted(out, key=lambda m: (not m.stable, [e[:2] for e in m.edges()]))
