"""Non-linear tests of independence over all rows, by random features.

Columns are standardised and mapped to cosines of random frequencies, whose products stand for a
Gaussian kernel. Regression on the features of the conditioning columns smooths them out. Both
tests take two passes for any number of questions: one for means and covariances of the features
(for the regressions), one for moments of the residuals. Tasks return sums of the size of the
features; no row, pair of rows or Gram matrix reaches the driver.

`FeatureKernel` compares cross-covariances of residual features with their null distribution (the
kernel test of conditional independence; the Hilbert-Schmidt criterion where nothing is given).
`ResidualPowers` asks whether powers of the residuals of both variables are correlated.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import gamma_cdf, normal_cdf
from ..plans.suffstats import _merge, merged_moments, merged_sums, sufficient_stats
from .independence import Test

Question = tuple[str, str, tuple[str, ...]]


class _Features:
    """sqrt(2) cos(w v + b) of some standardised columns; frequencies depend on their names and the seed only."""

    def __init__(self, at: list[int], names: Iterable[str], many: int, seed: int) -> None:
        r = np.random.default_rng([seed, zlib.crc32("\x00".join(names).encode())])
        self.at, self.many = at, many
        self.w = r.normal(size=(len(at), many)) / math.sqrt(max(len(at), 1))
        self.b = r.uniform(0, 2 * np.pi, many)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2) * np.cos(x[:, self.at] @ self.w + self.b)


def _standard(batches: Iterator[pa.RecordBatch], means: np.ndarray, sd: np.ndarray) -> Iterator[np.ndarray]:
    """Standardised rows in which all columns are present and finite, in pieces."""
    for b in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
        x = x[np.isfinite(x).all(axis=1)]
        for k in range(0, len(x), 4096):
            yield (x[k : k + 4096] - means) / sd


def _residuals(x: np.ndarray, maps: tuple, fit: tuple) -> tuple[np.ndarray, np.ndarray]:
    left, right, given = maps
    r = np.concatenate((left(x), right(x)), axis=1) - fit[0] - (given(x) - fit[1]) @ fit[2]
    return r[:, : left.many], r[:, left.many :]


class _AllRows(Test):
    """Keeps standardised columns of the rows in which all of them are present and finite, and answers seen before."""

    def __init__(self, df: DataFrame, cols: list[str], alpha: float, given: int, seed: int) -> None:
        self.df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        self.variables, self.alpha, self.given, self.seed = list(cols), alpha, given, seed
        self.stats = sufficient_stats(self.df, self.variables)
        sd = np.sqrt(np.diag(self.stats.cov))
        self.scale = self.stats.means, np.where(sd > 0, sd, 1.0)
        self.answers: dict[Question, float] = {}

    def _question(self, x: str, y: str, z) -> Question:
        order = self.stats.index.get
        return (*sorted((x, y), key=order), tuple(sorted(z, key=order)))

    def _given(self, z: tuple[str, ...]) -> _Features:
        return _Features([self.stats.index[v] for v in z], z, self.given if z else 0, self.seed + 1)

    def _sides(self, q: Question) -> tuple:
        """Maps of the standardised rows to what is tested of either variable."""
        raise NotImplementedError

    def _regressions(self, questions: list[Question]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(means of both sides, means of the given features, coefficients) for each question; one pass for each number of features."""
        out: list = [None] * len(questions)
        scale = self.scale
        for conditional in (False, True):
            chosen = [k for k, q in enumerate(questions) if bool(q[2]) == conditional]
            if not chosen:
                continue
            maps = [(*self._sides(questions[k]), self._given(questions[k][2])) for k in chosen]
            sides = sum(m.many for m in maps[0][:2])
            p = sides + maps[0][2].many

            def run(batches: Iterator[pa.RecordBatch], maps=maps, p=p) -> Iterator[pa.RecordBatch]:
                held = [(0, np.zeros(p), np.zeros((p, p)))] * len(maps)
                for x in _standard(batches, *scale):
                    for k, m in enumerate(maps):
                        f = np.concatenate([g(x) for g in m], axis=1)
                        mu = f.mean(axis=0)
                        held[k] = _merge(held[k], (len(f), mu, (f - mu).T @ (f - mu)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(maps)), pa.int32()), pa.array([h[0] for h in held], pa.int64()), *(pa.array([h[j].tobytes() for h in held], pa.binary()) for j in (1, 2))],
                    names=["k", "n", "mean", "m2"],
                )

            for r in merged_moments(self.df.mapInArrow(run, "k int, n long, mean binary, m2 binary"), p, "k"):
                mean, cov = np.frombuffer(r["mean"]), np.frombuffer(r["m2"]).reshape(p, p) / max(r["n"], 1)
                zz = cov[sides:, sides:]
                ridge = 1e-6 * np.trace(zz) / max(len(zz), 1) * np.eye(len(zz))
                out[chosen[r["k"]]] = mean[:sides], mean[sides:], np.linalg.solve(zz + ridge, cov[sides:, :sides]) if len(zz) else np.zeros((0, sides))
        return out

    def prefetch(self, tests: Iterable[tuple]) -> None:
        """Answer many questions (x, y, z) together."""
        questions = list(dict.fromkeys(q for q in (self._question(*t) for t in tests) if q not in self.answers))
        if questions:
            self.answers |= dict(zip(questions, self._answers(questions, self._regressions(questions)), strict=True))

    def p_value(self, x, y, z=()):
        self.prefetch([(x, y, z)])
        return self.answers[self._question(x, y, z)]

    def _sums(self, questions: list[Question], fits: list, size: int, of_residuals) -> tuple[int, np.ndarray]:
        """(rows, sums of of_residuals(left, right) for each question); one pass."""
        maps, scale = [(*self._sides(q), self._given(q[2])) for q in questions], self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros((len(maps), size))
            for x in _standard(batches, *scale):
                n += len(x)
                for k, (m, fit) in enumerate(zip(maps, fits, strict=True)):
                    total[k] += of_residuals(*_residuals(x, m, fit)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

        r = merged_sums(self.df.mapInArrow(run, "n long, total binary"))[0]
        return r["n"], np.frombuffer(r["total"]).reshape(len(maps), size)

    def _answers(self, questions: list[Question], fits: list) -> list[float]:
        raise NotImplementedError


class FeatureKernel(_AllRows):
    """Kernel test with so many random features of either variable and of the conditioning ones.

    n times the squared norm of the cross-covariance of residual features is compared with a
    gamma distribution that has the mean and variance of its null distribution, from the
    covariances of products of residuals.
    """

    def __init__(self, df: DataFrame, cols: list[str], alpha: float = 0.05, features: int = 5, given: int = 60, seed: int = 0) -> None:
        super().__init__(df, cols, alpha, given, seed)
        self.features = features

    def _sides(self, q):
        return tuple(_Features([self.stats.index[v]], [v], self.features, self.seed) for v in q[:2])

    def _answers(self, questions, fits):
        p = self.features**2
        n, sums = self._sums(questions, fits, p + p * p, _products)
        out = []
        for s in sums:
            mean = s[:p] / max(n, 1)
            spread = s[p:].reshape(p, p) / max(n, 1) - np.outer(mean, mean)
            first, second = float(np.trace(spread)), 2 * float((spread * spread).sum())
            out.append(max(0.0, 1 - gamma_cdf(n * float(mean @ mean), first * first / second, second / first)) if first > 0 else 1.0)
        return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of products of either side's residuals, and of the products of these."""
    u = (left[:, :, None] * right[:, None, :]).reshape(len(left), -1)
    return np.concatenate((u.sum(axis=0), (u.T @ u).ravel()))


def _moments(left: np.ndarray, right: np.ndarray, top: int) -> np.ndarray:
    """Sums of products of powers 0 to top - 1 of either side."""
    x, y = (np.power(v, np.arange(top)) for v in (left, right))
    return x.T @ y


class _One:
    """A standardised column as it is."""

    many = 1

    def __init__(self, at: int) -> None:
        self.at = at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x[:, [self.at]]


class ResidualPowers(_AllRows):
    """Correlations of powers (up to `powers`) of the residuals of both variables, without assuming normality.

    The p-value is that of the largest of all statistics, as it is, or times their number if
    `corrected`.
    """

    def __init__(self, df: DataFrame, cols: list[str], alpha: float = 0.05, powers: int = 4, given: int = 60, corrected: bool = False, seed: int = 0) -> None:
        super().__init__(df, cols, alpha, given, seed)
        self.powers, self.corrected = powers, corrected

    def _sides(self, q):
        return tuple(_One(self.stats.index[v]) for v in q[:2])

    def _answers(self, questions, fits):
        top = 2 * self.powers + 1
        n, sums = self._sums(questions, fits, top * top, partial(_moments, top=top))
        out = []
        for s in sums.reshape(-1, top, top) / max(n, 1):
            largest = 0.0
            for i in range(1, self.powers + 1):
                for j in range(1, self.powers + 1):
                    a, b = s[i, 0], s[0, j]
                    va, vb = s[2 * i, 0] - a * a, s[0, 2 * j] - b * b
                    if va <= 0 or vb <= 0:
                        continue
                    r = float(np.clip((s[i, j] - a * b) / math.sqrt(va * vb), -1 + 1e-15, 1 - 1e-15))
                    # the mean of (u - a)^2 (v - b)^2 by the moments of powers
                    both = s[2 * i, 2 * j] - 2 * b * s[2 * i, j] - 2 * a * s[i, 2 * j] + 4 * a * b * s[i, j]
                    both += b * b * s[2 * i, 0] + a * a * s[0, 2 * j] - 3 * a * a * b * b
                    t2 = both / (va * vb)
                    largest = max(largest, abs(math.sqrt(n) * math.atanh(r) / math.sqrt(t2)) if t2 > 0 else 0.0)
            p = 2 * (1 - normal_cdf(largest))
            out.append(min(1.0, p * self.powers**2) if self.corrected else p)
        return out
