"""Tests of mixed columns by nested regressions, and Bayesian tests of a constraint."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from .independence import Test, _Discrete
from .scores import BDeu


class MixedRegression(Test):
    """Likelihood ratio of x's terms in the regression of y on x and z.

    A continuous y has a linear model, a discrete one a multinomial logistic model; discrete
    predictors enter as indicators of all levels but the first. With both given, the larger
    p-value of the two directions counts. Each Newton round is a pass that returns sums.
    """

    def __init__(self, df: DataFrame, discrete: list[str], continuous: list[str], alpha: float = 0.05, most_levels: int = 50) -> None:
        self.variables, self.alpha = [*discrete, *continuous], alpha
        self.discrete = set(discrete)
        self._df = df.select(*[F.col(c).cast("string").alias(c) for c in discrete], *[F.col(c).cast("double").alias(c) for c in continuous]).dropna()
        self._levels: dict[str, list[str]] = {}
        for d in discrete:
            found = [r[0] for r in self._df.select(d).distinct().orderBy(d).limit(most_levels + 1).collect()]
            if len(found) > most_levels:
                raise ValueError(f"{d} has more than {most_levels} levels")
            self._levels[d] = found
        self._memo: dict = {}

    def _terms(self, names) -> list:
        out = []
        for v in names:
            out += [(F.col(v) == level).cast("double") for level in self._levels[v][1:]] if v in self.discrete else [F.col(v)]
        return out

    def _loglik(self, y: str, names: tuple) -> tuple[float, int]:
        """(log-likelihood, number of coefficients)."""
        key = (y, names)
        if key not in self._memo:
            terms = self._terms(names)
            self._memo[key] = self._multinomial(y, terms) if y in self.discrete else self._linear(y, terms)
        return self._memo[key]

    def _linear(self, y: str, terms: list) -> tuple[float, int]:
        from ..plans.suffstats import sufficient_stats

        cols = self._df.select(F.col(y).alias("_y"), *[t.alias(f"_x{k}") for k, t in enumerate(terms)])
        s = sufficient_stats(cols)
        c = s.cov[0, 1:] @ np.linalg.pinv(s.cov[1:, 1:]) @ s.cov[0, 1:] if terms else 0.0
        rss = (s.n - 1) * (s.cov[0, 0] - c)
        return -0.5 * s.n * (math.log(2 * math.pi * rss / s.n) + 1), len(terms) + 1

    def _multinomial(self, y: str, terms: list, rounds: int = 40) -> tuple[float, int]:
        levels = self._levels[y]
        k, p = len(levels), len(terms) + 1
        code = F.element_at(F.create_map(*[F.lit(v) for pair in ((n, i) for i, n in enumerate(levels)) for v in pair]), F.col(y)).cast("int")
        rows = self._df.select(code.alias("_y"), *[t.alias(f"_x{i}") for i, t in enumerate(terms)])
        w, like, last = np.zeros((k - 1, p)), -math.inf, -math.inf
        for _ in range(rounds):

            def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
                h, g, v = np.zeros(((k - 1) * p,) * 2), np.zeros((k - 1) * p), 0.0
                for b in batches:
                    if b.num_rows:
                        c = b.column(0).to_numpy(zero_copy_only=False)
                        x = np.stack([np.ones(b.num_rows), *(z.to_numpy(zero_copy_only=False) for z in b.columns[1:])], axis=1)
                        score = np.concatenate((np.zeros((len(x), 1)), x @ w.T), axis=1)
                        score -= score.max(axis=1, keepdims=True)
                        q = np.exp(score)
                        norm = q.sum(axis=1)
                        v += float((score[np.arange(len(x)), c] - np.log(norm)).sum())
                        q = (q / norm[:, None])[:, 1:]
                        hit = np.eye(k)[c][:, 1:]
                        g += ((hit - q).T @ x).ravel()
                        for i in range(k - 1):
                            for j in range(k - 1):
                                part = q[:, i] * ((i == j) - q[:, j])
                                h[i * p : (i + 1) * p, j * p : (j + 1) * p] += (x * part[:, None]).T @ x
                yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()]), pa.array([g.tobytes()]), pa.array([v])], names=["h", "g", "v"])

            r = merged_sums(rows.mapInArrow(run, "h binary, g binary, v double"))[0]
            h, g, like = np.frombuffer(r["h"]).reshape((k - 1) * p, (k - 1) * p), np.frombuffer(r["g"]), r["v"]
            if like - last < 1e-8 * abs(like):
                break
            last = like
            w = w + (np.linalg.lstsq(h + 1e-9 * np.eye(len(g)), g, rcond=None)[0]).reshape(k - 1, p)
        return like, (k - 1) * p

    def _one_way(self, x: str, y: str, z: tuple) -> float:
        (big, m), (small, n) = self._loglik(y, tuple(sorted((x, *z)))), self._loglik(y, tuple(sorted(z)))
        return chi2_sf(2 * (big - small), m - n)

    def p_value(self, x, y, z=()):
        z = tuple(z)
        if x in self.discrete and y not in self.discrete:
            return self._one_way(x, y, z)
        if y in self.discrete and x not in self.discrete:
            return self._one_way(y, x, z)
        return max(self._one_way(x, y, z), self._one_way(y, x, z))


class BayesianConstraint(Test):
    """Posterior probability of independence from Dirichlet likelihoods with and without the edge; independent above one half."""

    def __init__(self, data: DataFrame | _Discrete, cols: list[str] | None = None, prior: float = 0.5, sample: float = 1.0) -> None:
        self._score = BDeu(data, cols, sample, 0.0)
        self.variables, self.prior, self.alpha = self._score.variables, prior, 0.5

    def p_value(self, x, y, z=()):
        gain = self._score.local(y, [x, *z]) - self._score.local(y, list(z)) + math.log((1 - self.prior) / self.prior)
        return 1 / (1 + math.exp(min(gain, 700)))
