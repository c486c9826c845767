"""Tests that need pairs of rows: they take a bounded, seeded sample, whose size is a parameter."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import gamma_cdf, normal_cdf
from .independence import Test

#: Rows of a Gram matrix, at most.
ROWS = 500


def sample_rows(df: DataFrame, cols: list[str], row_id: str, rows: int = ROWS, seed: int = 0) -> np.ndarray:
    """The rows with the smallest hashes of id and seed."""
    picked = df.dropna(subset=cols).orderBy(F.xxhash64(F.col(row_id), F.lit(seed))).limit(rows)
    return np.array([[float(v) for v in r] for r in picked.select(*cols).collect()]).reshape(-1, len(cols))


def gram(x: np.ndarray) -> np.ndarray:
    """Gaussian kernel with the median distance as width."""
    x = x.reshape(len(x), -1)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    width = np.median(d[d > 0]) if (d > 0).any() else 1.0
    return np.exp(-d / width)


def _centred(k: np.ndarray) -> np.ndarray:
    return k - k.mean(axis=0) - k.mean(axis=1)[:, None] + k.mean()


def hsic_p_value(x: np.ndarray, y: np.ndarray) -> float:
    """Hilbert-Schmidt independence criterion against its gamma approximation."""
    n = len(x)
    k, m = gram(x), gram(y)
    kc, mc = _centred(k), _centred(m)
    stat = float((kc * mc).sum()) / n
    off = lambda a: (a.sum() - np.trace(a)) / (n * (n - 1))
    mean = (1 + off(k) * off(m) - off(k) - off(m)) / n
    v = (kc * mc / 6) ** 2
    var = (v.sum() - np.trace(v)) / n / (n - 1) * 72 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3))
    return 1 - gamma_cdf(stat, mean * mean / var, var * n / mean) if var > 0 and mean > 0 else 1.0


class Kci(Test):
    """Kernel test of residual kernels: x and y given z, by the gamma approximation of the null."""

    def __init__(self, data: np.ndarray, names: list[str], alpha: float = 0.05, ridge: float = 1e-3) -> None:
        self.data = (data - data.mean(axis=0)) / data.std(axis=0)
        self.variables, self.alpha, self.ridge = names, alpha, ridge

    def p_value(self, x, y, z=()):
        at = lambda vs: self.data[:, [self.variables.index(v) for v in vs]]
        if not z:
            return hsic_p_value(at([x]), at([y]))
        n = len(self.data)
        kz = _centred(gram(at(list(z))))
        r = self.ridge * n * np.linalg.inv(kz + self.ridge * n * np.eye(n))
        kx, ky = (r @ _centred(gram(at(v))) @ r for v in ([x, *z], [y]))
        stat = float((kx * ky).sum())
        prod = kx * ky
        mean, var = float(np.trace(kx) * np.trace(ky)) / n, 2 * float((kx * kx).sum() * (ky * ky).sum()) / n / n
        return 1 - gamma_cdf(stat, mean * mean / var, var / mean) if var > 0 and prod.any() else 1.0


def anderson_darling_normal(df: DataFrame, col: str) -> tuple[float, float]:
    """(A2 adjusted for estimated mean and deviation, p-value), from the counts of distinct values; nulls do not count."""
    from .transforms import counted

    n, mean, sd = df.agg(F.count(col), F.avg(col), F.stddev_samp(col)).first()
    if not n or not sd:
        return float("nan"), float("nan")

    @F.pandas_udf("double")
    def below(v: pd.Series) -> pd.Series:
        return v.map(lambda x: min(max(normal_cdf(x, mean, sd), 1e-15), 1 - 1e-15))

    counts, _ = counted(df, col, "double")
    # c rows from rank k + 1 on share a value: sums of 2 i - 1 over their ranks, and over the reverse ones
    c, k, u = F.col("n").cast("double"), F.col("below").cast("double"), F.col("u")
    ranks = c * c + 2 * k * c
    total = counts.withColumn("u", below("v")).agg(F.sum(ranks * F.log(u) + (2 * n * c - ranks) * F.log(1 - u))).first()[0]
    a2 = (-n - total / n) * (1 + 0.75 / n + 2.25 / n / n)
    cut = [(0.2, lambda a: 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)), (0.34, lambda a: 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)), (0.6, lambda a: math.exp(0.9177 - 4.279 * a - 1.38 * a * a))]
    return a2, next((f(a2) for b, f in cut if a2 < b), math.exp(1.2937 - 5.709 * a2 + 0.0186 * a2 * a2) if a2 < 153 else 0.0)
