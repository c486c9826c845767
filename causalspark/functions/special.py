"""Distribution functions and their inverses on plain floats; no scipy needed."""

from __future__ import annotations

import math

import numpy as np
from statistics import NormalDist

_STD = NormalDist()


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc(-(x - mean) / (sd * math.sqrt(2)))


def normal_quantile(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _STD.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * scale)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - scale * h)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


def chi2_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if df <= 0 else max(0.0, 1 - chi2_cdf(x, df))


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t < 0 else 1 - tail


def f_cdf(f: float, d1: float, d2: float) -> float:
    return 0.0 if f <= 0 else beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))


def gamma_cdf(x: float, shape: float, scale: float = 1.0) -> float:
    return gamma_p(shape, x / scale)


def beta_cdf(x: float, a: float, b: float) -> float:
    return beta_inc(a, b, x)


def binomial_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else 1 - beta_inc(k + 1, n - k, p)


def poisson_cdf(k: int, mean: float) -> float:
    return 0.0 if k < 0 else 1 - gamma_p(k + 1, mean)


def cauchy_cdf(x: float, location: float = 0.0, scale: float = 1.0) -> float:
    return 0.5 + math.atan((x - location) / scale) / math.pi


def cauchy_quantile(p: float, location: float = 0.0, scale: float = 1.0) -> float:
    return location + scale * math.tan(math.pi * (p - 0.5))


def quantile(cdf, p: float, low: float, high: float, *args: float) -> float:
    """Inverse of a monotone distribution function by bisection; the range widens as needed."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    while math.isfinite(high) and cdf(high, *args) < p and high < 1e300:
        high *= 2
    while low < 0 and cdf(low, *args) > p and low > -1e300:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid, *args) < p else (low, mid)
    return (low + high) / 2


def chi2_quantile(p: float, df: float) -> float:
    return quantile(chi2_cdf, p, 0.0, max(df, 1.0) * 4, df)


def t_quantile(p: float, df: float) -> float:
    return quantile(t_cdf, p, -10.0, 10.0, df)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return quantile(f_cdf, p, 0.0, 10.0, d1, d2)


def gamma_quantile(p: float, shape: float, scale: float = 1.0) -> float:
    return quantile(gamma_cdf, p, 0.0, 4 * shape * scale + 1, shape, scale)


def beta_quantile(p: float, a: float, b: float) -> float:
    return quantile(beta_cdf, p, 0.0, 1.0, a, b)


def binomial_quantile(p: float, n: int, prob: float) -> int:
    return next(k for k in range(n + 1) if binomial_cdf(k, n, prob) >= p - 1e-12)


def poisson_quantile(p: float, mean: float) -> int:
    k = 0
    while poisson_cdf(k, mean) < p - 1e-12:
        k += 1
    return k


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def z_for_alpha(alpha: float) -> float:
    return normal_quantile(1 - alpha / 2)


def fdr_cutoff(alpha: float, p_values: list[float], dependent: bool = True) -> tuple[float, int]:
    """(cutoff p-value, index of the last p-value within its bound, -1 if none).

    Bounds are alpha * (k + 1) / (c * (m + 1)) for the k-th smallest of m, with m + 1 in the
    denominator; c is the harmonic sum up to k + 1 if the tests may depend on each other.
    """
    ordered, index, harmonic = sorted(p_values), -1, 0.0
    for k, p in enumerate(ordered):
        harmonic += 1 / (k + 1)
        if p < alpha * (k + 1) / ((harmonic if dependent else 1.0) * (len(ordered) + 1)):
            index = k
    return (ordered[index] if index >= 0 else 0.0), index


def log_gamma(x) -> np.ndarray:
    """ln of the gamma function of positive numbers, element by element: Stirling's series above 10, recurrence below."""
    x = np.asarray(x, dtype=np.float64)
    below, shift = x.copy(), np.zeros_like(x)
    for _ in range(10):
        low = below < 10
        shift = shift + np.where(low, np.log(np.where(low, below, 1.0)), 0.0)
        below = np.where(low, below + 1, below)
    inverse = 1 / below
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return (below - 0.5) * np.log(below) - below + 0.5 * np.log(2 * np.pi) + series - shift
