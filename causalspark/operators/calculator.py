"""Row-wise formulas: text to an expression tree to a Column.

Numbers, variables, infix + - * / ^ and comparisons, and functions in prefix form, such as
`Y = ln(X) + max(Z, 2) * IF(X > 3, 1, 0)`. Comparisons and logic give 1 and 0. Random
functions draw by a seed and the place of the call in the formula.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transforms import unit_hash

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_][A-Za-z0-9_.:]*|`[^`]+`)|(<=|>=|[-+*/^(),<>=]))")


def parse(text: str) -> tuple:
    """Tree of ("num", x), ("var", name) and ("call", name, [trees])."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r} at {at}")
        tokens.append(("num", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    tokens.append(("end", ""))
    pos = 0

    def peek():
        return tokens[pos]

    def take(value: str | None = None):
        nonlocal pos
        t = tokens[pos]
        if value is not None and t[1] != value:
            raise ValueError(f"expected {value!r}, found {t[1]!r}")
        pos += 1
        return t

    levels = [("<", "<=", ">", ">=", "="), ("+", "-"), ("*", "/")]

    def binary(level: int) -> tuple:
        if level == len(levels):
            return unary()
        left = binary(level + 1)
        while peek()[0] == "op" and peek()[1] in levels[level]:
            left = ("call", take()[1], [left, binary(level + 1)])
        return left

    def unary() -> tuple:
        if peek() == ("op", "-"):
            take()
            return ("call", "-", [("num", 0.0), unary()])
        if peek() == ("op", "+") and tokens[pos + 1] != ("op", "("):
            take()
            return unary()
        return power()

    def power() -> tuple:
        left = atom()
        if peek() == ("op", "^"):
            take()
            return ("call", "^", [left, unary()])
        return left

    def arguments() -> list:
        take("(")
        out = []
        if peek()[1] != ")":
            out.append(binary(0))
            while peek()[1] == ",":
                take()
                out.append(binary(0))
        take(")")
        return out

    def atom() -> tuple:
        kind, value = take()
        if kind == "num":
            return ("num", float(value))
        if kind == "name":
            return ("call", value, arguments()) if peek()[1] == "(" else ("var", value.strip("`"))
        if value == "(":
            inner = binary(0)
            take(")")
            return inner
        if value in ("+", "*", "<", "<=", ">", ">=", "="):
            return ("call", value, arguments())
        raise ValueError(f"unexpected {value!r}")

    tree = binary(0)
    if peek()[0] != "end":
        raise ValueError(f"unexpected {peek()[1]!r}")
    return tree


def _truth(c: Column) -> Column:
    return c.cast("double")


_FIXED: dict[str, tuple[int, Callable]] = {
    "ceil": (1, lambda a: F.ceil(a).cast("double")), "floor": (1, lambda a: F.floor(a).cast("double")), "abs": (1, F.abs), "signum": (1, F.signum),
    "round": (1, lambda a: F.floor(a + 0.5).cast("double")), "sqrt": (1, F.sqrt), "exp": (1, F.exp), "ln": (1, F.log), "log10": (1, F.log10), "logistic": (1, lambda a: 1 / (1 + F.exp(-a))),
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "asin": (1, F.asin), "acos": (1, F.acos), "atan": (1, F.atan), "sinh": (1, F.sinh), "cosh": (1, F.cosh), "tanh": (1, F.tanh),
    "pow": (2, F.pow), "^": (2, F.pow), "-": (2, lambda a, b: a - b), "/": (2, lambda a, b: F.when(b != 0, a / b)),
    "XOR": (2, lambda a, b: _truth((a == 1) != (b == 1))), "IF": (3, lambda a, b, c: F.when(a == 1, b).otherwise(c)),
    "<": (2, lambda a, b: _truth(a < b)), "<=": (2, lambda a, b: _truth(a <= b)), "=": (2, lambda a, b: _truth(a == b)), ">": (2, lambda a, b: _truth(a > b)), ">=": (2, lambda a, b: _truth(a >= b)),
}
_MANY: dict[str, Callable] = {
    "+": lambda *x: reduce(lambda a, b: a + b, x), "*": lambda *x: reduce(lambda a, b: a * b, x),
    "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0], "min": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "AND": lambda *x: _truth(reduce(lambda a, b: a & b, [v == 1 for v in x])), "OR": lambda *x: _truth(reduce(lambda a, b: a | b, [v == 1 for v in x])),
}


#: A uniform number of each row for a seed: by a hash of the row's id, or by Spark's generator.
Source = Callable[[int], Column]


def _standard(seed: int, source: Source) -> Column:
    """A standard normal number from two uniform ones."""
    u = F.greatest(source(seed), F.lit(2.0**-53))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * source(seed + 3))


def _normal(seed: int, mean: Column, sd: Column, source: Source) -> Column:
    return mean + sd * _standard(seed, source)


def _streams(u: np.ndarray, k: int) -> np.ndarray:
    """The k-th number in (0, 1) of the streams that begin at uniform numbers (SplitMix64)."""
    x = (u * 2.0**53).astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) / 2.0**52 + 2.0**-54


def gamma_draws(u: np.ndarray, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Marsaglia and Tsang's method for whole batches: rows that reject go on with the next numbers of their streams."""
    k = np.where(shape < 1, np.maximum(shape, 0) + 1, shape)
    d = k - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left = np.full(len(u), np.nan), np.flatnonzero(np.isfinite(u) & (shape > 0))
    step = 1
    while len(left):
        a, b, w = (_streams(u[left], 3 * step + j) for j in range(3))
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + c[left] * x) ** 3
        good = (v > 0) & (np.log(w) < x * x / 2 + d[left] * (1 - v + np.log(np.where(v > 0, v, 1.0))))
        out[left[good]] = (d[left] * v)[good]
        left, step = left[~good], step + 1
    return out * scale * np.where(shape < 1, _streams(u, 1) ** (1 / np.where(shape < 1, shape, 1.0)), 1.0)


def poisson_draws(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The least count whose distribution function reaches u; the search begins where nothing is left below."""
    k = np.floor(np.maximum(mean - 10 * np.sqrt(np.maximum(mean, 0)) - 10, 0))
    safe = np.where(mean > 0, mean, 1.0)
    log_p = -mean + k * np.log(safe) - np.array([math.lgamma(x + 1) if x == x else 0.0 for x in k])
    total, out = np.exp(log_p), k.copy()
    left = np.flatnonzero((total < u) & (mean > 0) & (u < 1))
    while len(left):
        out[left] += 1
        log_p[left] += np.log(safe[left]) - np.log(out[left])
        total[left] += np.exp(log_p[left])
        left = left[(total[left] < u[left]) & (out[left] < mean[left] + 40 * np.sqrt(mean[left]) + 100)]
    return np.where(np.isfinite(u) & np.isfinite(mean), out, np.nan)


def _gamma(shape: Column, scale: Column, seed: int, source: Source) -> Column:
    @F.pandas_udf("double")
    def draw(u: pd.Series, k: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(gamma_draws(u.to_numpy(), k.to_numpy(), s.to_numpy()))

    return draw(source(seed), shape, scale)


def _poisson(mean: Column, seed: int, source: Source) -> Column:
    @F.pandas_udf("double")
    def draw(u: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(poisson_draws(u.to_numpy(), m.to_numpy()))

    return draw(source(seed), mean)


def _random(name: str, a: list[Column], seed: int, source: Source) -> Column | None:
    """A draw; formulas that need the uniform number more than once get it bound, as each call could draw anew."""
    known = _draw(name, a, seed, source(seed), source)
    if known is None or name not in ("Laplace", "Triangular", "Discrete", "DiscError", "Mixture", "Split"):
        return known
    return F.element_at(F.transform(F.array(source(seed)), lambda u: _draw(name, a, seed, u, source)), 1)


def _draw(name: str, a: list[Column], seed: int, u: Column, source: Source) -> Column | None:
    match name, len(a):
        case "random", 0:
            return u
        case ("Uniform" | "U"), 2:
            return a[0] + (a[1] - a[0]) * u
        case ("Normal" | "N"), 2:
            return _normal(seed, *a, source)
        case "LogNormal", 1 | 2:
            return F.exp(_normal(seed, *(a if len(a) == 2 else [F.lit(0.0), a[0]]), source))
        case "TruncNormal", 4:
            return F.greatest(a[2], F.least(a[3], _normal(seed, a[0], a[1], source)))
        case "Indicator", 1:
            return _truth(u < a[0])
        case "ExponentialDist", 1:
            return -F.log(1 - u) / a[0]
        case "Cauchy", 2:
            return a[0] + a[1] * F.tan(math.pi * (u - 0.5))
        case "Gumbel", 2:
            return a[0] - a[1] * F.log(-F.log(u))
        case "Laplace", 2:
            return a[0] - a[1] * F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5))
        case "Levy", 1:
            return a[0] / F.pow(_standard(seed, source), F.lit(2.0))
        case "Pareto", 2:
            return a[0] / F.pow(1 - u, 1 / a[1])
        case "Weibull", 2:
            return a[0] * F.pow(-F.log(1 - u), 1 / a[1])
        case "Triangular", 3:
            share = (a[1] - a[0]) / (a[2] - a[0])
            return F.when(u < share, a[0] + F.sqrt(u * (a[2] - a[0]) * (a[1] - a[0]))).otherwise(a[2] - F.sqrt((1 - u) * (a[2] - a[0]) * (a[2] - a[1])))
        case "Gamma", 2:
            return _gamma(a[0], a[1], seed, source)
        case "ChiSquare", 1:
            return _gamma(a[0] / 2, F.lit(2.0), seed, source)
        case "Beta", 2:
            x, y = _gamma(a[0], F.lit(1.0), seed, source), _gamma(a[1], F.lit(1.0), seed + 1, source)
            return x / (x + y)
        case "FDist", 2:
            return (_gamma(a[0] / 2, F.lit(2.0), seed, source) / a[0]) / (_gamma(a[1] / 2, F.lit(2.0), seed + 1, source) / a[1])
        case "StudentT", 1:
            return _standard(seed + 1, source) / F.sqrt(_gamma(a[0] / 2, F.lit(2.0), seed + 2, source) / a[0])
        case "Nakagami", 2:
            return F.sqrt(_gamma(a[0], a[1] / a[0], seed, source))
        case "Poisson", 1:
            return _poisson(a[0], seed, source)
        case ("Discrete" | "DiscError"), _:
            total = reduce(lambda x, y: x + y, a)
            bounds = [reduce(lambda x, y: x + y, a[: k + 1]) / total for k in range(len(a) - 1)]
            return reduce(lambda x, y: x + y, [_truth(u >= b) for b in bounds], F.lit(0.0))
        case "Mixture", n if n and n % 2 == 0:
            weights, values = a[::2], a[1::2]
            total, out, upto = reduce(lambda x, y: x + y, weights), values[-1], F.lit(0.0)
            pairs = []
            for w, v in zip(weights[:-1], values[:-1], strict=True):
                upto = upto + w / total
                pairs.append((upto, v))
            for b, v in reversed(pairs):
                out = F.when(u < b, v).otherwise(out)
            return out
        case "Split", n if n and n % 2 == 0:
            sizes = [a[k + 1] - a[k] for k in range(0, n, 2)]
            total = reduce(lambda x, y: x + y, sizes)
            at = u * total
            out, before = a[0] + at, F.lit(0.0)
            for k in range(1, n // 2):
                before = before + sizes[k - 1]
                out = F.when(at >= before, a[2 * k] + at - before).otherwise(out)
            return F.when(total > 0, out)
    return None


def expand_templates(text: str, variables: list[str]) -> str:
    """TSUM(e) and TPROD(e) become the sum and product of e over variables in place of `$`; NEW(x) a name of its own."""
    names = iter(range(1, 10**6))
    text = re.sub(r"\b(?:NEW|new)\(([A-Za-z_]\w*)\)", lambda m: f"{m[1]}{next(names)}", text)

    def many(m: re.Match) -> str:
        op = "+" if m[1].lower() == "tsum" else "*"
        return "(" + f" {op} ".join(f"({m[2].replace('$', v)})" for v in variables) + ")" if variables else ("0" if op == "+" else "1")

    return re.sub(r"\b(TSUM|tsum|TPROD|tprod)\(((?:[^()]|\([^()]*\))*)\)", many, text)


def compile_expression(text: str, seed: int = 0, row_id: str | None = None) -> Column:
    """The Column of a formula; random calls differ by their place in it.

    With the column of a row id, draws follow from its hash and stay as they are when a table
    is computed again or dealt out anew; without one they are Spark's own.
    """
    source: Source = (lambda k: unit_hash(row_id, k)) if row_id else F.rand
    calls = iter(range(0, 10**9, 10))

    def build(t: tuple) -> Column:
        if t[0] == "num":
            return F.lit(t[1])
        if t[0] == "var":
            return F.col(f"`{t[1]}`").cast("double")
        name, args = t[1], [build(x) for x in t[2]]
        if name in _FIXED:
            n, f = _FIXED[name]
            if len(args) != n:
                raise ValueError(f"{name} takes {n} arguments, not {len(args)}")
            return f(*args)
        if name in _MANY and args:
            return _MANY[name](*args)
        if name == "Switch" and len(args) > 1:
            return reduce(lambda acc, k: acc.when(args[0] == k, args[k + 1]), range(len(args) - 1), F.when(F.lit(False), 0.0))
        out = _random(name, args, seed + next(calls), source)
        if out is None:
            raise ValueError(f"unknown function {name} with {len(args)} arguments")
        return out

    return build(parse(text))


def transform(df: DataFrame, *equations: str, seed: int = 0, row_id: str | None = None) -> DataFrame:
    """Equations "X = formula" applied in order; each may use the columns before it."""
    for k, e in enumerate(equations):
        name, formula = e.split("=", 1)
        df = df.withColumn(name.strip().strip("`"), compile_expression(formula, seed + 1000 * k, row_id))
    return df
