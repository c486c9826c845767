"""Sufficient statistics: one pass over the rows to a p x p matrix.

Each task sums centred products of its rows with NumPy and returns p * p numbers. These are
merged pairwise in the executors, in SLOTS groups and then in one, so that one row reaches the
driver and precision does not suffer from large means. The closed form in SQL serves few
columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


#: Groups in which partial results of tasks are merged first; each holds a share of the tasks.
SLOTS = 64


def merged(parts: DataFrame, merge: Callable[[dict, dict], dict], key: str | None = None) -> list[Row]:
    """The rows of `parts`, partial results of tasks, merged into one row, or one for each key.

    merge takes and returns rows as dicts. Merging is done by tasks, in two steps.
    """
    schema = parts.schema
    arrow = to_arrow_schema(schema)

    def all_of(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([reduce(merge, t.to_pylist())], schema=arrow)

    keys = [key] if key else []
    slotted = parts.select("*", F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("_slot"))
    some = slotted.groupBy(*keys, "_slot").applyInArrow(lambda t: all_of(t.drop_columns("_slot")), schema)
    return some.groupBy(*keys).applyInArrow(all_of, schema).collect()


@dataclass
class SuffStats:
    """Names, number of rows, means and covariances (divisor n - 1) of continuous variables."""

    names: list[str]
    n: int
    cov: np.ndarray
    means: np.ndarray | None = None
    index: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.index = {v: k for k, v in enumerate(self.names)}

    @property
    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cov))
        return self.cov / np.outer(sd, sd)

    def select(self, names: list[str]) -> SuffStats:
        at = [self.index[v] for v in names]
        return SuffStats(list(names), self.n, self.cov[np.ix_(at, at)], None if self.means is None else self.means[at])

    def partial_correlation(self, x: str, y: str, z: list[str] | tuple[str, ...] = ()) -> float:
        """Correlation of x and y given z; NaN where the submatrix is singular."""
        at = [self.index[v] for v in (x, y, *z)]
        sub = self.cov[np.ix_(at, at)]
        try:
            p = np.linalg.inv(sub)
        except np.linalg.LinAlgError:
            return float("nan")
        d = p[0, 0] * p[1, 1]
        if not np.isfinite(d) or d <= 0 or np.linalg.cond(sub) > 1e14:
            return float("nan")
        return float(np.clip(-p[0, 1] / np.sqrt(d), -1, 1))

    def regress(self, y: str, z: list[str]) -> tuple[np.ndarray, float]:
        """(coefficients of z, residual variance with divisor n - 1) of y on z."""
        i, at = self.index[y], [self.index[v] for v in z]
        if not at:
            return np.empty(0), float(self.cov[i, i])
        b = np.linalg.solve(self.cov[np.ix_(at, at)], self.cov[at, i])
        return b, float(self.cov[i, i] - self.cov[at, i] @ b)

    def to_df(self, spark) -> DataFrame:
        rows = [(a, b, float(self.cov[i, j])) for i, a in enumerate(self.names) for j, b in enumerate(self.names)]
        return spark.createDataFrame(rows, "var_i string, var_j string, value double")


def _partial(batches: Iterator[pa.RecordBatch], p: int) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, m2 = 0, np.zeros(p), np.zeros((p, p))
    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in b.columns], axis=1)
        x = x[np.isfinite(x).all(axis=1)]
        if len(x):
            mu = x.mean(axis=0)
            d = x - mu
            n, mean, m2 = _merge((n, mean, m2), (len(x), mu, d.T @ d))
    return n, mean, m2


def _merge(a, b):
    (na, ma, sa), (nb, mb, sb) = a, b
    n = na + nb
    if not n:
        return a
    d = mb - ma
    return n, ma + d * (nb / n), sa + sb + np.outer(d, d) * (na * nb / n)


def merged_moments(parts: DataFrame, p: int, key: str | None = None) -> list[Row]:
    """(key, n, mean, m2) rows of tasks, merged."""

    def merge(a: dict, b: dict) -> dict:
        x, y = ((r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"]).reshape(p, p)) for r in (a, b))
        n, mean, m2 = _merge(x, y)
        return a | {"n": n, "mean": mean.tobytes(), "m2": m2.tobytes()}

    return merged(parts, merge, key)


def merged_sums(parts: DataFrame, key: str | None = None) -> list[Row]:
    """Rows of tasks added up: numbers, and binary columns of doubles."""
    add = lambda x, y: (np.frombuffer(x) + np.frombuffer(y)).tobytes() if isinstance(x, bytes) else x + y
    return merged(parts, lambda a, b: {k: v if k == key else add(v, b[k]) for k, v in a.items()}, key)


def sufficient_stats(df: DataFrame, cols: list[str] | None = None) -> SuffStats:
    """Statistics over the rows in which all columns are present and finite."""
    cols = cols or df.columns
    p = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = _partial(batches, p)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()]), pa.array([m2.tobytes()])], names=["n", "mean", "m2"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, "n long, mean binary, m2 binary")
    r = next(iter(merged_moments(parts, p)), None)
    if r is None:  # a table without partitions
        return SuffStats(list(cols), 0, np.zeros((p, p)), np.zeros(p))
    return SuffStats(list(cols), r["n"], np.frombuffer(r["m2"]).reshape(p, p) / max(r["n"] - 1, 1), np.frombuffer(r["mean"]))


def grouped_stats(df: DataFrame, by: str, cols: list[str]) -> dict:
    """Statistics of each value of a column with few values (datasets of one table)."""
    p = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            coded = b.column(0).dictionary_encode("encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in b.columns[1:]], axis=1)
            for k, v in enumerate(coded.dictionary.to_pylist()):
                y = x[code == k]
                y = y[np.isfinite(y).all(axis=1)]
                if len(y):
                    mu = y.mean(axis=0)
                    held[v] = _merge(held.get(v, (0, np.zeros(p), np.zeros((p, p)))), (len(y), mu, (y - mu).T @ (y - mu)))
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([held[k][0] for k in keys], pa.int64()), *(pa.array([held[k][j].tobytes() for k in keys], pa.binary()) for j in (1, 2))],
            names=["k", "n", "mean", "m2"],
        )

    rows = df.select(F.col(by).cast("string").alias(by), *[F.col(c).cast("double").alias(c) for c in cols])
    parts = merged_moments(rows.mapInArrow(run, "k string, n long, mean binary, m2 binary"), p, "k")
    return {r["k"]: SuffStats(list(cols), r["n"], np.frombuffer(r["m2"]).reshape(p, p) / max(r["n"] - 1, 1), np.frombuffer(r["mean"])) for r in sorted(parts, key=lambda r: str(r["k"]))}


def covariance_long(df: DataFrame, cols: list[str], correlation: bool = False) -> DataFrame:
    """(var_i, var_j, value) for i <= j in one aggregation; for up to ten or so columns."""
    if len(cols) > 12:
        return sufficient_stats(df, cols).to_df(df.sparkSession)
    f = F.corr if correlation else F.covar_samp
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[f(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), F.col(f"c{k}").alias("value")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))
