"""Counts of all small variable sets from one pass, with the commonest value of each variable left out.

For each set of up to `depth` variables a dense array has the counts of all combinations of values
but those that hold some variable's commonest value; what these have follows by subtraction
from smaller sets. As most rows hold commonest values, most of the table is never counted. Any
table of counts of so many variables is answered without going back to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.suffstats import merged_sums
from .independence import _Discrete


class CountTree(_Discrete):
    """Counts of the rows by up to `depth` variables; larger sets are one aggregation of the rows each.

    Where no cell is missing, answers are those of grouped counts. A row counts for a set of
    variables if it has all of them. Values of a variable come as strings, in order; there may be
    `most` of them at most.
    """

    def __init__(self, df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05, depth: int = 3, most: int = 1000) -> None:
        self.variables, self.alpha, self.depth = list(cols or df.columns), alpha, depth
        self._df = df.select(*[F.col(c).cast("string").alias(c) for c in self.variables])
        self._table, self._seen = None, {}
        self.values: list[list[str]] = []  # of each variable, the commonest first
        for c in self.variables:
            found = [(-r["n"], r["v"]) for r in self._df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")).limit(most + 1).collect()]
            if len(found) > most:
                raise ValueError(f"{c} has more than {most} values")
            first = min(found)[1] if found else None
            self.values.append(([first] if found else []) + sorted(v for _, v in found if v != first))
        self.sets = [s for k in range(depth + 1) for s in combinations(range(len(self.variables)), k)]
        shapes = [[len(self.values[v]) - 1 if self.values[v] else 0 for v in s] for s in self.sets]
        sizes = [math.prod(x) for x in shapes]
        values, sets, p = self.values, self.sets, len(self.variables)
        # rows without a value of some variable are counted by what they have: one more code
        code = [F.coalesce(F.array_position(F.array(*map(F.lit, v)), F.col(c)).cast("int"), F.lit(0)) if v else F.lit(0) for c, v in zip(self.variables, values, strict=True)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, there = np.zeros(sum(sizes)), np.zeros(len(sets))
            for b in batches:
                codes = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:p]], axis=1)
                times = b.column(p).to_numpy(zero_copy_only=False).astype(np.float64)
                at = 0
                for k, (s, shape, size) in enumerate(zip(sets, shapes, sizes, strict=True)):
                    part = codes[:, s]
                    there[k] += times[(part > 0).all(axis=1)].sum()
                    rare = (part > 1).all(axis=1)
                    if size and len(s):
                        total[at : at + size] += np.bincount(np.ravel_multi_index(tuple(part[rare].T - 2), shape), weights=times[rare], minlength=size)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([there.tobytes()], pa.binary())], names=["total", "there"])

        names = [f"c{k}" for k in range(p)]
        rows = self._df.select(*[c.alias(n) for c, n in zip(code, names, strict=True)]).groupBy(*names).agg(F.count("*").alias("n"))
        r = next(iter(merged_sums(rows.mapInArrow(run, "total binary, there binary"))), None)
        flat = np.frombuffer(r["total"]) if r else np.zeros(sum(sizes))
        there = np.frombuffer(r["there"]) if r else np.zeros(len(sets))
        self.rare = {s: x.reshape(shape) for s, x, shape in zip(self.sets, np.split(flat, np.cumsum(sizes)[:-1]), shapes, strict=True)}
        #: Whether some row lacks a value: then smaller sets have rows that larger ones have not.
        self.whole = bool(len(set(there.tolist())) <= 1)
        self.rows = float(there[0]) if len(there) else 0.0

    def array(self, s: tuple[int, ...]) -> np.ndarray:
        """Counts of all combinations of values of a set of variables, commonest values first."""
        if not s:
            return np.array(self.rows)
        out = np.zeros([len(self.values[v]) for v in s])
        if not out.size:
            return out
        # axes whose variable takes a rarer value; the others take their commonest
        for k in range(len(s), -1, -1):
            for rare in combinations(range(len(s)), k):
                common = [j for j in range(len(s)) if j not in rare]
                cell = tuple(slice(1, None) if j in rare else 0 for j in range(len(s)))
                value = 0.0
                for more in range(len(common) + 1):  # inclusion and exclusion of rarer values
                    for extra in combinations(common, more):
                        held = tuple(sorted((*rare, *extra)))
                        counts = self.rare[tuple(s[j] for j in held)] if held else np.array(self.rows)
                        value = value + (-1) ** more * counts.sum(axis=tuple(held.index(j) for j in extra))
                out[cell] = value
        return out

    def counts(self, names: tuple[str, ...]) -> dict[tuple, int]:
        """Counts by values of these variables, without empty combinations."""
        if len(names) > self.depth or not self.whole:
            return super().counts(names)
        if names not in self._seen:
            at = [self.variables.index(v) for v in names]
            order = sorted(range(len(at)), key=at.__getitem__)
            full = np.rint(self.array(tuple(at[k] for k in order))).astype(np.int64)
            full = np.transpose(full, [order.index(k) for k in range(len(at))])
            self._seen[names] = {tuple(self.values[v][k] for v, k in zip(at, cell, strict=True)): int(full[tuple(cell)]) for cell in np.argwhere(full).tolist()}
        return self._seen[names]


def tree_test(kind: type[_Discrete], tree: CountTree) -> _Discrete:
    """A test of this kind (ChiSquare, GSquare) that takes its counts from a tree."""
    out = kind.__new__(kind)
    out.variables, out.alpha, out.counts = tree.variables, tree.alpha, tree.counts
    return out
