"""Cross-validation, leave-one-out and complementary pairs on sufficient statistics.

Parts of a table are drawn by a keyed bijection of row ids: a part is what lies below an exact
order statistic of the drawn numbers, so parts of equal share differ in size by one row at
most. One keyed pass gathers the statistics of all folds, or of the first halves of all pairs;
training sets and second halves follow by subtraction, samples without one row by a downdate.
Row ids are whole numbers, each on one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.suffstats import SuffStats, _merge, merged_moments, merged_sums, sufficient_stats
from ..plans.tables import fresh
from .graph import Graph
from .mixed import complementary_pairs_bound

#: Bits of the drawn numbers that a pass of the selection tells.
BITS = 12


def drawn(ids: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers for each draw and seed."""
    x = ids.astype(np.uint64) + np.uint64((draw * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def order_statistics(df: DataFrame, row_id: str, draws: int, shares: list[float], seed: int) -> tuple[int, np.ndarray]:
    """(rows, bounds [draw, share]): so many of the drawn numbers as the share of all rows, rounded, are below a bound.

    Each pass counts the next BITS bits of the numbers that agree with a bound as far as it is known.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id")).where("id is not null")
    many = draws * len(shares)
    prefix, left, shift, n = [0] * many, None, 64, 0
    while shift > 0:
        step = min(BITS, shift)
        shift -= step

        def run(batches: Iterator[pa.RecordBatch], prefix=tuple(prefix), shift=shift, step=step, known=left is not None) -> Iterator[pa.RecordBatch]:
            counts, total = np.zeros((many, 1 << step)), 0
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                total += len(ids)
                for d in range(draws):
                    h = drawn(ids, d, seed)
                    for k in range(d * len(shares), (d + 1) * len(shares)):
                        mine = h if not known else h[(h >> np.uint64(shift + step)) == np.uint64(prefix[k])]
                        counts[k] += np.bincount(((mine >> np.uint64(shift)) & np.uint64((1 << step) - 1)).astype(np.int64), minlength=1 << step)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["n", "counts"])

        r = merged_sums(rows.mapInArrow(run, "n long, counts binary"))[0]
        counts = np.frombuffer(r["counts"]).reshape(many, -1)
        if left is None:
            n = r["n"]
            left = [round(n * s) for s in shares] * draws
        for k in range(many):
            below = np.concatenate(([0], np.cumsum(counts[k])))
            at = int(np.searchsorted(below, left[k], side="right")) - 1  # the last place with no more than wanted below it
            at = min(at, (1 << step) - 1)
            left[k] -= int(below[at])
            prefix[k] = prefix[k] << step | at
        if not any(left):
            break
    # what is left of a rank is below the next number
    bounds = np.array([(p << shift) + (1 if x and shift == 0 else 0) for p, x in zip(prefix, left, strict=True)], dtype=object)
    return n, bounds.reshape(draws, len(shares))


def _below(h: np.ndarray, bound: int) -> np.ndarray:
    return h < np.uint64(bound) if bound < 2**64 else np.ones(len(h), dtype=bool)


def _gathered(df: DataFrame, cols: list[str], row_id: str, groups: int, assign: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> list[SuffStats]:
    """Statistics of groups of rows; assign gives (group, which rows) for an array of ids."""
    p = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(0, np.zeros(p), np.zeros((p, p)))] * groups
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            whole = np.isfinite(x).all(axis=1)
            for g, mine in assign(b.column(0).to_numpy(zero_copy_only=False)):
                y = x[mine & whole]
                if len(y):
                    mu = y.mean(axis=0)
                    held[g] = _merge(held[g], (len(y), mu, (y - mu).T @ (y - mu)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(groups), pa.int32()), pa.array([h[0] for h in held], pa.int64()), *(pa.array([h[j].tobytes() for h in held], pa.binary()) for j in (1, 2))],
            names=["k", "n", "mean", "m2"],
        )

    rows = df.select(F.col(row_id).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)]).where("id is not null")
    found = {r["k"]: r for r in merged_moments(rows.mapInArrow(run, "k int, n long, mean binary, m2 binary"), p, "k")}
    return [_stats(cols, found[g]["n"], np.frombuffer(found[g]["mean"]), np.frombuffer(found[g]["m2"]).reshape(p, p)) for g in range(groups)]


def _stats(cols: list[str], n: int, mean: np.ndarray, m2: np.ndarray) -> SuffStats:
    return SuffStats(list(cols), n, m2 / max(n - 1, 1), mean)


def _parts(s: SuffStats) -> tuple[int, np.ndarray, np.ndarray]:
    return s.n, s.means, s.cov * max(s.n - 1, 1)


def together(parts: list[SuffStats]) -> SuffStats:
    out = _parts(parts[0])
    for s in parts[1:]:
        out = _merge(out, _parts(s))
    return _stats(parts[0].names, *out)


def without(total: SuffStats, part: SuffStats) -> SuffStats:
    """The statistics of the rows of total that are not in part."""
    (n, m, s), (k, mk, sk) = _parts(total), _parts(part)
    rest = n - k
    if rest <= 0:
        return _stats(total.names, 0, np.zeros_like(m), np.zeros_like(s))
    mean = (n * m - k * mk) / rest
    d = mk - mean
    return _stats(total.names, rest, mean, s - sk - np.outer(d, d) * (k * rest / n))


def fold_stats(df: DataFrame, cols: list[str], row_id: str, folds: int, seed: int = 0) -> list[SuffStats]:
    """The statistics of each of so many folds of equal size."""
    _, bounds = order_statistics(df, row_id, 1, [k / folds for k in range(1, folds)], seed)
    cuts = list(bounds[0])

    def assign(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        h = drawn(ids, 0, seed)
        fold = sum((~_below(h, c)).astype(np.int64) for c in cuts) if cuts else np.zeros(len(h), dtype=np.int64)
        for k in range(folds):
            yield k, fold == k

    return _gathered(df, cols, row_id, folds, assign)


def training_sets(folds: list[SuffStats]) -> list[tuple[SuffStats, SuffStats]]:
    """(all rows but the fold's, the fold) for each fold; no pass over rows."""
    total = together(folds)
    return [(without(total, f), f) for f in folds]


def half_column(df: DataFrame, row_id: str, pairs: int, seed: int = 0, pair: str = "pair", half: str = "half") -> DataFrame:
    """df with a pair number and which half the row is in: each row once in each pair, halves of equal size."""
    _, bounds = order_statistics(df, row_id, pairs, [0.5], seed)
    cuts = list(bounds[:, 0])

    def side(ids):
        import pandas as pd

        x = ids.to_numpy()
        return pd.Series(list(np.stack([~_below(drawn(x, d, seed), c) for d, c in enumerate(cuts)], axis=1).astype(np.int32))) if len(x) else pd.Series([], dtype=object)

    sides = fresh(df, "sides")
    numbered = df.withColumn(sides, F.pandas_udf(side, "array<int>")(F.col(row_id).cast("long")))
    return numbered.select(*df.columns, F.posexplode(sides).alias(pair, half))


def half_stats(df: DataFrame, cols: list[str], row_id: str, pairs: int, seed: int = 0) -> list[tuple[SuffStats, SuffStats]]:
    """The statistics of both halves of so many pairs: first halves from one pass, second ones by subtraction."""
    _, bounds = order_statistics(df, row_id, pairs, [0.5], seed)
    cuts = list(bounds[:, 0])

    def assign(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, np.ones(len(ids), dtype=bool)
        for d, c in enumerate(cuts):
            yield d + 1, _below(drawn(ids, d, seed), c)

    total, *first = _gathered(df, cols, row_id, pairs + 1, assign)
    return [(s, without(total, s)) for s in first]


def prediction_error(train: SuffStats, test: SuffStats, target: str, predictors: list[str]) -> float:
    """Mean squared error over the test rows of the regression on the training rows."""
    b, _ = train.regress(target, predictors)
    at = [train.index[v] for v in predictors]
    y = train.index[target]
    constant = train.means[y] - train.means[at] @ b
    bias = test.means[y] - constant - test.means[at] @ b
    k = np.zeros(len(test.names))
    k[y] = 1.0
    k[at] -= b
    return float(k @ test.cov @ k) * (test.n - 1) / max(test.n, 1) + float(bias) ** 2


def searched(spark, samples: list[SuffStats], find: Callable[[SuffStats], Graph]) -> DataFrame:
    """(sample, a, b): the edges that a search finds in each sample, a task for each few samples."""
    rows = [(k, s.n, s.means.tobytes(), s.cov.tobytes()) for k, s in enumerate(samples)]
    names = samples[0].names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, n, mean, cov in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g = find(SuffStats(names, n, np.frombuffer(cov).reshape(len(names), -1), np.frombuffer(mean)))
                out += [(k, *sorted(e[:2], key=names.index)) for e in g.edges()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[j] for o in out], pa.string()) for j in (1, 2))], names=["sample", "a", "b"])

    df = spark.createDataFrame(rows, "k int, n long, mean binary, cov binary").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    return df.mapInArrow(run, "sample int, a string, b string")


def validated_features(spark, folds: list[SuffStats], target: str, find: Callable[[SuffStats], Graph]) -> DataFrame:
    """(fold, features, error): neighbours of the target that the search finds without the fold, and the error of predicting the fold by them."""
    sets = training_sets(folds)
    near: list[list[str]] = [[] for _ in folds]
    for r in searched(spark, [train for train, _ in sets], find).where((F.col("a") == target) | (F.col("b") == target)).collect():
        near[r["sample"]].append(r["b"] if r["a"] == target else r["a"])
    order = folds[0].names.index
    rows = [(k, sorted(v, key=order), prediction_error(train, test, target, sorted(v, key=order))) for k, (v, (train, test)) in enumerate(zip(near, sets, strict=True))]
    return spark.createDataFrame(rows, "fold int, features array<string>, error double")


def feature_stability(sets: list[set[str]], candidates: int) -> float:
    """Mean of how far each two sets of features agree beyond chance (1: always the same; 0: as chance would have it)."""
    out = []
    for i, a in enumerate(sets):
        for b in sets[:i]:
            expected = len(a) * len(b) / candidates
            most = min(len(a), len(b))
            out.append((len(a & b) - expected) / (most - expected) if most > expected else float(a == b))
    return sum(out) / len(out) if out else 1.0


def leave_one_out(df: DataFrame, cols: list[str], target: str, row_id: str, find: Callable[[SuffStats], Graph] | None = None) -> DataFrame:
    """(row_id, features, loss) of each row: what predicts the target without the row, and the squared error on it.

    Features are the target's neighbours in the graph found, or all other columns. Each task
    takes its rows out of the statistics of all rows one by one.
    """
    total = sufficient_stats(df.where(F.col(row_id).isNotNull()), cols)
    n, mean, m2 = _parts(total)
    y = total.index[target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            whole = np.isfinite(x).all(axis=1)
            features, losses = [], []
            for row in x[whole]:
                d = row - mean
                rest = _stats(cols, n - 1, mean - d / (n - 1), m2 - np.outer(d, d) * (n / (n - 1)))
                use = sorted(find(rest).adj(target), key=cols.index) if find else [c for c in cols if c != target]
                w, _ = rest.regress(target, use)
                at = [rest.index[c] for c in use]
                features.append(use)
                losses.append(float(row[y] - rest.means[y] - (row[at] - rest.means[at]) @ w) ** 2)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(whole)), pa.array(features, pa.list_(pa.string())), pa.array(losses, pa.float64())], names=["row_id", "features", "loss"])

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)]).where("row_id is not null")
    return rows.mapInArrow(run, "row_id long, features array<string>, loss double")


def selection_threshold(selected: float, candidates: float, pairs: int, wrong: float) -> float:
    """The least share of half samples that bounds the expected number of wrong edges; 1.01 if none does."""
    for k in range(pairs + 1, 2 * pairs + 1):
        if complementary_pairs_bound(selected, candidates, k / (2 * pairs), pairs) <= wrong:
            return k / (2 * pairs)
    return 1.01


def stable_edges(df: DataFrame, cols: list[str], row_id: str, find: Callable[[SuffStats], Graph], pairs: int = 25, wrong: float = 1.0, seed: int = 0) -> DataFrame:
    """(a, b, share, kept): how often each edge is found in halves of complementary pairs, and whether that is often enough.

    Kept edges hold so many wrong ones at most, in expectation.
    """
    spark = df.sparkSession
    halves = [s for both in half_stats(df, cols, row_id, pairs, seed) for s in both]
    found = searched(spark, halves, find).groupBy("a", "b").agg(F.count("*").alias("times")).collect()  # an edge a row
    share = {(r["a"], r["b"]): r["times"] / len(halves) for r in found}
    least = selection_threshold(sum(share.values()), math.comb(len(cols), 2), pairs, wrong)
    return spark.createDataFrame([(a, b, x, x >= least) for (a, b), x in sorted(share.items())], "a string, b string, share double, kept boolean")
