"""Statistics of columns, pairs and cells as DataFrames."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.suffstats import covariance_long
from ..plans.tables import written
from .transforms import average_ranks_of, counted, order_statistics


def long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var, value) rows of continuous columns."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "var", "value").where(F.col("value").isNotNull())


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var, n, mean, sd, min, max, q1, median, q3) of the values that are not null; quartiles are exact and interpolated, NaN counts as the greatest value.

    Quartiles come from counts of distinct values over range partitions, so that no task holds
    all distinct values of a column; the driver gets the values at up to six places of each.
    """
    sums = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)]).agg(*[F.struct(*[f(f"x{k}").alias(s) for s, f in sums.items()]).alias(f"a{k}") for k in range(len(cols))]).first()
    rows = {c: one[k] for k, c in enumerate(cols) if one[k]["n"]}
    places = {c: {q: (r["n"] - 1) * share for q, share in QUARTILES.items()} for c, r in rows.items()}
    at = order_statistics(df, list(rows), {c: sorted({f(x) for x in xs.values() for f in (math.floor, math.ceil)}) for c, xs in places.items()}) if rows else {}

    def value(c: str, x: float) -> float:
        low, high = (at.get((c, f(x)), math.nan) for f in (math.floor, math.ceil))  # places behind all numbers are of NaN
        return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high

    out = [(c, *r, *(value(c, x) for x in places[c].values())) for c, r in rows.items()]
    return df.sparkSession.createDataFrame(out, ", ".join(["var string", "n long", *[f"{s} double" for s in [*sums, *QUARTILES] if s != "n"]]))


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Skewness (third sum over n - 1, second over n), excess kurtosis (fourth over n, variance with n - 1), average deviation.

    Two passes, of means and of powers of the differences from these; nulls do not count.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)])
    means = rows.agg(*[F.avg(f"x{k}") for k in range(len(cols))])
    named = means.toDF(*[f"m{k}" for k in range(len(cols))])
    aggs = []
    for k in range(len(cols)):
        d = F.col(f"x{k}") - F.col(f"m{k}")
        aggs.append(F.struct(F.count(f"x{k}").alias("n"), *[F.sum(reduce(lambda a, b: a * b, [d] * j)).alias(f"s{j}") for j in (2, 3, 4)], F.avg(F.abs(d)).alias("average_deviation")).alias(f"a{k}"))
    one = rows.join(F.broadcast(named)).agg(*aggs)  # one row of means
    fields = ("n", "s2", "s3", "s4", "average_deviation")
    s = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("var"), *[F.col(f"a{k}.{f}").alias(f) for f in fields]) for k, c in enumerate(cols)])))
    return s.where("n > 0").select(
        "var",
        (F.col("s3") / (F.col("n") - 1) / F.pow(F.col("s2") / F.col("n"), F.lit(1.5))).alias("skewness"),
        (F.col("s4") / F.col("n") / F.pow(F.col("s2") / (F.col("n") - 1), F.lit(2.0)) - 3).alias("kurtosis"),
        "average_deviation",
    )


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlations of average ranks, over rows without a null or NaN; the values of all columns are counted in one pass."""
    out = average_ranks_of(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna(), cols)
    named = out.select(*[F.col(f"{c}_rank").alias(c) for c in cols])
    return covariance_long(named, cols, True).where("var_i < var_j")


def concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum over pairs of cells of n_i n_j sign(x_i - x_j) sign(y_i - y_j), by bisecting the ranks of y."""
    xr, yr = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (x, y))
    total = 0.0
    for bit in range(int(yr.max(initial=0)).bit_length()):
        key = (yr >> (bit + 1)) * (int(xr.max()) + 1) + xr  # by block of y, then x
        order = np.argsort(key, kind="stable")
        key, group, upper, w = key[order], (yr >> (bit + 1))[order], (yr >> bit & 1)[order] == 1, n[order]
        low = np.concatenate(([0.0], np.cumsum(np.where(upper, 0.0, w))))  # weight of the lower half so far
        less = low[np.searchsorted(key, key[upper], "left")]
        upto = low[np.searchsorted(key, key[upper], "right")]
        first, last = low[np.searchsorted(group, group[upper], "left")], low[np.searchsorted(group, group[upper], "right")]
        total += float((w[upper] * ((less - first) - (last - upto))).sum())
    return total


#: Cells of a bucket of Kendall's tau, about, and the least and largest number of buckets.
KENDALL_CELLS = 200_000
KENDALL_BUCKETS = (16, 1024)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(tau): tau-b of two columns, from the counts of their cells; null where a column is constant.

    Values are put in buckets by rank. Pairs of cells in different buckets of both columns are
    counted from the table of buckets, those in one bucket of x, and those in one bucket of y
    but not of x, within that bucket; no pairs are listed.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = written(both.groupBy("x", "y").agg(F.count("*").cast("double").alias("n")))
    buckets = int(min(max(KENDALL_BUCKETS[0], cells.count() / KENDALL_CELLS), KENDALL_BUCKETS[1]))
    out, ties = cells, {}
    for c in ("x", "y"):
        counts, total = counted(both, c)
        size = max(total // buckets, 1)
        out = out.join(counts.select(F.col("v").alias(c), F.floor(F.col("below") / size).cast("int").alias(f"b{c}")), c)
        ties[c] = counts.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    out = written(out)

    def inside(a: str, b: str):
        def run(t: pa.Table) -> pa.Table:
            u, v, n = (t[k].to_numpy().astype(np.float64) for k in (a, b, "n"))
            return pa.table({"s": [concordance(u, v, n)]})

        return run

    s = sum(r["s"] for by, a, b in (("bx", "x", "y"), ("by", "bx", "y")) for r in out.groupBy(by).applyInArrow(inside(a, b), "s double").collect())
    table = np.array([tuple(r) for r in out.groupBy("bx", "by").agg(F.sum("n")).collect()]).reshape(-1, 3)  # buckets by buckets
    if len(table):
        m = np.zeros((int(table[:, 0].max()) + 1, int(table[:, 1].max()) + 1))
        m[table[:, 0].astype(int), table[:, 1].astype(int)] = table[:, 2]
        below = np.cumsum(m, axis=0) - m  # rows of smaller buckets of x
        upto = np.cumsum(below, axis=1)
        s += float((m * ((upto - below) - (upto[:, -1:] - upto))).sum())
    pairs = total * (total - 1) / 2
    scale = math.sqrt((pairs - ties["x"]) * (pairs - ties["y"]))
    return df.sparkSession.createDataFrame([(s / scale if scale else None,)], "tau double")


def fisher_z(df: DataFrame, cols: list[str], z: float) -> DataFrame:
    """(var_i, var_j, r, z, independent) for all pairs: |z| below the normal quantile z means independent."""
    pairs = covariance_long(df, cols, True).where("var_i < var_j or var_i > var_j")
    n = df.select(*cols).dropna().agg(F.count("*").alias("n"))
    s = 0.5 * F.sqrt(F.col("n") - 3) * F.log((1 + F.col("value")) / (1 - F.col("value")))
    return pairs.join(F.broadcast(n)).select("var_i", "var_j", F.col("value").alias("r"), s.alias("z"), (F.abs(s) < z).alias("independent"))


def partial_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var_i, var_j, given, r) for every pair and each single other column, by the recursion formula."""
    c = covariance_long(df, cols, True)
    full = c.union(c.select("var_j", "var_i", "value")).distinct()
    ij, ik, jk = (full.select(F.col("var_i").alias(a), F.col("var_j").alias(b), F.col("value").alias(f"r{a}{b}")) for a, b in (("i", "j"), ("i", "k"), ("j", "k")))
    rows = ij.where("i < j").join(ik.where("i <> k"), "i").join(jk.where("j <> k"), ["j", "k"])
    r = (F.col("rij") - F.col("rik") * F.col("rjk")) / F.sqrt((1 - F.col("rik") ** 2) * (1 - F.col("rjk") ** 2))
    return rows.select(F.col("i").alias("var_i"), F.col("j").alias("var_j"), F.col("k").alias("given"), r.alias("r"))


# contingency


def contingency(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols).groupBy(*cols).agg(F.count("*").alias("n"))


def margins(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of all sub-tables in one pass; a summed-out column is null and its bit is set in `level`."""
    return df.dropna(subset=cols).cube(*cols).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


def _expected(df: DataFrame, x: str, y: str, strata: list[str]) -> DataFrame:
    cells = contingency(df, [x, y, *strata])
    rows, cols, all_ = (cells.groupBy(*k, *strata).agg(F.sum("n").alias(v)) for k, v in (([x], "nx"), ([y], "ny"), ([], "nz")))
    on = lambda *k: [*k, *strata]
    grid = rows.join(cols, strata) if strata else rows.crossJoin(cols)  # attested values of two columns
    full = grid.join(cells, on(x, y), "left").na.fill(0, ["n"])
    full = full.join(all_, strata) if strata else full.crossJoin(all_)
    return full.withColumn("e", F.col("nx") * F.col("ny") / F.col("nz"))


def chi_square(df: DataFrame, x: str, y: str, strata: list[str] | None = None) -> DataFrame:
    """(chi2, g2, df): Pearson and likelihood-ratio statistics over strata with more than one attested row and column."""
    strata = strata or []
    e = _expected(df, x, y, strata)
    per = e.groupBy(*strata).agg(
        F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi2"),
        F.sum(F.when(F.col("n") > 0, 2 * F.col("n") * F.log(F.col("n") / F.col("e"))).otherwise(0.0)).alias("g2"),
        ((F.count_distinct(x) - 1) * (F.count_distinct(y) - 1)).alias("df"),
    )
    return per.where("df > 0").agg(F.coalesce(F.sum("chi2"), F.lit(0.0)).alias("chi2"), F.coalesce(F.sum("g2"), F.lit(0.0)).alias("g2"), F.coalesce(F.sum("df"), F.lit(0)).alias("df"))


def entropies(df: DataFrame, cols: list[str]) -> DataFrame:
    """Shannon entropy in nats of each discrete column."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "var", "value").where("value is not null")
    n = rows.groupBy("var", "value").agg(F.count("*").alias("n"))
    return n.groupBy("var").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


def mutual_information(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var_i, var_j, mi) in nats for pairs of discrete columns; one grouping-sets pass."""
    t = df.dropna(subset=cols)
    pairs = list(combinations(cols, 2))
    parts = []
    for a, b in pairs:
        cells = t.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
        w = cells.withColumns({"na": F.sum("n").over(W.partitionBy("a")), "nb": F.sum("n").over(W.partitionBy("b"))})
        s = w.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log(F.col("n") / (F.col("na") * F.col("nb")))).alias("s"))
        parts.append(s.select(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), (F.col("s") / F.col("t") + F.log("t")).alias("mi")))
    return reduce(DataFrame.union, parts)


def local_bic(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """(loglik, parameters, n) of a discrete child given parents, from one table of counts."""
    cells = contingency(df, [child, *parents])
    total = F.sum("n").over(W.partitionBy(*parents)) if parents else F.sum("n").over(W.partitionBy())
    w = cells.withColumn("t", total)
    k = df.dropna(subset=[child, *parents]).agg(F.count_distinct(child).alias("k"), *[F.count_distinct(p).alias(f"r{i}") for i, p in enumerate(parents)])
    free = reduce(lambda a, i: a * F.col(f"r{i}"), range(len(parents)), F.col("k") - 1)
    return w.agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("t"))).alias("loglik"), F.sum("n").alias("n")).join(F.broadcast(k)).select("loglik", free.alias("parameters"), "n")


def conditional_gaussian_loglik(df: DataFrame, continuous: str, discrete: list[str]) -> DataFrame:
    """(cells, loglik) of one continuous column with a mean and variance in each discrete cell."""
    cells = df.dropna(subset=[continuous, *discrete]).groupBy(*discrete).agg(F.count("*").alias("n"), F.var_pop(continuous).alias("v"))
    return cells.where("v > 0").agg(F.count("*").alias("cells"), F.sum(-0.5 * F.col("n") * (F.log(2 * math.pi * F.col("v")) + 1)).alias("loglik"))


# pairwise directions, from standardised columns


def skew_directions(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var_i, var_j, skew, rskew, tanh): positive values speak for i --> j."""
    from .transforms import standardize

    z = standardize(df.select(*cols).dropna(), cols)
    aggs = []
    for k, (a, b) in enumerate(combinations(cols, 2)):
        x, y = F.col(a), F.col(b)
        aggs += [F.avg(x * y).alias(f"r{k}"), F.avg(x * x * y - x * y * y).alias(f"s{k}"), F.avg(x * F.tanh(y) - F.tanh(x) * y).alias(f"t{k}")]
        g = lambda v: F.log(F.cosh(F.greatest(v, F.lit(0.0))))
        aggs.append(F.avg(g(x) * y - x * g(y)).alias(f"g{k}"))
    one = z.agg(*aggs)
    rows = [
        F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), (F.col(f"r{k}") * F.col(f"s{k}")).alias("skew"), (F.col(f"r{k}") * F.col(f"g{k}")).alias("rskew"), (F.col(f"r{k}") * F.col(f"t{k}")).alias("tanh"))
        for k, (a, b) in enumerate(combinations(cols, 2))
    ]
    return one.select(F.inline(F.array(*rows)))


def spacing_entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var, s): mean log gap of the sorted standardised values (zero gaps skipped), the data part of the spacing entropy."""
    from .transforms import standardize

    rows = long(standardize(df.select(*cols).dropna(), cols), cols)
    values = rows.groupBy("var", "value").agg(F.count("*").alias("n"))
    gap = F.col("value") - F.lag("value").over(W.partitionBy("var").orderBy("value"))
    return values.withColumn("gap", gap).groupBy("var").agg((F.sum(F.log("gap")) / (F.sum("n") - 1)).alias("s"))


def false_discovery_cutoff(df: DataFrame, col: str, alpha: float, dependent: bool = True) -> DataFrame:
    """(cutoff, index): the largest p-value within its bound and its place from 0 among all in order; a null and -1 if none is.

    Bounds are alpha * k / (c * (m + 1)) for the k-th smallest of m, c the harmonic sum up to k
    if the tests may depend on each other, else 1. By ranks of range partitions.
    """
    from .transforms import counted

    counts, m = counted(df, col, "double")
    k = (F.col("below") + F.col("n")).cast("double")  # the last place of equal values has the widest bound
    few = F.element_at(F.array(*[F.lit(sum(1 / j for j in range(1, i + 1))) for i in range(1, 31)]), F.least(k, F.lit(30.0)).cast("int"))
    many = F.log(k) + 0.5772156649015329 + 1 / (2 * k) - 1 / (12 * k * k) + 1 / (120 * k * k * k * k)
    bound = alpha * k / (F.when(k <= 30, few).otherwise(many) if dependent else F.lit(1.0)) / (m + 1)
    last = counts.where(F.col("v") < bound).agg(F.max(F.struct(F.col("v"), (k - 1).cast("int").alias("at"))).alias("last"))
    return last.select(F.col("last.v").alias("cutoff"), F.coalesce(F.col("last.at"), F.lit(-1)).alias("index"))
