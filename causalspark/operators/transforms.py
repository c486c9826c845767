"""Row and column transforms of tables as DataFrame operations.

Missing values are nulls; NaN and the code -99 become null when a table is loaded. Statistics
that a transform needs come from one aggregation whose single row is joined to all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.tables import fresh, written


def _with_stats(df: DataFrame, aggs: dict[str, Column]) -> tuple[DataFrame, Callable[[str], Column]]:
    """(df with one column more, which holds the aggregates of df; the aggregate of a name)."""
    name = fresh(df, "stats")
    one = df.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs.values())]).select(F.struct("*").alias(name))
    at = {n: f"a{k}" for k, n in enumerate(aggs)}
    return df.join(F.broadcast(one)), lambda n: F.col(name).getField(at[n])  # one row, whatever the size of df


def normalise_missing(df: DataFrame, cols: list[str] | None = None, code: int = -99) -> DataFrame:
    kinds = dict(df.dtypes)
    out = {}
    for c in cols or df.columns:
        if kinds[c] in ("double", "float"):
            out[c] = F.when(~F.isnan(c), F.col(c))
        elif kinds[c] in ("int", "bigint", "smallint", "tinyint"):
            out[c] = F.when(F.col(c) != code, F.col(c))
    return df.withColumns(out)


def center(df: DataFrame, cols: list[str]) -> DataFrame:
    """x - mean; nulls stay null and do not count."""
    s, mean = _with_stats(df, {c: F.avg(c) for c in cols})
    return s.select(*[(F.col(c) - mean(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / sd with divisor n - 1; a constant column becomes null; nulls stay null and do not count."""
    s, of = _with_stats(df, {(k, c): f(c) for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    one = lambda c: F.when(of(("s", c)) > 0, (F.col(c) - of(("m", c))) / of(("s", c)))
    return s.select(*[one(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """The mean of the values that are there; a column without any stays null."""
    s, mean = _with_stats(df, {c: F.avg(c) for c in cols})
    return s.select(*[F.coalesce(F.col(c).cast("double"), mean(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """The most frequent value, the smallest of several."""
    s, mode = _with_stats(df, {c: F.mode(F.col(c), True) for c in cols})
    return s.select(*[F.coalesce(F.col(c), mode(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def impute_extra_category(df: DataFrame, cols: list[str], label: str = "*") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(label)) for c in cols})


def impute_regression(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """Missing targets from their regression on the predictors over the complete rows."""
    from ..plans.suffstats import sufficient_stats

    s = sufficient_stats(df, [target, *predictors])
    b, _ = s.regress(target, predictors)
    base = float(s.means[0] - b @ s.means[1:])
    fitted = reduce(lambda acc, x: acc + F.col(x[0]) * float(x[1]), zip(predictors, b, strict=True), F.lit(base))
    return df.withColumn(target, F.coalesce(F.col(target).cast("double"), fitted))


def replace_missing_random(df: DataFrame, col: str, values: list, seed: int, row_id: str) -> DataFrame:
    """A value drawn by a hash of the row id and the seed, so that a repeated task draws the same."""
    pick = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(len(values))).cast("int")
    return df.withColumn(col, F.coalesce(F.col(col), F.element_at(F.array(*map(F.lit, values)), pick + 1)))


def unit_hash(row_id: str, seed: int) -> Column:
    """A number in [0, 1) from the row id and the seed."""
    return F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def add_missing(df: DataFrame, cols: list[str], share: float, seed: int, row_id: str) -> DataFrame:
    return df.withColumns({c: F.when(unit_hash(row_id, seed + k) >= share, F.col(c)) for k, c in enumerate(cols)})


def contains_missing(df: DataFrame) -> DataFrame:
    return df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in df.columns])


def drop_constant(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if one[c] > 1])


def is_binary(df: DataFrame, col: str) -> bool:
    return bool(df.agg(F.coalesce(F.bool_and(F.col(col).isNull() | F.col(col).isin(0, 1)), F.lit(True))).first()[0])


def equal_intervals(df: DataFrame, col: str, k: int, out: str | None = None) -> DataFrame:
    """Bins of equal width from minimum to maximum; a value on a bound belongs to the bin above."""
    s, of = _with_stats(df, {"lo": F.min(col).cast("double"), "hi": F.max(col).cast("double")})
    cuts = [(F.col(col) >= of("lo") + (g + 1) * (of("hi") - of("lo")) / k).cast("int") for g in range(k - 1)]
    return s.select(*df.columns, reduce(lambda a, b: a + b, cuts, F.lit(0)).alias(out or f"{col}_bin"))


def counted(df: DataFrame, col: str, kind: str | None = None) -> tuple[DataFrame, int]:
    """((v, n, below) for each distinct value, the number of rows): n rows hold v, `below` a smaller value; NaN counts as missing.

    Distinct values are range-partitioned and written once, as ranges differ between runs; the
    driver sees the number of rows of each partition only.
    """
    value = F.col(col).cast(kind) if kind else F.col(col)
    there = F.col(col).isNotNull()
    if dict(df.dtypes)[col] in ("double", "float"):
        there = there & ~F.isnan(col)
    counts = df.where(there).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("p")))
    sizes = dict(sorted(tuple(r) for r in ranged.groupBy("p").agg(F.sum("n")).collect()))
    offset, at = {-1: 0}, 0
    for p, n in sizes.items():
        offset[p] = at
        at += n
    first = F.element_at(F.create_map(*[F.lit(x) for pair in offset.items() for x in pair]), F.col("p"))
    below = F.sum("n").over(W.partitionBy("p").orderBy("v")) - F.col("n") + first
    return ranged.select("v", "n", below.cast("long").alias("below")), at


#: Distinct values of a column whose ranks are sent to all executors, 24 bytes each; beyond, they are joined by a shuffle.
SENT_RANKS = 1_000_000


def _ranged_counts(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """(k, v, n, p), written once: n rows hold v in the k-th column, p is its range; and (k, p, rows, distinct values) of each range in order."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(cols)])).alias("cell")
    counts = df.select(cells).select("cell.k", "cell.v").where("v is not null and not isnan(v)").groupBy("k", "v").agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange("k", "v").select("k", "v", "n", F.spark_partition_id().alias("p")))
    return ranged, sorted(tuple(r) for r in ranged.groupBy("k", "p").agg(F.sum("n"), F.count("*")).collect())  # partitions and columns


def order_statistics(df: DataFrame, cols: list[str], places: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """{(column, place): the value at that place, from 0, of the column's sorted values}; nulls and NaN have no place.

    All columns are counted in one pass; only the ranges of distinct values that hold a place are sorted.
    """
    ranged, sizes = _ranged_counts(df, cols)
    wanted, at = [], dict.fromkeys(range(len(cols)), 0)
    for k, p, n, _ in sizes:
        wanted += [(k, p, place - at[k], place) for place in places[cols[k]] if at[k] <= place < at[k] + n]
        at[k] += n
    if not wanted:
        return {}
    holds = reduce(lambda a, b: a | b, [(F.col("k") == k) & (F.col("p") == p) for k, p in sorted({w[:2] for w in wanted})])
    below = ranged.where(holds).withColumn("below", F.sum("n").over(W.partitionBy("k", "p").orderBy("v")) - F.col("n"))
    these = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(i).cast("long").alias("i"), F.lit(place).cast("long").alias("place")) for k, p, i, place in wanted])
    inside = F.filter(these, lambda w: (w["k"] == F.col("k")) & (w["p"] == F.col("p")) & (w["i"] >= F.col("below")) & (w["i"] < F.col("below") + F.col("n")))
    return {(cols[r["k"]], r["place"]): r["v"] for r in below.select("k", F.explode(F.transform(inside, lambda w: w["place"])).alias("place"), "v").collect()}


def counted_columns(df: DataFrame, cols: list[str]) -> dict[str, tuple[DataFrame, int]]:
    """{column: ((v, n, below) as `counted` gives it, the number of distinct values)}: all columns in one pass, written once."""
    ranged, sizes = _ranged_counts(df, cols)
    offset, distinct, at = {}, dict.fromkeys(range(len(cols)), 0), dict.fromkeys(range(len(cols)), 0)
    for k, p, n, d in sizes:
        offset[k, p] = at[k]
        at[k] += n
        distinct[k] += d
    below = F.sum("n").over(W.partitionBy("k", "p").orderBy("v")) - F.col("n")
    out = {}
    for k, c in enumerate(cols):
        first = F.element_at(F.create_map(*[F.lit(x) for (j, p), o in offset.items() if j == k for x in (p, o)]), F.col("p")) if distinct[k] else F.lit(0)
        out[c] = ranged.where(F.col("k") == k).select("v", "n", (below + first).cast("long").alias("below")), distinct[k]
    return out


def average_ranks_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with a column `x_rank` for each of the columns: average ranks from 1; nulls and NaN have none."""
    for c, (counts, distinct) in counted_columns(df, cols).items():
        v = fresh(df, "value")
        ranks = counts.select(F.col("v").alias(v), (F.col("below") + (F.col("n") + 1) / 2).alias(f"{c}_rank"))
        df = df.join(F.broadcast(ranks) if distinct <= SENT_RANKS else ranks, F.col(c).cast("double") == F.col(v), "left").drop(v)
    return df


def quantile_points(df: DataFrame, col: str, k: int) -> list[float]:
    """The sorted values at n / k * (i + 1) with whole-number division: exact order statistics."""
    counts, total = counted(df, col, "double")
    if not total:
        return []
    wanted = [total // k * (i + 1) for i in range(k - 1)]
    inside = F.filter(F.array(*map(F.lit, wanted)), lambda w: (w >= F.col("below")) & (w < F.col("below") + F.col("n")))
    found = {r["w"]: r["v"] for r in counts.select("v", F.explode(inside).alias("w")).collect()}
    return [found[w] for w in wanted if w in found]


def cut(df: DataFrame, col: str, bounds: list[float], out: str | None = None) -> DataFrame:
    """The number of bounds that a value reaches; null stays null."""
    code = reduce(lambda a, b: a + (F.col(col) >= b).cast("int"), bounds, F.lit(0))
    return df.withColumn(out or f"{col}_bin", F.when(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")), code))


def equal_counts(df: DataFrame, col: str, k: int, out: str | None = None) -> DataFrame:
    return cut(df, col, quantile_points(df, col, k), out)


def histogram(df: DataFrame, col: str, bins: int, where: Column | None = None) -> DataFrame:
    """(bin, frequency) with all bins, of the rows that meet a condition; bins span those rows."""
    rows = df.where(where) if where is not None else df
    rows = rows.where(F.col(col).isNotNull())
    s, of = _with_stats(rows, {"lo": F.min(col).cast("double"), "hi": F.max(col).cast("double")})
    at = F.when(of("hi") > of("lo"), F.floor((F.col(col) - of("lo")) / (of("hi") - of("lo")) * bins)).otherwise(0)
    counted = s.select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("frequency"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").na.fill(0, ["frequency"])


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks from 1, tied values sharing their mean; nulls and NaN have none. By one count for each value and running sums of ranges."""
    counts, _ = counted(df, col)
    v = fresh(df, "value")
    ranked = counts.select(F.col("v").alias(v), (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranked, F.col(col) == F.col(v), "left").drop(v)


def nonparanormal(df: DataFrame, col: str, out: str) -> DataFrame:
    """Truncated normal scores of the ranks, brought to the column's own mean and deviation.

    Scores are computed once for each distinct value; nulls and NaN become null.
    """
    from ..functions.special import normal_quantile

    counts, n = counted(df, col)
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))
    delta = 1 / (4 * n**0.25 * math.sqrt(math.pi * math.log(n))) if n > 1 else 0.5

    @F.pandas_udf("double")
    def score(p):
        return p.map(normal_quantile)

    share = (F.col("below") + (F.col("n") + 1) / 2) / n
    z = written(counts.select("v", "n", score(F.greatest(F.lit(delta), F.least(F.lit(1 - delta), share))).alias("z")))
    x, w = F.col("v").cast("double"), F.col("n")
    m = z.agg((F.sum(w * x) / n).alias("m"), (F.sum(w * F.col("z")) / n).alias("zm")).first()
    dev = z.agg(F.sum(w * (x - m["m"]) ** 2).alias("s"), F.sum(w * (F.col("z") - m["zm"]) ** 2).alias("zs")).first()
    v = fresh(df, "value")
    scaled = F.col("z") * F.lit(math.sqrt(dev["s"] / dev["zs"]) if dev["zs"] else 0.0) + F.lit(float(m["m"]))
    return df.join(z.select(F.col("v").alias(v), scaled.alias(out)), F.col(col) == F.col(v), "left").drop(v)


def case_expand(df: DataFrame, multiplicity: str) -> DataFrame:
    """Each row as often as its multiplicity says; none for zero, negative and null."""
    m, k = F.col(multiplicity).cast("int"), fresh(df, "k")
    return df.where(m > 0).withColumn(k, F.explode(F.sequence(F.lit(1), m))).drop(k, multiplicity)


def bootstrap(df: DataFrame, replicates: int, seed: int, row_id: str) -> DataFrame:
    """df with `replicate` and `weight`: Poisson(1) weights from a hash of row, replicate and seed; rows of weight 0 left out.

    A table with columns of these names is refused.
    """
    if {"replicate", "weight"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column called replicate or weight")
    u = F.pmod(F.xxhash64(F.col(row_id), F.col("replicate"), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    bounds, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        bounds.append(total)
        p /= k + 1
    weight = reduce(lambda a, b: a + (u >= b).cast("int"), bounds, F.lit(0))
    many = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return many.withColumn("weight", weight).where("weight > 0")


def subsamples(df: DataFrame, number: int, share: float, seed: int, row_id: str) -> DataFrame:
    """df with `replicate`: each row is in a replicate if its hash falls below the share."""
    u = F.pmod(F.xxhash64(F.col(row_id), F.col("replicate"), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).where(u < share)


def complementary_halves(df: DataFrame, pairs: int, seed: int, row_id: str) -> DataFrame:
    """df with `pair` and `half`: each row in one half of each pair, halves of equal size (but for one row)."""
    from .folds import half_column

    return half_column(df, row_id, pairs, seed)


def concatenate(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with the same variables, with a `dataset` number."""
    return reduce(lambda a, b: a.unionByName(b), [d.withColumn("dataset", F.lit(k)) for k, d in enumerate(frames)])


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """(code, label) of a discrete column, labels in order."""
    labels = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("label")).distinct()
    return labels.select((F.row_number().over(W.orderBy("label")) - 1).alias("code"), "label")


# time series: rows in the order of a column


def lagged(df: DataFrame, cols: list[str], order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """Columns `x`, `x_lag1`, ... for rows that have all lags, within each series of `by`."""
    w = W.partitionBy(*(by or [])).orderBy(order)
    out = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in range(1, lags + 1)}
    row = fresh(df, "row")
    return df.withColumns(out | {row: F.row_number().over(w)}).where(F.col(row) > lags).drop(row)


def difference(df: DataFrame, cols: list[str], order: str, by: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*(by or [])).orderBy(order)
    row = fresh(df, "row")
    return df.withColumns({c: F.col(c) - F.lag(c, 1).over(w) for c in cols} | {row: F.row_number().over(w)}).where(F.col(row) > 1).drop(row)


def ar_residuals(df: DataFrame, col: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """Residuals of a column on its own lags, pooled over series."""
    from ..plans.suffstats import sufficient_stats

    wide = lagged(df, [col], order, lags, by)
    names = [f"{col}_lag{k}" for k in range(1, lags + 1)]
    s = sufficient_stats(wide, [col, *names])
    b, _ = s.regress(col, names)
    base = float(s.means[0] - b @ s.means[1:])
    return wide.withColumn("residual", F.col(col) - reduce(lambda a, x: a + F.col(x[0]) * float(x[1]), zip(names, b, strict=True), F.lit(base)))
