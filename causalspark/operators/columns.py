"""Changes of a table's columns, and scores of how far columns are from normal."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import fresh
from .transforms import standardize, unit_hash


def continuous_schema(count: int, prefix: str = "X") -> T.StructType:
    """A schema of so many continuous columns X1, X2, ..."""
    return T.StructType([T.StructField(f"{prefix}{k + 1}", T.DoubleType()) for k in range(count)])


def copy_column(df: DataFrame, source: DataFrame, key: str, col: str) -> DataFrame:
    """df with a column of another table, matched by a key that is unique there; rows without a match get null."""
    name = fresh(df, "key")
    other = source.select(F.col(key).alias(name), F.col(col))
    return df.drop(col).join(other, F.col(key) == F.col(name), "left").drop(name)


def shuffle_columns(df: DataFrame, seed: int) -> DataFrame:
    """The columns in an order drawn by the seed."""
    import random

    order = list(df.columns)
    random.Random(seed).shuffle(order)
    return df.select(*[F.col(f"`{c}`") for c in order])


def reorder_columns(df: DataFrame, like: list[str]) -> DataFrame:
    """The columns in the order of a list; all must be there, others are dropped."""
    missing = [c for c in like if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.select(*[F.col(f"`{c}`") for c in like])


def collect_variables(frames: list[DataFrame]) -> list[str]:
    """The names of all columns of tables, in order of first appearance."""
    return list(dict.fromkeys(c for d in frames for c in d.columns))


def restrict_to_measured(df: DataFrame, latent: set[str]) -> DataFrame:
    return df.drop(*latent)


def numeric_labels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Discrete columns whose labels are numbers as continuous ones; other labels become null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in cols})


def noisy_zeroes(df: DataFrame, cols: list[str], row_id: str, seed: int) -> DataFrame:
    """Columns that are nought in every row become normal noise, drawn by hashes of row and seed."""
    zero = df.agg(*[F.coalesce(F.bool_and(F.col(c) == 0), F.lit(False)).alias(c) for c in cols]).first()
    out = {}
    for k, c in enumerate(cols):
        if zero[c]:  # two uniform numbers make a normal one
            u, v = F.greatest(unit_hash(row_id, seed + 2 * k), F.lit(2.0**-53)), unit_hash(row_id, seed + 2 * k + 1)
            out[c] = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    return df.withColumns(out) if out else df


def drop_nan(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without null and NaN in these columns."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]))


def stacked(spark: SparkSession, df: DataFrame, cols: list[str], aggs: list) -> DataFrame:
    """(var, ...) from one aggregation: aggs(column) gives named expressions for each column."""
    one = df.agg(*[F.struct(*aggs(F.col(f"`{c}`"))).alias(f"a{k}") for k, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("var"), *[F.col(f"a{k}.{f.name}").alias(f.name) for f in one.schema[f"a{k}"].dataType]) for k, c in enumerate(cols)])))


def higher_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var, fifth, sixth): moments of the values standardised with divisor n - 1, means over n."""
    z = standardize(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols)
    return stacked(df.sparkSession, z, cols, lambda c: [F.avg(c * c * c * c * c).alias("fifth"), F.avg(c * c * c * c * c * c).alias("sixth")])


def squares(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var, n, mean, ssx, s_square): sum of squared differences from the mean, undivided and by n - 1."""
    return stacked(
        df.sparkSession, df, cols, lambda c: [F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("ssx"), F.var_samp(c).alias("s_square")]
    )


#: Expected log cosh of a standard normal, as the scores below take it, and constants of the entropy bound: fixed values.
LOG_COSH = 0.3746764078432371
GAMMA = 0.37457
K1 = 36 / (8 * math.sqrt(3) - 9)
K2 = 79.047


def non_normality(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var, log_cosh, mean_absolute, log_mean_exp): squared distances of mean log cosh and mean absolute value of the
    standardised column from those of a normal one, and the logarithm of its own mean exponential (not standardised)."""
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    z = stacked(
        df.sparkSession, standardize(plain, cols), cols,
        lambda c: [F.pow(F.avg(F.log(F.cosh(c))) - LOG_COSH, F.lit(2.0)).alias("log_cosh"), F.pow(F.avg(F.abs(c)) - math.sqrt(2 / math.pi), F.lit(2.0)).alias("mean_absolute")],
    )
    e = stacked(df.sparkSession, plain, cols, lambda c: [F.log(F.avg(F.exp(c))).alias("log_mean_exp")])
    return z.join(e, "var")


def maximum_entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var, entropy): the maximum-entropy approximation from two moments of the standardised column."""
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    z = stacked(df.sparkSession, standardize(plain, cols), cols, lambda c: [F.avg(F.log(F.cosh(c))).alias("b1"), F.avg(c * F.exp(c * c / 2)).alias("b2")])
    s = stacked(df.sparkSession, plain, cols, lambda c: [F.stddev_samp(c).alias("sd")])
    value = F.lit(math.log(2 * math.pi) / 2 + 0.5) - (K2 * (F.col("b1") - GAMMA) ** 2 + K1 * F.col("b2") ** 2) + F.log("sd")
    return z.join(s, "var").select("var", value.alias("entropy"))


def compressed_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(r): the correlation as a small integer, ten thousandths cut off towards nought."""
    return df.agg((F.corr(x, y) * 10000).cast("int").cast("smallint").alias("r"))
