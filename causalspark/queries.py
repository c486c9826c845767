"""Registered queries over the standard tables and the SQL that gives the same rows.

Doubles are rounded on both sides, since sums in another order differ in their last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.special import normal_quantile
from .operators import calculator as calc
from .operators import graph_tables as gt
from .operators import models as md
from .operators import statistics as st
from .operators import transforms as tr
from .plans.suffstats import covariance_long, grouped_stats, sufficient_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONT = ["l_quantity", "l_price", "l_discount", "l_tax"]
DISC = ["l_returnflag", "l_linestatus"]
LI = "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice / 1000 AS l_price, l_discount, l_tax FROM lineitem"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", (F.col("l_extendedprice") / 1000).alias("l_price"), "l_discount", "l_tax")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded; minus nought becomes nought."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _pairs(names, strict=True):
    return [(a, b) for i, a in enumerate(names) for b in names[i + strict :]]


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


# sufficient statistics


@query(_union(f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(covar_samp({a}, {b}), 4) + 0.0 AS value FROM ({LI})" for a, b in _pairs(CONT, False)))
def cov_matrix(spark, sf):
    return rounded(covariance_long(lineitem(spark, sf), CONT))


@query(_union(f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(corr({a}, {b}), 4) + 0.0 AS value FROM ({LI})" for a, b in _pairs(CONT, False)))
def corr_matrix(spark, sf):
    return rounded(covariance_long(lineitem(spark, sf), CONT, True))


@query(_union(f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(covar_samp({a}, {b}), 4) + 0.0 AS value FROM ({LI})" for a in CONT for b in CONT))
def cov_matrix_wide(spark, sf):
    """The p x p path for many columns: partial moments of each task."""
    return rounded(sufficient_stats(lineitem(spark, sf), CONT).to_df(spark))


Z05 = normal_quantile(0.975)


@query(
    f"WITH n AS (SELECT count(*) AS n FROM lineitem), c AS ({_union(f'''SELECT '{a}' AS var_i, '{b}' AS var_j, corr({a}, {b}) AS r FROM ({LI})''' for a, b in _pairs(CONT))}) "
    f"SELECT var_i, var_j, round(r, 4) + 0.0 AS r, round(0.5 * sqrt(n - 3) * ln((1 + r) / (1 - r)), 4) + 0.0 AS z, abs(0.5 * sqrt(n - 3) * ln((1 + r) / (1 - r))) < {Z05!r} AS independent FROM c, n"
)
def fisher_z_pairs(spark, sf):
    return rounded(st.fisher_z(lineitem(spark, sf), CONT, Z05).where("var_i <> var_j"))


SUMS = ["l_quantity", "l_price", "l_tax", "net", "charge"]
SUMS_SQL = "SELECT l_quantity, l_extendedprice / 1000 AS l_price, l_tax, l_extendedprice / 1000 * (1 - l_discount) AS net, l_extendedprice / 1000 * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem"


@query(
    f"WITH n AS (SELECT count(*) AS n FROM lineitem), c AS ({_union(f'''SELECT '{a}' AS src, '{b}' AS dst, corr({a}, {b}) AS r FROM ({SUMS_SQL})''' for a, b in _pairs(SUMS))}) "
    f"SELECT src, dst, '-' AS ep_src, '-' AS ep_dst FROM c, n WHERE abs(0.5 * sqrt(n - 3) * ln((1 + r) / (1 - r))) >= {Z05!r}"
)
def fisher_z_skeleton(spark, sf):
    """Edges of the skeleton of depth 0, of columns some of which follow from others."""
    net = F.col("l_price") * (1 - F.col("l_discount"))
    rows = lineitem(spark, sf).select("l_quantity", "l_price", "l_tax", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("charge"))
    z = st.fisher_z(rows, SUMS, Z05).where("not independent and var_i <> var_j")
    return z.select(F.col("var_i").alias("src"), F.col("var_j").alias("dst"), F.lit("-").alias("ep_src"), F.lit("-").alias("ep_dst"))


def _partial_sql() -> str:
    rows = []
    for a, b in _pairs(sorted(CONT)):
        for c in sorted(CONT):
            if c not in (a, b):
                rows.append(f"SELECT '{a}' AS var_i, '{b}' AS var_j, '{c}' AS given, round((corr({a}, {b}) - corr({a}, {c}) * corr({b}, {c})) / sqrt((1 - corr({a}, {c}) ** 2) * (1 - corr({b}, {c}) ** 2)), 4) + 0.0 AS r FROM ({LI})")
    return _union(rows)


@query(_partial_sql())
def partial_corr_1(spark, sf):
    return rounded(st.partial_correlations(lineitem(spark, sf), CONT))


@query(
    f"WITH n AS (SELECT count(*) AS n FROM lineitem), c AS ({_union(f'''SELECT '{a}' AS var_i, '{b}' AS var_j, corr({a}, {b}) AS r FROM ({LI})''' for a, b in _pairs(CONT))}) "
    "SELECT var_i, var_j, round(r * sqrt((n - 2) / (1 - r * r)), 3) + 0.0 AS t FROM c, n"
)
def corr_t(spark, sf):
    li = lineitem(spark, sf)
    n = li.agg(F.count("*").alias("n"))
    c = covariance_long(li, CONT, True).where("var_i <> var_j").join(F.broadcast(n))
    return rounded(c.select("var_i", "var_j", (F.col("value") * F.sqrt((F.col("n") - 2) / (1 - F.col("value") ** 2))).alias("t")), 3)


@query(
    "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("p_size", "p_retailprice", "p_partkey")) + " FROM part) "
    + _union(f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(corr({a}, {b}), 4) + 0.0 AS value FROM r" for a, b in _pairs(["p_partkey", "p_retailprice", "p_size"]))
)
def spearman(spark, sf):
    return rounded(st.spearman(t(spark, sf, "part"), ["p_partkey", "p_retailprice", "p_size"]))


@query(
    "WITH c AS (SELECT l_discount AS x, l_tax AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b), "
    "x AS (SELECT sum(t * (t - 1) / 2) AS tx, sum(t) AS n FROM (SELECT sum(n) AS t FROM c GROUP BY x)), y AS (SELECT sum(t * (t - 1) / 2) AS ty FROM (SELECT sum(n) AS t FROM c GROUP BY y)) "
    "SELECT round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) + 0.0 AS tau FROM s, x, y"
)
def kendall_tau(spark, sf):
    return rounded(st.kendall(t(spark, sf, "lineitem"), "l_discount", "l_tax"), 6)


@query(
    _union(
        f"SELECT '{c}' AS var, count({c}) AS n, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS sd, round(min({c}), 4) + 0.0 AS min, round(max({c}), 4) + 0.0 AS max, "
        f"round(quantile_cont({c}, 0.25), 4) + 0.0 AS q1, round(quantile_cont({c}, 0.5), 4) + 0.0 AS median, round(quantile_cont({c}, 0.75), 4) + 0.0 AS q3 FROM ({LI})"
        for c in CONT
    )
)
def summary(spark, sf):
    return rounded(st.summary(lineitem(spark, sf), CONT))


@query(
    _union(
        f"SELECT '{c}' AS var, round((sum((x - m) ** 3) / (count(*) - 1)) / (sum((x - m) ** 2) / count(*)) ** 1.5, 4) + 0.0 AS skewness, "
        f"round((sum((x - m) ** 4) / count(*)) / (sum((x - m) ** 2) / (count(*) - 1)) ** 2 - 3, 4) + 0.0 AS kurtosis, round(avg(abs(x - m)), 4) + 0.0 AS average_deviation "
        f"FROM (SELECT {c} AS x, avg({c}) OVER () AS m FROM ({LI}))"
        for c in CONT
    )
)
def skew_kurt(spark, sf):
    return rounded(st.moments(lineitem(spark, sf), CONT))


# transforms


@query("SELECT p_partkey, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 4) + 0.0 AS {c}" for c in ("p_size", "p_retailprice")) + " FROM part")
def standardize(spark, sf):
    return rounded(tr.standardize(t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"]))


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (), 4) + 0.0 AS c_acctbal FROM customer")
def center(spark, sf):
    return rounded(tr.center(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


_MISS = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events"


def _missing(spark, sf):
    return t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))


@query(f"SELECT event_id, round(coalesce(value, avg(value) OVER ()), 4) + 0.0 AS value FROM ({_MISS})")
def mean_impute(spark, sf):
    return rounded(tr.impute_mean(_missing(spark, sf).select("event_id", "value"), ["value"]))


@query(f"WITH e AS ({_MISS}), m AS (SELECT event_type AS m FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT event_id, coalesce(event_type, m) AS event_type FROM e, m")
def mode_impute(spark, sf):
    return tr.impute_mode(_missing(spark, sf).select("event_id", "event_type"), ["event_type"])


@query(f"SELECT event_id, coalesce(event_type, '*') AS event_type FROM ({_MISS})")
def extra_category(spark, sf):
    return tr.impute_extra_category(_missing(spark, sf).select("event_id", "event_type"), ["event_type"])


@query(
    "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS y, p_size::DOUBLE AS x FROM part), r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p) "
    "SELECT p_partkey, round(coalesce(y, a + b * x), 3) + 0.0 AS y FROM p, r"
)
def regression_impute(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 != 0, F.col("p_retailprice")).alias("y"), F.col("p_size").cast("double").alias("x"))
    return rounded(tr.impute_regression(p, "y", ["x"]).select("p_partkey", "y"), 3)


@query(
    "WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, "
    + " + ".join(f"CASE WHEN c_acctbal >= lo + {g} * (hi - lo) / 5 THEN 1 ELSE 0 END" for g in range(1, 5)) + " AS bin FROM customer, s"
)
def equal_width(spark, sf):
    return tr.equal_intervals(t(spark, sf, "customer"), "c_acctbal", 5, "bin").select("c_custkey", "bin")


@query(
    "WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS k, count(*) OVER () AS n FROM customer), b AS (SELECT v FROM r WHERE k IN (n // 4, n // 4 * 2, n // 4 * 3)) "
    "SELECT c_custkey, (SELECT count(*) FROM b WHERE c_acctbal >= v)::INTEGER AS bin FROM customer"
)
def equal_count(spark, sf):
    return tr.equal_counts(t(spark, sf, "customer"), "c_acctbal", 4, "bin").select("c_custkey", "bin")


def _histogram_sql(where: str) -> str:
    return (
        f"WITH e AS (SELECT value AS x FROM events WHERE value IS NOT NULL AND {where}), s AS (SELECT min(x) AS lo, max(x) AS hi FROM e), c AS (SELECT least(floor((x - lo) / (hi - lo) * 10), 9)::INTEGER AS bin, count(*) AS n FROM e, s GROUP BY 1) "
        "SELECT b.bin::INTEGER AS bin, coalesce(n, 0)::BIGINT AS frequency FROM range(10) b(bin) LEFT JOIN c USING (bin)"
    )


@query(_histogram_sql("true"))
def histogram(spark, sf):
    return tr.histogram(t(spark, sf, "events"), "value", 10)


@query(_histogram_sql("event_type = 'click' AND user_id BETWEEN 2 AND 50"))
def cond_histogram(spark, sf):
    return tr.histogram(t(spark, sf, "events"), "value", 10, (F.col("event_type") == "click") & F.col("user_id").between(2, 50))


@query("SELECT p_partkey, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS r FROM part")
def average_rank(spark, sf):
    return tr.average_ranks(t(spark, sf, "part"), "p_retailprice", "r").select("p_partkey", "r")


@query("SELECT p_partkey, k.k::INTEGER AS copy FROM part, range(1, 5) k(k) WHERE k.k <= p_size % 5")
def case_expand(spark, sf):
    """Each part as often as its multiplicity says, the copies numbered."""
    many = tr.case_expand(t(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).alias("m")), "m")
    w = F.row_number().over(tr.W.partitionBy("p_partkey").orderBy("p_partkey"))
    return many.select("p_partkey", w.alias("copy"))


@query(
    "SELECT event_id, user_id, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w > 2"
)
def lag_expand(spark, sf):
    return tr.lagged(t(spark, sf, "events").select("event_id", "user_id", "value"), ["value"], "event_id", 2, ["user_id"])


@query("SELECT event_id, user_id, round(value - lag(value) OVER w, 4) + 0.0 AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w > 1")
def difference(spark, sf):
    return rounded(tr.difference(t(spark, sf, "events").select("event_id", "user_id", "value"), ["value"], "event_id", ["user_id"]))


@query(
    "WITH l AS (SELECT event_id, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events), r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l WHERE x IS NOT NULL) "
    "SELECT event_id, round(y - a - b * x, 4) + 0.0 AS residual FROM l, r WHERE x IS NOT NULL"
)
def ar_resid(spark, sf):
    return rounded(tr.ar_residuals(t(spark, sf, "events").select("event_id", "user_id", "value"), "value", "event_id", 1, ["user_id"]).select("event_id", "residual"))


@query("SELECT 0 AS dataset, s_suppkey AS id, s_acctbal AS acctbal FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer")
def row_union_datasets(spark, sf):
    return tr.concatenate(
        [t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal")), t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"))]
    )


@query(
    "SELECT p_partkey, round(ln(p_retailprice) + greatest(p_size, 10) * CASE WHEN p_size > 25 THEN 1 ELSE 0.5 END, 4) + 0.0 AS y, round(1 / (1 + exp(-(p_size - 25.0) / 5)), 4) + 0.0 AS z, "
    "CASE WHEN p_size % 1 = 0 AND p_size < 10 THEN 1.0 ELSE 0.0 END AS w FROM part"
)
def calculator_expr(spark, sf):
    out = calc.transform(t(spark, sf, "part"), "y = ln(p_retailprice) + max(p_size, 10) * IF(p_size > 25, 1, 0.5)", "z = logistic((p_size - 25) / 5)", "w = AND(p_size < 10, 1 = 1)")
    return rounded(out.select("p_partkey", "y", "z", "w"))


@query("SELECT p_type AS label, (row_number() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_type FROM part)")
def category_codes(spark, sf):
    return tr.category_codes(t(spark, sf, "part"), "p_type").select("label", "code")


# contingency


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def contingency(spark, sf):
    return st.contingency(t(spark, sf, "lineitem"), DISC)


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def margins(spark, sf):
    return st.margins(t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


def _chi_sql(table: str, x: str, y: str, z: str) -> str:
    return f"""
WITH d AS (SELECT {x} AS x, {y} AS y, {z} AS z FROM {table}), c AS (SELECT x, y, z, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT x, z, sum(n) AS nx FROM c GROUP BY ALL), k AS (SELECT y, z, sum(n) AS ny FROM c GROUP BY ALL),
s AS (SELECT z, sum(n) AS nz, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS df FROM c GROUP BY ALL),
e AS (SELECT z, coalesce(n, 0) AS n, nx * ny / nz::DOUBLE AS e, df FROM r JOIN k USING (z) JOIN s USING (z) LEFT JOIN c USING (x, y, z) WHERE df > 0),
p AS (SELECT z, sum((n - e) ** 2 / e) AS chi2, sum(CASE WHEN n > 0 THEN 2 * n * ln(n / e) ELSE 0 END) AS g2, max(df) AS df FROM e GROUP BY ALL)
SELECT round(sum(chi2), 3) + 0.0 AS chi2, round(sum(g2), 3) + 0.0 AS g2, sum(df)::BIGINT AS df FROM p"""


@query(_chi_sql("orders", "o_orderstatus", "o_orderpriority", "1"))
def chi_square(spark, sf):
    return rounded(st.chi_square(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), 3)


@query(_chi_sql("lineitem", "l_returnflag", "l_linestatus", "l_linenumber"))
def chi_square_cond(spark, sf):
    return rounded(st.chi_square(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["l_linenumber"]), 3)


@query(_union(f"SELECT '{c}' AS var, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) + 0.0 AS entropy FROM (SELECT count(*) AS n FROM orders GROUP BY {c})" for c in ("o_orderstatus", "o_orderpriority")))
def entropy(spark, sf):
    return rounded(st.entropies(t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]), 6)


def _mi_sql(table: str, cols: list[str]) -> str:
    one = lambda a, b: (
        f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(sum(n * ln(n / (na * nb))) / sum(n) + ln(sum(n)), 6) + 0.0 AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY {a}) AS na, sum(n) OVER (PARTITION BY {b}) AS nb "
        f"FROM (SELECT {a}, {b}, count(*)::DOUBLE AS n FROM {table} GROUP BY 1, 2))"
    )
    return _union(one(a, b) for a, b in _pairs(cols))


@query(_mi_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"]))
def bin_mutual_information(spark, sf):
    return rounded(st.mutual_information(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]), 6)


@query(
    "WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT n, sum(n) OVER (PARTITION BY l_linestatus, l_linenumber) AS s FROM c), "
    "k AS (SELECT (count(DISTINCT l_returnflag) - 1) * count(DISTINCT l_linestatus) * count(DISTINCT l_linenumber) AS f FROM lineitem) "
    "SELECT round(sum(n * ln(n / s)), 3) + 0.0 AS loglik, max(f)::BIGINT AS parameters, sum(n)::BIGINT AS n FROM w, k"
)
def bic_discrete(spark, sf):
    return rounded(st.local_bic(t(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"]), 3)


@query("SELECT l_linestatus, l_linenumber, l_returnflag, count(*) AS n, lgamma(1.0 / 42 + count(*)) - lgamma(1.0 / 42) AS gain FROM lineitem GROUP BY ALL".replace("lgamma(1.0 / 42 + count(*)) - lgamma(1.0 / 42)", "round(lgamma(1.0 / 42 + count(*)) - lgamma(1.0 / 42), 4)"))
def bdeu_counts(spark, sf):
    """The cells and their terms of the Dirichlet likelihood of a child of three values and fourteen parent configurations."""
    cells = st.contingency(t(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber", "l_returnflag"])

    @F.pandas_udf("double")
    def gain(n):
        return n.map(lambda v: round(math.lgamma(1 / 42 + v) - math.lgamma(1 / 42), 4))

    return cells.withColumn("gain", gain("n"))


@query(
    "WITH c AS (SELECT count(*) AS n, var_pop(l_extendedprice / 1000) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus) "
    "SELECT count(*) AS cells, round(sum(-0.5 * n * (ln(2 * pi() * v) + 1)), 2) + 0.0 AS loglik FROM c WHERE v > 0"
)
def cg_loglik(spark, sf):
    return rounded(st.conditional_gaussian_loglik(lineitem(spark, sf), "l_price", DISC), 2)


@query(
    f"WITH s AS (SELECT count(*) AS n, var_samp(l_price) * (1 - corr(l_price, l_quantity) ** 2) AS s2 FROM ({LI})) SELECT n, round(-n * ln(s2 * n / (n - 3)) - 3 * ln(n), 2) + 0.0 AS score FROM s"
)
def sem_bic_1(spark, sf):
    from .operators.scores import SemBic

    s = sufficient_stats(lineitem(spark, sf), ["l_price", "l_quantity"])
    return spark.createDataFrame([(s.n, round(SemBic(s).local("l_price", ["l_quantity"]), 2))], "n long, score double")


@query(
    f"WITH s AS (SELECT l_returnflag AS g, count(*) AS n, var_samp(l_price) * (1 - corr(l_price, l_quantity) ** 2) AS s2 FROM ({LI}) GROUP BY 1) SELECT count(*) AS datasets, round(avg(-n * ln(s2 * n / (n - 3)) - 3 * ln(n)), 2) + 0.0 AS score FROM s"
)
def images_bic(spark, sf):
    """Mean score over the data sets that a column tells apart."""
    from .operators.scores import Images, SemBic
    from .plans.suffstats import grouped_stats

    parts = grouped_stats(lineitem(spark, sf), "l_returnflag", ["l_price", "l_quantity"])
    score = Images([SemBic(s) for s in parts.values()]).local("l_price", ["l_quantity"])
    return spark.createDataFrame([(len(parts), round(score, 2))], "datasets long, score double")


@query(f"SELECT unnest(['const', 'l_quantity']) AS var, round(unnest([regr_intercept(l_price, l_quantity), regr_slope(l_price, l_quantity)]), 4) + 0.0 AS coef FROM ({LI})")
def ols_1(spark, sf):
    return rounded(md.ols(lineitem(spark, sf), "l_price", ["l_quantity"]).to_df(spark).select("var", "coef"))


# directions


def _skew_sql(cols: list[str]) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in cols)
    g = lambda v: f"ln(cosh(greatest({v}, 0)))"
    return f"WITH z AS (SELECT {z} FROM ({LI})) " + _union(
        f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(avg({a} * {b}) * avg({a} * {a} * {b} - {a} * {b} * {b}), 5) + 0.0 AS skew, round(avg({a} * {b}) * avg({g(a)} * {b} - {a} * {g(b)}), 5) + 0.0 AS rskew, "
        f"round(avg({a} * {b}) * avg({a} * tanh({b}) - tanh({a}) * {b}), 5) + 0.0 AS tanh FROM z"
        for a, b in _pairs(cols)
    )


@query(_skew_sql(["l_quantity", "l_price", "l_tax"]))
def rskew_pairs(spark, sf):
    return rounded(st.skew_directions(lineitem(spark, sf), ["l_quantity", "l_price", "l_tax"]), 5)


@query(
    _union(
        f"SELECT '{c}' AS var, round(sum(ln(g)) / ((SELECT count(*) FROM customer) - 1), 4) + 0.0 AS s FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM (SELECT DISTINCT ({c} - (SELECT avg({c}) FROM customer)) / (SELECT stddev_samp({c}) FROM customer) AS v FROM customer)) WHERE g > 0"
        for c in ("c_acctbal", "c_custkey")
    )
)
def igci_entropy(spark, sf):
    c = t(spark, sf, "customer").select("c_acctbal", F.col("c_custkey").cast("double").alias("c_custkey"))
    return rounded(st.spacing_entropy(c, ["c_acctbal", "c_custkey"]))


# Bayesian networks


@query("SELECT l_linestatus, l_returnflag, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) + 0.0 AS p FROM lineitem GROUP BY 1, 2")
def cpt_mle(spark, sf):
    return rounded(md.cpt(t(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus"]), 6)


@query(
    "WITH g AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT o_orderstatus FROM orders)), c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) "
    "SELECT o_orderpriority, o_orderstatus, round((coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY o_orderpriority), 6) + 0.0 AS p FROM g LEFT JOIN c USING (o_orderpriority, o_orderstatus)"
)
def cpt_dirichlet(spark, sf):
    return rounded(md.cpt(t(spark, sf, "orders"), "o_orderstatus", ["o_orderpriority"], 1.0), 6)


@query(
    "WITH s AS (SELECT l_linestatus, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS p FROM lineitem GROUP BY 1), f AS (SELECT l_linestatus, l_returnflag, count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus) AS p FROM lineitem GROUP BY 1, 2), "
    "k AS (SELECT l_returnflag, l_linenumber, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, l_linenumber, round(sum(s.p * f.p * k.p), 6) + 0.0 AS p FROM s JOIN f USING (l_linestatus) JOIN k USING (l_returnflag) GROUP BY 1, 2"
)
def bn_joint(spark, sf):
    """A marginal of the network status --> flag --> number, by variable elimination."""
    from .operators.graph import Graph

    net = md.BayesNet.fit(t(spark, sf, "lineitem"), Graph.parse("l_linestatus-->l_returnflag,l_returnflag-->l_linenumber"))
    return rounded(net.marginal(["l_linestatus", "l_linenumber"]), 6)


@query(
    "WITH f AS (SELECT l_linestatus, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT l_returnflag, count(*) FILTER (l_linenumber = 1) / count(*)::DOUBLE AS p FROM lineitem GROUP BY 1) "
    "SELECT l_linestatus, round(sum(n * p) / sum(sum(n * p)) OVER (), 6) + 0.0 AS p FROM f JOIN k USING (l_returnflag) GROUP BY 1"
)
def bn_posterior(spark, sf):
    from .operators.graph import Graph

    net = md.BayesNet.fit(t(spark, sf, "lineitem"), Graph.parse("l_linestatus-->l_returnflag,l_returnflag-->l_linenumber"))
    return rounded(net.marginal(["l_linestatus"], {"l_linenumber": 1}).select("l_linestatus", "p"), 6)


# graphs as tables: nations stand under regions, customers' and suppliers' nations link up

_EDGES = "SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey * 2 + 1) FROM nation WHERE n_nationkey * 2 + 1 < 25"


def _graph_edges(spark, sf):
    n = t(spark, sf, "nation")
    name = lambda k: F.concat(F.lit("N"), k.cast("string"))
    a = n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("src"), name(F.col("n_nationkey")).alias("dst"))
    b = n.where("n_nationkey * 2 + 1 < 25").select(name(F.col("n_nationkey")).alias("src"), name(F.col("n_nationkey") * 2 + 1).alias("dst"))
    return a.union(b)


@query(f"WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT src AS ancestor, dst AS node FROM e UNION SELECT c.ancestor, e.dst FROM c JOIN e ON c.node = e.src) SELECT ancestor, node FROM c")
def ancestors(spark, sf):
    return gt.closure(_graph_edges(spark, sf))


@query(f"SELECT src AS node, count(*) AS children, (SELECT count(*) FROM ({_EDGES}) p WHERE p.dst = e.src) AS parents FROM ({_EDGES}) e GROUP BY src")
def parents_children(spark, sf):
    return gt.degrees(_graph_edges(spark, sf)).where("children > 0")


@query(
    f"WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({_EDGES}) WHERE src LIKE 'N%' UNION ALL SELECT dst, src FROM ({_EDGES}) WHERE src LIKE 'N%'), c AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON c.node = e.a) "
    "SELECT node, min(root) AS component FROM c GROUP BY node"
)
def connected_components(spark, sf):
    return gt.components(_graph_edges(spark, sf).where("src like 'N%'"))


@query(f"WITH e AS ({_EDGES}) SELECT DISTINCT least(a.src, b.src) AS a, greatest(a.src, b.src) AS b, a.dst AS child FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.src, e.dst) IN ((a.src, b.src), (b.src, a.src)))")
def unshielded_colliders(spark, sf):
    return gt.colliders(_graph_edges(spark, sf))


_EST = f"SELECT src, dst FROM ({_EDGES}) WHERE src <> 'R1' UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0 UNION ALL SELECT 'R0', 'R1'"


def _estimate(spark, sf):
    n = t(spark, sf, "nation").where("n_regionkey = 1 and n_nationkey % 2 = 0")
    back = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("dst"))
    return _graph_edges(spark, sf).where("src <> 'R1'").union(back).union(spark.createDataFrame([("R0", "R1")], "src string, dst string"))


@query(
    f"WITH t AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_EDGES})), e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_EST})) "
    "SELECT count(*) FILTER (t.a IS NOT NULL AND e.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*) FILTER (e.a IS NULL) AS fn FROM t FULL JOIN e USING (a, b)".replace("t.a IS", "ta IS").replace("e.a IS", "ea IS").replace("FROM t FULL JOIN e USING (a, b)", "FROM (SELECT a, b, 1 AS ta FROM t) FULL JOIN (SELECT a, b, 1 AS ea FROM e) USING (a, b)")
)
def adjacency_confusion(spark, sf):
    return gt.adjacency_confusion(_estimate(spark, sf), _graph_edges(spark, sf))


@query(
    f"WITH t AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, src AS ts FROM ({_EDGES})), e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, src AS es FROM ({_EST})) "
    "SELECT sum(CASE WHEN ts IS NULL OR es IS NULL THEN 2 WHEN ts <> es THEN 1 ELSE 0 END)::BIGINT AS shd FROM t FULL JOIN e USING (a, b)"
)
def shd(spark, sf):
    return gt.directed_shd(_estimate(spark, sf), _graph_edges(spark, sf))


# clusters, subsamples, selection

_CENTRES = [[5.0, 950.0], [25.0, 1200.0], [45.0, 1700.0]]


@query(
    "WITH d AS (SELECT p_partkey, [" + ", ".join(f"(p_size - {a}) ** 2 + (p_retailprice - {b}) ** 2" for a, b in _CENTRES) + "] AS d FROM part) SELECT p_partkey, (list_position(d, list_min(d)) - 1)::INTEGER AS cluster, round(list_min(d), 3) + 0.0 AS distance2 FROM d"
)
def kmeans_assign(spark, sf):
    return rounded(md.assign_clusters(t(spark, sf, "part"), ["p_size", "p_retailprice"], _CENTRES).select("p_partkey", "cluster", "distance2"), 3)


@query(
    "SELECT dataset, i AS var_i, j AS var_j, round(r, 4) + 0.0 AS r FROM (SELECT l_linenumber::INTEGER AS dataset, 'l_discount' AS i, 'l_price' AS j, corr(l_discount, l_extendedprice / 1000) AS r FROM lineitem GROUP BY 1 UNION ALL "
    "SELECT l_linenumber, 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem GROUP BY 1 UNION ALL SELECT l_linenumber, 'l_price', 'l_tax', corr(l_extendedprice / 1000, l_tax) FROM lineitem GROUP BY 1)"
)
def grouped_correlations(spark, sf):
    """Correlations within each data set from one pass."""
    cols = ["l_discount", "l_price", "l_tax"]
    parts = grouped_stats(lineitem(spark, sf), "l_linenumber", cols)
    rows = [(int(k), a, b, float(s.corr[s.index[a], s.index[b]])) for k, s in parts.items() for a, b in _pairs(cols)]
    return rounded(spark.createDataFrame(rows, "dataset int, var_i string, var_j string, r double"))


@query(
    "WITH r AS (SELECT l_linenumber, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b FROM lineitem GROUP BY 1), n AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1), "
    "f AS (SELECT avg((abs(0.5 * sqrt(n - 3) * ln((1 + a) / (1 - a))) >= 1.959963984540054)::INT) AS ta, avg((abs(0.5 * sqrt(n - 3) * ln((1 + b) / (1 - b))) >= 1.959963984540054)::INT) AS tb FROM r JOIN n USING (l_linenumber)) "
    "SELECT 'l_quantity|l_price' AS edge, round(2 * ta * (1 - ta), 6) + 0.0 AS instability FROM f UNION ALL SELECT 'l_quantity|l_discount', round(2 * tb * (1 - tb), 6) + 0.0 FROM f"
)
def instability(spark, sf):
    """How often edges come and go between subsamples: 2 f (1 - f) of their frequency f."""
    li = lineitem(spark, sf)
    rows = li.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.corr("l_quantity", "l_price").alias("l_quantity|l_price"), F.corr("l_quantity", "l_discount").alias("l_quantity|l_discount"))
    edges = rows.unpivot(["l_linenumber", "n"], ["l_quantity|l_price", "l_quantity|l_discount"], "edge", "r")
    hit = (F.abs(0.5 * F.sqrt(F.col("n") - 3) * F.log((1 + F.col("r")) / (1 - F.col("r")))) >= 1.959963984540054).cast("int")
    f = edges.groupBy("edge").agg(F.avg(hit).alias("f"))
    return rounded(f.select("edge", (2 * F.col("f") * (1 - F.col("f"))).alias("instability")), 6)


@query(
    "SELECT replicate::INTEGER AS replicate, count(*) AS n, round(avg(c_acctbal), 4) + 0.0 AS mean FROM customer, range(3) r(replicate) WHERE (c_custkey * 31 + replicate * 17) % 10 < 5 GROUP BY 1"
)
def stratified_halves(spark, sf):
    """Halves by a residue of the id, as one table of replicate and row."""
    c = t(spark, sf, "customer").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(2))))
    half = c.where((F.col("c_custkey") * 31 + F.col("replicate") * 17) % 10 < 5)
    return rounded(half.groupBy("replicate").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")))


@query(
    "WITH c AS (SELECT " + ", ".join(f"corr(l_extendedprice, {c}) AS {c}" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")) + " FROM lineitem), u AS (UNPIVOT c ON l_quantity, l_discount, l_tax, l_linenumber INTO NAME var VALUE r) SELECT var, round(abs(r), 5) + 0.0 AS relevance FROM u ORDER BY abs(r) DESC, var LIMIT 2"
)
def prefdiv_topk(spark, sf):
    """The most relevant variables for a target; with no redundancy threshold this is the top k by correlation."""
    from .operators.mixed import preferential_diversity

    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    li = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), *[F.col(c).cast("double").alias(c) for c in cols])
    s = sufficient_stats(li, ["y", *cols])
    relevance = {c: abs(float(s.corr[0, s.index[c]])) for c in cols}
    chosen = preferential_diversity(relevance, s.select(cols), 2, radius=1.0)
    return rounded(spark.createDataFrame([(c, relevance[c]) for c in chosen], "var string, relevance double"), 5)


@query(
    "WITH u AS (SELECT (p_partkey * 7919 % 10007 + 0.5) / 10007.0 AS u FROM part), p AS (SELECT u * u * u AS p FROM u), k AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) "
    "SELECT round(max(p), 7) + 0.0 AS cutoff, (max(k) - 1)::INTEGER AS index FROM k WHERE p < 0.05 * k / (m + 1)"
)
def fdr(spark, sf):
    """The false-discovery cutoff of a p-value for each part."""
    from .operators.statistics import false_discovery_cutoff

    u = (F.col("p_partkey") * 7919 % 10007 + 0.5) / 10007.0
    return rounded(false_discovery_cutoff(t(spark, sf, "part").select((u * u * u).alias("p")), "p", 0.05, False), 7)


# searches over the tables are in planted.py


@query(
    "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 4) + 0.0 AS mean_x, round(avg(user_id), 4) + 0.0 AS mean_y, round(covar_samp(value, user_id) + 0.00001, 2) + 0.0 AS cov_xy FROM events GROUP BY 1"
)
def windowed_stream_moments(spark, sf):
    """Moments of each hour of events, through a stream that ends with the files."""
    import uuid

    from .streaming.stats import windowed_moments

    schema = t(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumns({"k": F.col("user_id").cast("double"), "ts": F.col("ts").cast("timestamp")})
    name = f"moments_{uuid.uuid4().hex[:8]}"
    q = windowed_moments(stream, "ts", "value", "k", "1 hour").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.table(name).select(F.col("window.start").alias("start"), "n", "mean_x", "mean_y", F.round(F.col("cov_xy") + 0.00001, 2).alias("cov_xy")))
