"""Registered queries on edge tables with marks, on columns, and on formulas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import calculator as calc
from .operators import columns as co
from .operators import marked_tables as mt
from .operators import statistics as st
from .operators import transforms as tr
from .queries import _union, lineitem, query, rounded, t

# mixed graphs: suppliers' nations linked by neighbouring keys, marks from their sums


def _marked_sql(step: int, shift: int) -> str:
    m = f"(a + b + {shift}) % 5"
    left = f"CASE {m} WHEN 0 THEN '-' WHEN 1 THEN '>' WHEN 2 THEN '-' WHEN 3 THEN 'o' ELSE '>' END"
    right = f"CASE {m} WHEN 0 THEN '>' WHEN 1 THEN '>' WHEN 2 THEN '-' WHEN 3 THEN '>' ELSE '-' END"
    return (
        f"SELECT 'N' || a AS src, 'N' || b AS dst, {left} AS ep_src, {right} AS ep_dst FROM (SELECT DISTINCT s_nationkey AS a, (s_suppkey * {step} + {shift}) % 25 AS b FROM supplier WHERE s_suppkey <= 60) WHERE a < b"
    )


GRAPH, OTHER = _marked_sql(7, 0), _marked_sql(7, 1)


def _marked(spark, sf, step: int, shift: int):
    pairs = t(spark, sf, "supplier").where("s_suppkey <= 60").select(F.col("s_nationkey").cast("long").alias("a"), ((F.col("s_suppkey") * step + shift) % 25).alias("b")).distinct().where("a < b")
    m = (F.col("a") + F.col("b") + shift) % 5
    left = F.when(m == 0, "-").when(m == 1, ">").when(m == 2, "-").when(m == 3, "o").otherwise(">")
    right = F.when(m == 0, ">").when(m == 1, ">").when(m == 2, "-").when(m == 3, ">").otherwise("-")
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    return pairs.select(name("a").alias("src"), name("b").alias("dst"), left.alias("ep_src"), right.alias("ep_dst"))


def graph(spark, sf):
    return _marked(spark, sf, 7, 0)


def other(spark, sf):
    return _marked(spark, sf, 7, 1)


WAYS = f"g AS ({GRAPH}), w AS (SELECT src AS a, dst AS b, ep_src AS at_a, ep_dst AS at_b FROM g UNION ALL SELECT dst, src, ep_dst, ep_src FROM g)"
ADJ = f"SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({GRAPH})"


def _forms_sql(g: str) -> str:
    return (
        f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src < dst THEN (CASE ep_src WHEN '>' THEN '<' ELSE ep_src END) || '-' || ep_dst "
        f"ELSE (CASE ep_dst WHEN '>' THEN '<' ELSE ep_dst END) || '-' || ep_src END AS form FROM ({g})"
    )


@query(f"SELECT src, dst, ep_src, ep_dst FROM ({GRAPH}) WHERE ep_src = '>' AND ep_dst = '>'")
def graph_bidirected(spark, sf):
    return mt.bidirected(graph(spark, sf))


@query(f"SELECT src, dst, ep_src, ep_dst FROM ({GRAPH}) WHERE NOT (ep_src = '>' AND ep_dst = '>')")
def graph_drop_bidirected(spark, sf):
    return mt.drop_bidirected(graph(spark, sf))


@query(f"SELECT src, dst, CASE WHEN ep_src = '>' AND ep_dst = '>' THEN '-' ELSE ep_src END AS ep_src, CASE WHEN ep_src = '>' AND ep_dst = '>' THEN '-' ELSE ep_dst END AS ep_dst FROM ({GRAPH})")
def graph_bidirected_to_undirected(spark, sf):
    return mt.bidirected_to_undirected(graph(spark, sf))


@query(f"SELECT src, dst, CASE WHEN ep_src = '-' AND ep_dst = '-' THEN '>' ELSE ep_src END AS ep_src, CASE WHEN ep_src = '-' AND ep_dst = '-' THEN '>' ELSE ep_dst END AS ep_dst FROM ({GRAPH})")
def graph_undirected_to_bidirected(spark, sf):
    return mt.undirected_to_bidirected(graph(spark, sf))


@query(f"SELECT src, dst, '-' AS ep_src, '-' AS ep_dst FROM ({GRAPH})")
def graph_unoriented(spark, sf):
    return mt.unoriented(graph(spark, sf))


@query(
    f"WITH n AS (SELECT 'N' || n_nationkey AS old, n_name AS new FROM nation WHERE n_nationkey % 2 = 0) SELECT coalesce(x.new, src) AS src, coalesce(y.new, dst) AS dst, ep_src, ep_dst FROM ({GRAPH}) g LEFT JOIN n x ON g.src = x.old LEFT JOIN n y ON g.dst = y.old"
)
def graph_renamed(spark, sf):
    names = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("old"), F.col("n_name").alias("new"))
    return mt.renamed(graph(spark, sf), names)


@query(f"SELECT * FROM ({ADJ}) EXCEPT SELECT DISTINCT least(src, dst), greatest(src, dst) FROM ({OTHER})")
def graph_adjacencies_missing(spark, sf):
    return mt.adjacencies_missing(graph(spark, sf), other(spark, sf))


@query(
    f"WITH {WAYS} SELECT x.a, x.b, y.a AS c, x.at_b = '>' AND y.at_b = '>' AS collider FROM w x JOIN w y ON x.b = y.b AND x.a < y.a WHERE NOT EXISTS (SELECT 1 FROM w z WHERE z.a = x.a AND z.b = y.a)"
)
def graph_unshielded(spark, sf):
    return mt.unshielded(graph(spark, sf))


@query(f"WITH {WAYS} SELECT a AS node, bool_and((at_a = '-' AND at_b = '>') OR (at_a = '>' AND at_b = '-')) AS all_directed FROM w GROUP BY a")
def graph_directed_neighbours(spark, sf):
    return mt.directed_neighbours(graph(spark, sf))


@query(
    f"WITH e AS (SELECT * FROM ({GRAPH}) UNION ALL SELECT dst, src, ep_src, ep_dst FROM ({GRAPH}) WHERE ep_src = '-' AND ep_dst = '>' AND length(src) = 2), "
    "d AS (SELECT src, dst FROM e WHERE ep_src = '-' AND ep_dst = '>' UNION SELECT dst, src FROM e WHERE ep_src = '>' AND ep_dst = '-') SELECT x.src AS a, x.dst AS b FROM d x JOIN d y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst"
)
def graph_two_cycles(spark, sf):
    g = graph(spark, sf)
    back = g.where("ep_src = '-' and ep_dst = '>' and length(src) = 2").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ep_src", "ep_dst")
    return mt.two_cycles(g.union(back))


@query(f"SELECT coalesce(x.form, 'none') AS true_form, coalesce(y.form, 'none') AS estimated_form, count(*) AS n FROM ({_forms_sql(GRAPH)}) x FULL JOIN ({_forms_sql(OTHER)}) y USING (a, b) GROUP BY 1, 2")
def graph_misclassification(spark, sf):
    return mt.misclassification(other(spark, sf), graph(spark, sf))


@query(
    f"WITH {WAYS}, h AS ({OTHER}), v AS (SELECT src AS a, dst AS b, ep_dst AS at_b FROM h UNION ALL SELECT dst, src, ep_src FROM h) SELECT count(*) FILTER (w.at_b <> '>') AS n FROM v JOIN w USING (a, b) WHERE v.at_b = '>'"
)
def graph_direction_errors(spark, sf):
    return mt.direction_errors(other(spark, sf), graph(spark, sf))


@query(f"SELECT count(*) FILTER (x.form IS DISTINCT FROM y.form) AS shd FROM ({_forms_sql(GRAPH)}) x FULL JOIN ({_forms_sql(OTHER)}) y USING (a, b)")
def graph_hamming(spark, sf):
    return mt.hamming(other(spark, sf), graph(spark, sf))


@query(
    f"SELECT a, b, count(DISTINCT g) AS graphs, count(DISTINCT form) AS forms FROM (SELECT *, 0 AS g FROM ({_forms_sql(GRAPH)}) UNION ALL SELECT *, 1 FROM ({_forms_sql(OTHER)}) UNION ALL SELECT *, 2 FROM ({_forms_sql(_marked_sql(11, 0))})) GROUP BY 1, 2"
)
def graph_agreement(spark, sf):
    return mt.agreement([graph(spark, sf), other(spark, sf), _marked(spark, sf, 11, 0)])


@query(
    f"WITH e AS (SELECT * FROM ({GRAPH}) UNION ALL SELECT dst, dst, ep_src, ep_dst FROM ({OTHER})) SELECT 'no_edges_to_self' AS rule, count(*) FILTER (src = dst) AS n FROM e UNION ALL "
    "SELECT 'directed_only', count(*) FILTER (NOT ((ep_src = '-' AND ep_dst = '>') OR (ep_src = '>' AND ep_dst = '-'))) FROM e UNION ALL "
    "SELECT 'directed_or_undirected', count(*) FILTER (NOT ((ep_src = '-' AND ep_dst = '>') OR (ep_src = '>' AND ep_dst = '-') OR (ep_src = '-' AND ep_dst = '-'))) FROM e UNION ALL "
    "SELECT 'at_most_one_edge', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM e GROUP BY least(src, dst), greatest(src, dst))"
)
def graph_violations(spark, sf):
    loops = other(spark, sf).select(F.col("dst").alias("src"), "dst", "ep_src", "ep_dst")
    return mt.violations(graph(spark, sf).union(loops))


DENSE = f"{GRAPH} UNION ALL {_marked_sql(11, 0)} UNION ALL {_marked_sql(3, 2)} UNION ALL {_marked_sql(13, 5)} UNION ALL {_marked_sql(17, 9)}"


def _dense(spark, sf):
    return graph(spark, sf).union(_marked(spark, sf, 11, 0)).union(_marked(spark, sf, 3, 2)).union(_marked(spark, sf, 13, 5)).union(_marked(spark, sf, 17, 9))


_FOUR = f"WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({DENSE})), k AS (SELECT x.a AS p, x.b AS q, y.b AS r, z.b AS s FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b JOIN e u ON u.a = x.a AND u.b = y.b JOIN e v ON v.a = x.a AND v.b = z.b JOIN e w ON w.a = x.b AND w.b = z.b)"


@query(f"{_FOUR} SELECT p || ',' || q || ',' || r || ',' || s AS nodes FROM k")
def graph_cliques(spark, sf):
    """Sets of four nodes that are all adjacent."""
    return mt.cliques(_dense(spark, sf), 4).select(F.array_join("nodes", ",").alias("nodes"))


@query(
    f"{_FOUR}, o AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT p || ',' || q || ',' || r || ',' || s AS nodes FROM k WHERE NOT EXISTS "
    "(SELECT 1 FROM o w JOIN o x ON x.b = w.b AND x.a = k.q JOIN o y ON y.b = w.b AND y.a = k.r JOIN o z ON z.b = w.b AND z.a = k.s WHERE w.a = k.p)"
)
def graph_maximal_cliques(spark, sf):
    dense = _dense(spark, sf)
    return mt.maximal(mt.cliques(dense, 4), dense).select(F.array_join("nodes", ",").alias("nodes"))


# columns

CONT = ["l_quantity", "l_price", "l_discount", "l_tax"]
LI = "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice / 1000 AS l_price, l_discount, l_tax FROM lineitem"


def _z(c: str, digits: str) -> str:
    return f"WITH s AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM ({LI})), z AS (SELECT ({c} - m) / s AS z FROM ({LI}), s) SELECT '{c}' AS var, {digits} FROM z"


@query(_union(f"(SELECT * FROM ({_z(c, 'round(avg(z ** 5), 4) + 0.0 AS fifth, round(avg(z ** 6), 3) + 0.0 AS sixth')}))" for c in CONT))
def higher_moments(spark, sf):
    m = co.higher_moments(lineitem(spark, sf), CONT)
    return m.select("var", (F.round("fifth", 4) + 0.0).alias("fifth"), (F.round("sixth", 3) + 0.0).alias("sixth"))


@query(_union(f"SELECT '{c}' AS var, count({c}) AS n, round(avg({c}), 4) + 0.0 AS mean, round(var_pop({c}) * count({c}), 1) + 0.0 AS ssx, round(var_samp({c}), 4) + 0.0 AS s_square FROM ({LI})" for c in CONT))
def squares(spark, sf):
    m = co.squares(lineitem(spark, sf), CONT)
    return m.select("var", "n", F.round("mean", 4).alias("mean"), F.round("ssx", 1).alias("ssx"), F.round("s_square", 4).alias("s_square"))


_SCORES = (
    f"round((avg(ln((exp(z) + exp(-z)) / 2)) - {co.LOG_COSH!r}) ** 2, 7) + 0.0 AS log_cosh, round((avg(abs(z)) - sqrt(2 / pi())) ** 2, 7) + 0.0 AS mean_absolute"
)


@query(
    "SELECT x.var, log_cosh, mean_absolute, log_mean_exp FROM (" + _union(f"(SELECT * FROM ({_z(c, _SCORES)}))" for c in CONT) + ") x JOIN ("
    + _union(f"SELECT '{c}' AS var, round(ln(avg(exp({c}))), 5) + 0.0 AS log_mean_exp FROM ({LI})" for c in CONT) + ") y USING (var)"
)
def non_normality(spark, sf):
    m = co.non_normality(lineitem(spark, sf), CONT)
    return m.select("var", F.round("log_cosh", 7).alias("log_cosh"), F.round("mean_absolute", 7).alias("mean_absolute"), F.round("log_mean_exp", 5).alias("log_mean_exp"))


_ENTROPY = f"round(ln(2 * pi()) / 2 + 0.5 - ({co.K2!r} * (avg(ln((exp(z) + exp(-z)) / 2)) - {co.GAMMA!r}) ** 2 + {co.K1!r} * avg(z * exp(z * z / 2)) ** 2) + ln((SELECT s FROM s)), 4) + 0.0 AS entropy"


@query(_union(f"(SELECT * FROM ({_z(c, _ENTROPY)}))" for c in CONT))
def maximum_entropy(spark, sf):
    return rounded(co.maximum_entropy(lineitem(spark, sf), CONT))


@query("SELECT CAST(trunc(corr(l_quantity, l_extendedprice) * 10000) AS SMALLINT) AS r FROM lineitem")
def compressed_correlation(spark, sf):
    return co.compressed_correlation(lineitem(spark, sf), "l_quantity", "l_price")


@query("SELECT o_orderkey, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def copied_column(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return co.copy_column(orders, t(spark, sf, "customer"), "c_custkey", "c_acctbal").select("o_orderkey", "c_acctbal")


@query("SELECT l_linenumber, count(*) AS n, round(sum(l_tax), 2) + 0.0 AS tax FROM lineitem GROUP BY 1")
def shuffled_columns(spark, sf):
    """The data do not change with the order of the columns."""
    li = t(spark, sf, "lineitem")
    back = co.reorder_columns(co.shuffle_columns(li, 5), co.collect_variables([li.select("l_tax"), li.select("l_linenumber", "l_tax")]))
    return rounded(back.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_tax").alias("tax")), 2)


@query("SELECT CAST(p_size AS DOUBLE) AS size, count(*) AS n FROM part GROUP BY 1")
def numeric_labels(spark, sf):
    labels = t(spark, sf, "part").select(F.col("p_size").cast("string").alias("size"))
    return co.numeric_labels(labels, ["size"]).groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, true AS noisy, count(*) FILTER (p_size = 0) AS zeroes FROM part")
def noisy_zeroes(spark, sf):
    """A column of noughts becomes noise of mean 0 and deviation 1, within sampling error; others stay."""
    df = t(spark, sf, "part").select("p_partkey", "p_size").withColumn("none", F.lit(0.0))
    out = co.noisy_zeroes(df, ["p_size", "none"], "p_partkey", 3)
    return out.agg(F.count("*").alias("rows"), ((F.abs(F.avg("none")) < 0.2) & (F.abs(F.stddev_samp("none") - 1) < 0.2)).alias("noisy"), F.count_if(F.col("p_size") == 0).alias("zeroes"))


@query("SELECT count(*) AS rows, round(sum(value), 1) + 0.0 AS total FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def without_nan(spark, sf):
    return rounded(co.drop_nan(t(spark, sf, "events"), ["value"]).agg(F.count("*").alias("rows"), F.sum("value").alias("total")), 1)


@query("SELECT 'l_tax' AS var, round(stddev_samp(l_tax), 6) AS sd, round(stddev_samp(l_tax), 6) AS sd_after, true AS in_order FROM lineitem")
def nonparanormal_moments(spark, sf):
    """Normal scores keep a column's deviation and its order."""
    df = t(spark, sf, "lineitem").select("l_tax")
    out = tr.nonparanormal(df, "l_tax", "z")
    one = out.agg(F.stddev_samp("l_tax").alias("sd"), F.stddev_samp("z").alias("sd_after"))
    levels = out.groupBy("l_tax").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    same = levels.agg((F.max(F.col("hi") - F.col("lo")) < 1e-9).alias("in_order"))
    return one.join(same).select(F.lit("l_tax").alias("var"), F.round("sd", 6).alias("sd"), F.round("sd_after", 6).alias("sd_after"), "in_order")


@query("SELECT count(*) AS rows, count(*) FILTER (l_quantity > 10) AS kept, true AS near_share FROM lineitem")
def missing_and_replaced(spark, sf):
    """Values that go missing by a hash, near the wanted share, and random legal values in their place."""
    df = lineitem(spark, sf).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("id", "l_quantity", F.col("l_returnflag").alias("f"))
    gone = tr.add_missing(df, ["f"], 0.3, 5, "id")
    back = tr.replace_missing_random(gone, "f", ["A", "N", "R"], 6, "id")
    share = gone.agg((F.abs(F.avg(F.col("f").isNull().cast("int")) - 0.3) < 0.02).alias("near_share"))
    return back.agg(F.count("f").alias("rows"), F.count_if(F.col("l_quantity") > 10).alias("kept")).join(share)


@query("SELECT 20 AS replicates, true AS near_one, true AS spread")
def bootstrap_weights(spark, sf):
    """Poisson weights: their mean is one in each replicate, and they differ between replicates."""
    orders = t(spark, sf, "orders").select("o_orderkey")
    w = tr.bootstrap(orders, 20, 9, "o_orderkey").groupBy("replicate").agg(F.sum("weight").alias("w"))
    n = orders.count()
    return w.agg(F.count("*").cast("int").alias("replicates"), (F.max(F.abs(F.col("w") / n - 1)) < 0.05).alias("near_one"), (F.count_distinct("w") > 10).alias("spread"))


@query("SELECT 'l_linenumber' AS var, false AS missing, false AS is_binary UNION ALL SELECT 'l_tax', false, false")
def missing_and_binary(spark, sf):
    li = t(spark, sf, "lineitem").select("l_linenumber", "l_tax")
    flags = tr.contains_missing(li).first()
    return spark.createDataFrame([(c, bool(flags[c]), tr.is_binary(li, c)) for c in li.columns], "var string, missing boolean, is_binary boolean")


@query("SELECT p_size, sum(p_partkey % 4) AS n FROM part WHERE p_partkey % 4 > 0 GROUP BY 1")
def case_expansion(spark, sf):
    part = t(spark, sf, "part").select("p_size", (F.col("p_partkey") % 4).alias("times"))
    return tr.case_expand(part, "times").groupBy("p_size").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_tax FROM lineitem WHERE l_linenumber = 1")
def constants_dropped(spark, sf):
    return tr.drop_constant(t(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_tax"))


# formulas: every function, on values in its domain

_FORMULAS = {
    "ceil": ("ceil(x)", "ceil(x)"), "floor": ("floor(x)", "floor(x)"), "abs": ("abs(x - 25)", "abs(x - 25)"), "signum": ("signum(x - 25)", "sign(x - 25)"), "cos": ("cos(x)", "cos(x)"),
    "cosh": ("cosh(x / 50)", "(exp(x / 50) + exp(-x / 50)) / 2"), "acos": ("acos(x / 60)", "acos(x / 60)"), "log10": ("log10(x)", "log10(x)"), "ln": ("ln(x)", "ln(x)"), "tan": ("tan(x / 60)", "tan(x / 60)"),
    "tanh": ("tanh(x / 50)", "(exp(x / 50) - exp(-x / 50)) / (exp(x / 50) + exp(-x / 50))"), "atan": ("atan(x)", "atan(x)"), "sqrt": ("sqrt(x)", "sqrt(x)"), "sin": ("sin(x)", "sin(x)"),
    "sinh": ("sinh(x / 50)", "(exp(x / 50) - exp(-x / 50)) / 2"), "asin": ("asin(x / 60)", "asin(x / 60)"), "exp": ("exp(x / 50)", "exp(x / 50)"), "power": ("pow(x, 2)", "x * x"), "caret": ("x ^ 3", "x * x * x"),
    "min": ("min(x, y)", "least(x, y)"), "max": ("max(x, y)", "greatest(x, y)"), "round": ("round(x / 7)", "floor(x / 7 + 0.5)"), "logistic": ("logistic(x / 50)", "1 / (1 + exp(-x / 50))"),
    "or": ("OR(x < 10, y < 10)", "(x < 10 OR y < 10)::INT"), "and": ("AND(x < 30, y < 30)", "(x < 30 AND y < 30)::INT"), "xor": ("XOR(x < 10, y < 10)", "((x < 10) <> (y < 10))::INT"),
    "less_equal": ("x <= 25", "(x <= 25)::INT"), "greater_equal": ("x >= 25", "(x >= 25)::INT"), "if": ("IF(x < 25, x, y)", "CASE WHEN x < 25 THEN x ELSE y END"),
}


@query("WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, (l_tax * 500)::DOUBLE AS y FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({s})::DOUBLE, 4) + 0.0 AS f_{n}" for n, (_, s) in _FORMULAS.items()) + " FROM v WHERE l_orderkey % 4 = l_linenumber % 4")
def calculator_functions(spark, sf):
    v = t(spark, sf, "lineitem").where("l_orderkey % 4 = l_linenumber % 4").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_tax") * 500).cast("double").alias("y"))
    return rounded(v.select("l_orderkey", "l_linenumber", *[calc.compile_expression(f).cast("double").alias(f"f_{n}") for n, (f, _) in _FORMULAS.items()]))


_DRAWS = {
    "uniform": ("Uniform(2, 4)", 3.0), "normal": ("Normal(5, 2)", 5.0), "exponential": ("ExponentialDist(2)", 0.5), "gamma": ("Gamma(2, 3)", 6.0), "beta": ("Beta(2, 2)", 0.5), "poisson": ("Poisson(3)", 3.0),
    "chi_square": ("ChiSquare(4)", 4.0), "laplace": ("Laplace(1, 2)", 1.0), "triangular": ("Triangular(0, 1, 2)", 1.0),
}
_MEANS = {n: m for n, (_, m) in _DRAWS.items()}


@query(_union(f"SELECT '{n}' AS distribution, true AS near_mean" for n in _MEANS))
def calculator_draws(spark, sf):
    """Random functions of formulas: means within sampling error of the known ones."""
    rows = t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    drawn = rows.select(*[calc.compile_expression(_DRAWS[n][0], 11 + 100 * k, "id").alias(n) for k, n in enumerate(_MEANS)])
    one = drawn.agg(*[F.avg(n).alias(n) for n in _MEANS]).unpivot([], list(_MEANS), "distribution", "m")
    near = F.lit(None).cast("boolean")
    for n, m in _MEANS.items():
        near = F.when(F.col("distribution") == n, F.abs(F.col("m") - m) < 0.1).otherwise(near)
    return one.select("distribution", near.alias("near_mean"))


@query("WITH c AS (SELECT l_linenumber AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) SELECT round(-sum(n / (SELECT sum(n) FROM c) * ln(n / (SELECT sum(n) FROM c))), 5) + 0.0 AS entropy, 'l_linenumber' AS var FROM c")
def entropy_of_lines(spark, sf):
    return rounded(st.entropies(t(spark, sf, "lineitem"), ["l_linenumber"]), 5)
