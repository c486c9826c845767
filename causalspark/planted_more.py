"""More queries over planted columns: feedback, factors by tetrads, hidden cells, interventions.

They register themselves beside those of `planted`; expected rows are typed by hand.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cyclic
from .operators import independence as ind
from .operators import allrow, folds, ica, interventions, latent, missing, vanishing
from .operators.count_tree import CountTree, tree_test
from .operators.generalized_sem import Equation, fit_equations
from .operators.graph import Graph, cpdag
from .planted import ALPHA, DAG, DISCRETE_DAG, ORACLES, QUERIES, coin, discrete, flat, gauss, known, linear, measured, rows_of
from .operators.search import pc, skeleton
from .operators.transforms import unit_hash
from .plans.suffstats import sufficient_stats

CLASS = "kind first second third marks"


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """id and six variables at rest: X and Y cause each other, W --> A --> X, B --> Y, X --> Z."""
    df = rows_of(spark, sf).withColumns({"W": gauss("id", 61), "B": gauss("id", 62)}).withColumn("A", 0.9 * F.col("W") + gauss("id", 63))
    into_x, into_y = 0.9 * F.col("A") + gauss("id", 64), 0.9 * F.col("B") + gauss("id", 65)
    gain, back = 0.5, 0.4  # of Y on X and of X on Y
    x = ((into_x + gain * into_y) / (1 - gain * back)).alias("X")
    df = df.select("id", "W", "A", "B", x, into_y.alias("into_y")).withColumn("Y", F.col("into_y") + back * F.col("X"))
    return df.withColumn("Z", 0.9 * F.col("X") + gauss("id", 66)).select("id", "W", "A", "B", "X", "Y", "Z")


@known(
    CLASS,
    [
        ("edge", "W", "A", "", "o-o"),
        ("edge", "A", "X", "", "-->"),
        ("edge", "A", "Y", "", "-->"),
        ("edge", "B", "X", "", "-->"),
        ("edge", "B", "Y", "", "-->"),
        ("edge", "X", "Y", "", "---"),
        ("edge", "X", "Z", "", "o-o"),
        ("underlined", "W", "A", "X", ""),
        ("underlined", "W", "A", "Y", ""),
        ("underlined", "A", "X", "Z", ""),
        ("underlined", "B", "X", "Z", ""),
        ("underlined", "Y", "X", "Z", ""),
        ("dotted", "A", "X", "B", ""),
        ("dotted", "A", "Y", "B", ""),
    ],
)
def ccd_planted(spark, sf):
    """The class of a system in feedback, its triples tested by Spark tasks."""
    stats = sufficient_stats(feedback(spark, sf), ["W", "A", "B", "X", "Y", "Z"])
    return cyclic.ccd(ind.FisherZ(stats, ALPHA), spark=spark).to_df(spark)


@known(
    CLASS,
    [
        ("edge", "W", "A", "", "---"),
        ("edge", "A", "X", "", "-->"),
        ("edge", "A", "Y", "", "-->"),
        ("edge", "B", "X", "", "-->"),
        ("edge", "B", "Y", "", "-->"),
        ("edge", "X", "Z", "", "-->"),
        ("feedback", "X", "Y", "", ""),
    ],
)
def ccd_max_planted(spark, sf):
    """The same system with the pair in feedback named."""
    stats = sufficient_stats(feedback(spark, sf), ["W", "A", "B", "X", "Y", "Z"])
    return cyclic.ccd_max(ind.FisherZ(stats, ALPHA)).to_df(spark)


# factors by tetrads and sextads

PRICES = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
STATED = [[("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_quantity", "l_extendedprice", "l_tax", "l_discount")]]


def fourth_moments_lineitem(spark, sf):
    """Fourth moments of standardised columns that two tetrads need, and no others."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    stats = sufficient_stats(df, PRICES)
    found = vanishing.fourth_moments(df, vanishing.needed_products(STATED), stats)
    deviation = {v: float(stats.cov[k, k]) ** 0.5 for k, v in enumerate(stats.names)}
    rows = [(*k, v / deviation[k[0]] / deviation[k[1]] / deviation[k[2]] / deviation[k[3]]) for k, v in sorted(found.values.items())]
    out = spark.createDataFrame(rows, "var_i string, var_j string, var_k string, var_l string, value double")
    return out.withColumn("value", F.round("value", 6))


QUERIES["fourth_moments_lineitem"] = fourth_moments_lineitem
ORACLES["fourth_moments_lineitem"] = """
WITH z AS (
  SELECT (l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER () AS l_discount,
    (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS l_extendedprice,
    (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS l_quantity,
    (l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER () AS l_tax
  FROM (SELECT CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
    CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem)
), long AS (
  SELECT row_number() OVER () AS r, l_discount, l_extendedprice, l_quantity, l_tax FROM z
), cells AS (
  UNPIVOT long ON l_discount, l_extendedprice, l_quantity, l_tax INTO NAME v VALUE x
), pairs AS (SELECT DISTINCT * FROM (VALUES
  ('l_extendedprice', 'l_quantity'), ('l_discount', 'l_tax'), ('l_discount', 'l_quantity'), ('l_extendedprice', 'l_tax'), ('l_quantity', 'l_tax'), ('l_discount', 'l_extendedprice')) p(a, b)
), wanted AS (
  SELECT DISTINCT list_sort([p.a, p.b, q.a, q.b]) AS k FROM pairs p, pairs q
)
SELECT k[1] AS var_i, k[2] AS var_j, k[3] AS var_k, k[4] AS var_l, round(avg(a.x * b.x * c.x * d.x), 6) AS value
FROM wanted JOIN cells a ON a.v = k[1] JOIN cells b ON b.v = k[2] AND b.r = a.r JOIN cells c ON c.v = k[3] AND c.r = a.r JOIN cells d ON d.v = k[4] AND d.r = a.r
GROUP BY k
"""


@known("tetrads same", [("M1 M2 M3 M4", True), ("M1 M2 M5 M6", False), ("M1 M2 M3 M5", True), ("M1 M5 M6 M7", True)])
def tetrads_planted(spark, sf):
    """Whether both tetrads vanish together, by fourth moments of the rows."""
    sets = [("M1", "M2", "M3", "M4"), ("M1", "M2", "M5", "M6"), ("M1", "M2", "M3", "M5"), ("M1", "M5", "M6", "M7")]
    groups = [vanishing.tetrads(*s)[:2] for s in sets]
    test = vanishing.delta_test(measured(spark, sf), [f"M{k}" for k in range(1, 9)], groups=groups)
    return spark.createDataFrame([(" ".join(s), test.p_value(*g) > ALPHA) for s, g in zip(sets, groups, strict=True)], "tetrads string, same boolean")


def two_factors(spark: SparkSession, sf: str) -> DataFrame:
    """id and twelve indicators: six of two factors, six of two others of which one depends on a first one; and noise N."""
    df = rows_of(spark, sf).withColumns({f"f{k}": gauss("id", 70 + k) for k in range(3)}).withColumn("f3", 0.6 * F.col("f0") + gauss("id", 73))
    up = [0.9, 0.5, 1.1, 0.6, 1.0, 0.8]
    down = [0.6, 1.0, -0.7, 0.9, 0.5, -1.1]
    load = lambda k: up[k % 6] * F.col("f0" if k < 6 else "f3") + down[k % 6] * F.col("f1" if k < 6 else "f2")
    return df.select("id", *[(load(k) + 0.5 * gauss("id", 74 + k)).alias(f"T{k + 1}") for k in range(12)], gauss("id", 90).alias("N"))


@known("cluster members", [(1, "T1 T2 T3 T4 T5 T6"), (2, "T7 T8 T9 T10 T11 T12")])
def two_factor_clusters_planted(spark, sf):
    """Clusters with two common causes each, sextets tested by Spark tasks."""
    test = vanishing.DeltaTest(sufficient_stats(two_factors(spark, sf), [*(f"T{k}" for k in range(1, 13)), "N"]))
    found = vanishing.two_factor_clusters(spark, test, ALPHA)
    return spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(found, 1)], "cluster int, members string")


@known("cluster members", [(1, "M1 M2 M3 M4"), (2, "M5 M6 M7 M8")])
def pure_clusters_planted(spark, sf):
    """Clusters with one common cause each, beside an indicator of both causes and one that copies another with noise."""
    df = measured(spark, sf).withColumn("both", F.col("M2") + F.col("M6") + 0.5 * gauss("id", 91))
    test = vanishing.DeltaTest(sufficient_stats(df.drop("id")))
    found = vanishing.build_pure_clusters(spark, test, ALPHA)
    return spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(found, 1)], "cluster int, members string")


# hidden cells

NETWORK = "node given value p"


def with_holes(spark: SparkSession, sf: str) -> DataFrame:
    """The planted network A --> C, B --> C, C --> D with cells emptied by hashes: a tenth of A and D, a fifth of C."""
    df = discrete(spark, sf)
    hole = lambda c, k, p: F.when(coin("id", k, p) == 0, F.col(c)).alias(c)
    return df.select("id", hole("A", 101, 0.1), "B", hole("C", 102, 0.2), hole("D", 103, 0.1))


@known(
    NETWORK,
    [
        ("A", "", "0", 0.5), ("A", "", "1", 0.5), ("B", "", "0", 0.6), ("B", "", "1", 0.4),
        ("C", "A=0, B=0", "0", 0.9), ("C", "A=0, B=0", "1", 0.1), ("C", "A=0, B=1", "0", 0.45), ("C", "A=0, B=1", "1", 0.55),
        ("C", "A=1, B=0", "0", 0.55), ("C", "A=1, B=0", "1", 0.45), ("C", "A=1, B=1", "0", 0.1), ("C", "A=1, B=1", "1", 0.9),
        ("D", "C=0", "0", 0.85), ("D", "C=0", "1", 0.15), ("D", "C=1", "0", 0.15), ("D", "C=1", "1", 0.85),
    ],
)
def em_missing_planted(spark, sf):
    """Tables of the known graph from rows with missing cells, to the nearest twentieth."""
    net = missing.fit_tables(missing.counted_rows(with_holes(spark, sf), ["A", "B", "C", "D"]), DISCRETE_DAG)
    return net.to_df(spark).withColumn("p", F.round(F.round(20 * F.col("p")) / 20, 2))


@known("src dst ep_src ep_dst", [("A", "C", "-", ">"), ("B", "C", "-", ">"), ("C", "D", "-", ">")])
def structural_em_planted(spark, sf):
    """The pattern found from rows with missing cells."""
    net = missing.structural_em(missing.counted_rows(with_holes(spark, sf), ["A", "B", "C", "D"]))
    return cpdag(net.dag).to_df(spark)


@known("value p", [("0", 0.6), ("1", 0.4)])
def em_hidden_planted(spark, sf):
    """A hidden cause of four observed columns: how often it has each value, the more frequent one first (to tenths)."""
    df = rows_of(spark, sf).withColumn("h", coin("id", 104, 0.4))
    df = df.select("id", *[(coin("id", 105 + k, 0.85) == F.col("h")).cast("int").alias(f"Q{k}") for k in range(4)])
    dag = Graph.parse("H-->Q0,H-->Q1,H-->Q2,H-->Q3")
    net = missing.fit_tables(missing.counted_rows(df, dag.nodes, {"H": ["0", "1"]}), dag)
    shares = sorted((round(float(p), 1) for p in net.tables["H"]), reverse=True)
    return spark.createDataFrame([(str(k), p) for k, p in enumerate(shares)], "value string, p double")


# latent variables


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """id and twelve indicators, three each of four latents: K1 --> K3 <-- K2, K3 --> K4."""
    df = rows_of(spark, sf).withColumns({"K1": gauss("id", 111), "K2": gauss("id", 112)})
    df = df.withColumn("K3", 0.7 * F.col("K1") + 0.7 * F.col("K2") + 0.5 * gauss("id", 113)).withColumn("K4", 0.9 * F.col("K3") + 0.6 * gauss("id", 114))
    return df.select("id", *[((0.8 + 0.2 * j) * F.col(f"K{k}") + 0.5 * gauss("id", 115 + 3 * k + j)).alias(f"I{k}{j}") for k in range(1, 5) for j in range(3)])


INDICATORS = [[f"I{k}{j}" for j in range(3)] for k in range(1, 5)]


@known("src dst ep_src ep_dst", [("L1", "L3", "-", ">"), ("L2", "L3", "-", ">"), ("L3", "L4", "-", ">")])
def latent_structure_planted(spark, sf):
    """The pattern of four latents that are seen through three indicators each."""
    g, _ = latent.latent_structure(sufficient_stats(indicators(spark, sf).drop("id")), INDICATORS, alpha=1e-4)
    return g.subgraph({"L1", "L2", "L3", "L4"}).to_df(spark)


@known("src dst kind value", [
    ("K1", "K3", "coefficient", 0.7), ("K2", "K3", "coefficient", 0.7), ("K3", "K4", "coefficient", 0.9),
    ("I11", "I11", "error", 0.25), ("I32", "I32", "error", 0.25), ("K3", "K3", "error", 0.25), ("K4", "K4", "error", 0.35),
])
def latent_sem_planted(spark, sf):
    """Coefficients among latents and error variances, the second indicator of each with its true loading 1 (to the nearest twentieth)."""
    g = Graph.parse("Latent(K1)-->Latent(K3),Latent(K2)-->Latent(K3),Latent(K3)-->Latent(K4)")
    for k, names in enumerate(INDICATORS, 1):
        for v in names:
            g.add_edge(f"K{k}", v)
    fit = latent.fit_latent_sem(sufficient_stats(indicators(spark, sf).drop("id")), g, {(f"K{k}", f"I{k}1"): 1.0 for k in range(1, 5)})
    shown = {("K1", "K3"), ("K2", "K3"), ("K3", "K4"), ("I11", "I11"), ("I32", "I32"), ("K3", "K3"), ("K4", "K4")}
    rows = [(r["src"], r["dst"], r["kind"], round(round(20 * r["value"]) / 20, 2)) for r in fit.to_df(spark).collect() if (r["src"], r["dst"]) in shown]
    return spark.createDataFrame(rows, "src string, dst string, kind string, value double")


# interventions

FRONT_DOOR = "Latent(U)-->X,Latent(U)-->Y,X-->M,M-->Y"


def confounded(spark: SparkSession, sf: str) -> DataFrame:
    """id and X, M, Y of noughts and ones: a hidden U moves X and Y, and X moves Y through M."""
    df = rows_of(spark, sf).withColumn("U", coin("id", 131, 0.5))
    df = df.withColumn("X", (unit_hash("id", 13200) < 0.2 + 0.6 * F.col("U")).cast("int"))
    df = df.withColumn("M", (unit_hash("id", 13300) < 0.1 + 0.7 * F.col("X")).cast("int"))
    return df.withColumn("Y", (unit_hash("id", 13400) < 0.1 + 0.4 * F.col("M") + 0.4 * F.col("U")).cast("int")).drop("U")


@known("x y p", [(0, 0, 0.65), (0, 1, 0.35), (1, 0, 0.4), (1, 1, 0.6)])
def front_door_planted(spark, sf):
    """P(Y | do(X)) through the variable between, with X's and Y's cause unseen (to the nearest twentieth)."""
    df, g = confounded(spark, sf), Graph.parse(FRONT_DOOR)
    parts = [interventions.effect(df, g, ["Y"], {"X": x}).select(F.lit(x).alias("x"), F.col("Y").alias("y"), F.round(F.round(20 * F.col("p")) / 20, 2).alias("p")) for x in (0, 1)]
    return parts[0].unionByName(parts[1])


def back_door_lineitem(spark, sf):
    """P(l_linestatus | do(l_returnflag)) with l_linenumber as the cause of both."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linenumber", "l_returnflag", "l_linestatus")
    g = Graph.parse("l_linenumber-->l_returnflag,l_linenumber-->l_linestatus,l_returnflag-->l_linestatus")
    parts = [interventions.effect(df, g, ["l_linestatus"], {"l_returnflag": x}).select(F.lit(x).alias("returnflag"), "l_linestatus", F.round("p", 9).alias("p")) for x in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["back_door_lineitem"] = back_door_lineitem
ORACLES["back_door_lineitem"] = """
WITH n AS (SELECT l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
z AS (SELECT l_linenumber, sum(n) / (SELECT sum(n) FROM n) AS p FROM n GROUP BY l_linenumber),
y AS (SELECT *, n / sum(n) OVER (PARTITION BY l_linenumber, l_returnflag) AS p FROM n)
SELECT l_returnflag AS returnflag, l_linestatus, round(sum(z.p * y.p), 9) AS p FROM y JOIN z USING (l_linenumber) GROUP BY ALL
"""


# non-linear dependence over all rows

ASKED = [("a", "b", ()), ("a", "c", ()), ("a", "d", ()), ("a", "c", ("b",)), ("b", "c", ("a", "d"))]


def bent(spark: SparkSession, sf: str) -> DataFrame:
    """id and a, b, c, d: b follows the size of a, c a wave of b; d alone. No two are correlated much."""
    df = rows_of(spark, sf).withColumns({"a": gauss("id", 141), "d": gauss("id", 142)})
    df = df.withColumn("b", F.abs("a") + 0.4 * gauss("id", 143))
    return df.withColumn("c", F.sin(2 * F.col("b")) + 0.3 * gauss("id", 144)).select("id", "a", "b", "c", "d")


@known("test question independent", [
    (kind, q, free) for kind in ("kernel", "powers") for q, free in [("a b |", False), ("a c |", False), ("a d |", True), ("a c | b", True), ("b c | a d", False)]
])
def nonlinear_decisions(spark, sf):
    """Tests on all rows, all questions of a kind in two passes."""
    rows = []
    for kind, test in (("kernel", allrow.FeatureKernel), ("powers", allrow.ResidualPowers)):
        t = test(bent(spark, sf), ["a", "b", "c", "d"], ALPHA)
        t.prefetch(ASKED)
        rows += [(kind, f"{x} {y} | {' '.join(z)}".strip(), t.independent(x, y, z)) for x, y, z in ASKED]
    return spark.createDataFrame(rows, "test string, question string, independent boolean")


@known("src dst", [("a", "b"), ("b", "c")])
def nonlinear_skeleton(spark, sf):
    """A search with the kernel test."""
    test = allrow.FeatureKernel(bent(spark, sf), ["a", "b", "c", "d"], ALPHA)
    test.prefetch([(x, y, ()) for x, y in combinations(test.variables, 2)])
    return spark.createDataFrame(sorted(tuple(sorted(e[:2])) for e in pc(test).edges()), "src string, dst string")


# folds, rows left out, and pairs of halves


def _skeleton_at(alpha: float):
    return lambda s: skeleton(ind.FisherZ(s, alpha))[0]


@known("fold features error", [(k, "X3", 1.0) for k in range(5)])
def validated_features_planted(spark, sf):
    """What predicts X4 without each fold, and how well it does so on the fold (to the nearest tenth): X3 is X4's only cause, X5 is not offered."""
    parts = folds.fold_stats(linear(spark, sf), ["X1", "X2", "X3", "X4"], "id", 5)
    found = folds.validated_features(spark, parts, "X4", _skeleton_at(ALPHA))
    return found.select("fold", F.array_join("features", " ").alias("features"), F.round("error", 1).alias("error"))


def leave_one_out_customer(spark, sf):
    """The mean squared error of balances predicted from nations by the other customers."""
    df = spark.read.parquet(f"{sf}/customer.parquet")
    found = folds.leave_one_out(df, ["c_acctbal", "c_nationkey"], "c_acctbal", "c_custkey")
    return found.agg(F.count("*").alias("customers"), F.round(F.avg("loss") / 1000, 4).alias("loss"))


QUERIES["leave_one_out_customer"] = leave_one_out_customer
ORACLES["leave_one_out_customer"] = """
WITH c AS (SELECT CAST(c_acctbal AS DOUBLE) AS y, CAST(c_nationkey AS DOUBLE) AS x FROM customer),
m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM c)
SELECT count(*) AS customers, round(avg(power((y - my - b * (x - mx)) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx), 2)) / 1000, 4) AS loss FROM c, m
"""


@known("a b share kept", [("X1", "X3", 1.0, True), ("X2", "X3", 1.0, True), ("X2", "X5", 1.0, True), ("X3", "X4", 1.0, True), ("X4", "X5", 1.0, True)])
def stable_edges_planted(spark, sf):
    """Edges that are found in halves of complementary pairs, searched by Spark tasks."""
    return folds.stable_edges(linear(spark, sf), sorted(DAG.nodes), "id", _skeleton_at(ALPHA), 10)


# independent components


@known("src dst", [("X1", "X3"), ("X2", "X3"), ("X3", "X4"), ("X4", "X5"), ("X2", "X5")])
def lingam_all_rows(spark, sf):
    """Directions from non-normal errors, each round a pass over all rows."""
    g, _ = ica.lingam(ica.independent_components(linear(spark, sf, flat), DAG.nodes), 0.2)
    return spark.createDataFrame([e[:2] for e in g.edges()], "src string, dst string")


@known("model src dst effect", [(1, "P", "Q", 0.9), (1, "Q", "R", 0.8), (1, "R", "Q", -0.6), (1, "R", "S", 0.7)])
def ling_planted(spark, sf):
    """The stable model of a system in which Q and R cause each other (effects to the nearest tenth)."""
    df = rows_of(spark, sf).withColumns({"P": flat("id", 151), "eq": flat("id", 152), "er": flat("id", 153), "es": flat("id", 154)})
    df = df.withColumn("Q", (0.9 * F.col("P") + F.col("eq") - 0.6 * F.col("er")) / (1 + 0.6 * 0.8)).withColumn("R", 0.8 * F.col("Q") + F.col("er"))
    models = ica.ling(ica.independent_components(df.withColumn("S", 0.7 * F.col("R") + F.col("es")), ["P", "Q", "R", "S"]), 0.2)
    rows = [(k, a, b, round(w, 1)) for k, m in enumerate(models, 1) if m.stable for a, b, w in m.edges()]
    return spark.createDataFrame(rows, "model int, src string, dst string, effect double")


# count trees


def count_tree_lineitem(spark, sf):
    """Counts of each pair of discrete columns from one tree."""
    names = ["l_linenumber", "l_linestatus", "l_returnflag"]
    tree = CountTree(spark.read.parquet(f"{sf}/lineitem.parquet").select(*names), depth=2)
    rows = [(" ".join(pair), *values, n) for pair in combinations(names, 2) for values, n in tree.counts(pair).items()]
    return spark.createDataFrame(rows, "pair string, first string, second string, n long")


QUERIES["count_tree_lineitem"] = count_tree_lineitem
ORACLES["count_tree_lineitem"] = """
WITH l AS (SELECT CAST(l_linenumber AS VARCHAR) AS a, l_linestatus AS b, l_returnflag AS c FROM lineitem)
SELECT 'l_linenumber l_linestatus' AS pair, a AS first, b AS second, count(*) AS n FROM l GROUP BY ALL
UNION ALL SELECT 'l_linenumber l_returnflag', a, c, count(*) FROM l GROUP BY ALL
UNION ALL SELECT 'l_linestatus l_returnflag', b, c, count(*) FROM l GROUP BY ALL
"""


@known("src dst ep_src ep_dst", [("A", "C", "-", ">"), ("B", "C", "-", ">"), ("C", "D", "-", ">")])
def pc_count_tree(spark, sf):
    """A discrete search whose tests all take their counts from one tree."""
    tree = CountTree(discrete(spark, sf).select("A", "B", "C", "D"), alpha=ALPHA, depth=4)
    return pc(tree_test(ind.GSquare, tree)).to_df(spark)


# structural equations of any form


@known("node parameter value", [("Y", "a", 0.8), ("Y", "b", 0.5), ("Y", "s", 0.7), ("Z", "c", 2.0), ("Z", "k", 1.5), ("Z", "t", 0.3)])
def generalized_sem_planted(spark, sf):
    """Parameters of two curved equations, each fitted by aggregations over many parameter vectors (to the nearest tenth)."""
    df = rows_of(spark, sf).withColumns({"X": gauss("id", 161)})
    df = df.withColumn("Y", 0.8 * F.col("X") + 0.5 * F.col("X") ** 2 + 0.7 * gauss("id", 162))
    df = df.withColumn("Z", 2 / (1 + F.exp(-1.5 * F.col("Y"))) + 0.3 * gauss("id", 163)).select("X", "Y", "Z")
    system = [
        Equation("Y", "a * X + b * X^2", "Normal(0, s)", {"a": 0.1, "b": 0.1, "s": 1.0}),
        Equation("Z", "c * logistic(k * Y)", "Normal(0, t)", {"c": 1.0, "k": 1.0, "t": 1.0}),
    ]
    return fit_equations(df, system).to_df(spark).withColumn("value", F.round("value", 1))
