"""Queries over tables with a planted structure, whose results are known.

Each row of `orders` or `lineitem` gets columns that follow from hashes of its key by known
equations. So tables of any size hold the same structure, and a search, a test or a fitted
model has one right answer, which the SQL lists. Estimates are rounded to what the sampling
error of the smallest table allows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clusters, glm, interventions, kernel, lofs, mixed, models, scores, search, timeseries
from .operators import graph as gr
from .operators import graph_more as gm
from .operators import independence as ind
from .operators import more_search as ms
from .operators import transforms as tr
from .operators.graph import Graph
from .operators.knowledge import Knowledge
from .plans.suffstats import SuffStats, grouped_stats, sufficient_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAG = Graph.parse("X1-->X3,X2-->X3,X3-->X4,X4-->X5,X2-->X5")
LATENT_DAG = Graph.parse("Latent(L)-->Y1,Latent(L)-->Y2,Y3-->Y1,Y4-->Y2")
DISCRETE_DAG = Graph.parse("A-->C,B-->C,C-->D")
COEFFICIENTS = {("X1", "X3"): 0.8, ("X2", "X3"): 0.9, ("X3", "X4"): 0.8, ("X4", "X5"): 0.7, ("X2", "X5"): 0.8}
ALPHA = 1e-7


def known(columns: str, rows: list[tuple]):
    """Registers a query whose rows are known."""
    names = columns.split()
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BOOLEAN)" if isinstance(v, bool) else str(v)
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"SELECT {', '.join(names)} FROM (VALUES {values}) v({', '.join(names)})"
        return f

    return add


def edges_of(g: Graph) -> list[tuple]:
    return g.edges()


EDGE = "src dst ep_src ep_dst"


def same_table(spark: SparkSession, g: Graph) -> DataFrame:
    return g.to_df(spark)


# planted columns


def gauss(key: str, seed: int) -> Column:
    """Nearly normal with variance 1: the sum of six hashed numbers."""
    return reduce(lambda a, b: a + b, [tr.unit_hash(key, 100 * seed + k) for k in range(6)]) * (2**0.5) - 3 * 2**0.5


def flat(key: str, seed: int) -> Column:
    """Uniform with variance 1."""
    return (tr.unit_hash(key, 100 * seed) - 0.5) * 12**0.5


def coin(key: str, seed: int, p: float) -> Column:
    return (tr.unit_hash(key, 100 * seed) < p).cast("int")


def rows_of(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))


def linear(spark: SparkSession, sf: str, noise: Callable[[str, int], Column] = gauss) -> DataFrame:
    """id, X1 to X5 by DAG and COEFFICIENTS."""
    df = rows_of(spark, sf)
    for k, v in enumerate(DAG.topological_order()):
        df = df.withColumn(v, reduce(lambda a, b: a + b, [F.col(p) * COEFFICIENTS[p, v] for p in DAG.parents(v)], noise("id", int(v[1]))))
    return df


def with_latent(spark: SparkSession, sf: str) -> DataFrame:
    df = rows_of(spark, sf).withColumns({"L": gauss("id", 11), "Y3": gauss("id", 12), "Y4": gauss("id", 13)})
    return df.withColumns({"Y1": F.col("L") + 0.9 * F.col("Y3") + 0.7 * gauss("id", 14), "Y2": F.col("L") + 0.9 * F.col("Y4") + 0.7 * gauss("id", 15)}).drop("L")


def discrete(spark: SparkSession, sf: str) -> DataFrame:
    """id, A, B, C, D of noughts and ones: C is likely where A or B is one, D mostly equals C."""
    df = rows_of(spark, sf).withColumns({"A": coin("id", 21, 0.5), "B": coin("id", 22, 0.4)})
    u = tr.unit_hash("id", 2300)
    df = df.withColumn("C", (u < 0.1 + 0.35 * F.col("A") + 0.45 * F.col("B")).cast("int"))
    return df.withColumn("D", F.when(coin("id", 24, 0.85) == 1, F.col("C")).otherwise(1 - F.col("C")))


def mixed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """id, U, V, W continuous and G discrete: U - V, V - G; W alone."""
    df = rows_of(spark, sf).withColumns({"U": gauss("id", 31), "W": gauss("id", 33)})
    df = df.withColumn("V", 0.8 * F.col("U") + gauss("id", 32))
    return df.withColumn("G", F.when(F.col("V") + 0.5 * gauss("id", 34) > 0, "hi").otherwise("lo"))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """id and eight indicators of two correlated factors, four each."""
    df = rows_of(spark, sf).withColumn("f", gauss("id", 41)).withColumn("g", 0.5 * F.col("f") + gauss("id", 42))
    return df.select("id", *[((0.7 + 0.1 * k) * F.col("f" if k < 4 else "g") + 0.6 * gauss("id", 43 + k)).alias(f"M{k + 1}") for k in range(8)])


def series(spark: SparkSession, sf: str) -> DataFrame:
    """s (series), t (step), x and y: y follows x one step later. Six steps, a series for each order."""
    rows = rows_of(spark, sf).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("t"))
    now = F.col("s") * 10 + F.col("t")
    return rows.withColumns({"now": now, "before": now - 1}).withColumns({"x": gauss("now", 51), "y": 0.8 * gauss("before", 51) + 0.6 * gauss("now", 52)}).select("s", "t", "x", "y")


def stats(spark: SparkSession, sf: str):
    return sufficient_stats(linear(spark, sf), DAG.nodes)


PATTERN = gr.cpdag(DAG)
PAG = search.dag_to_pag(LATENT_DAG)


# searches


@known(EDGE, edges_of(PATTERN))
def pc_lineitem(spark, sf):
    return same_table(spark, search.pc(ind.FisherZ(stats(spark, sf), ALPHA)))


@known(EDGE, edges_of(PATTERN))
def cpc_planted(spark, sf):
    return same_table(spark, search.cpc(ind.FisherZ(stats(spark, sf), ALPHA)))


@known(EDGE, edges_of(PATTERN))
def pc_max_planted(spark, sf):
    return same_table(spark, search.pc_max(ind.FisherZ(stats(spark, sf), ALPHA)))


@known(EDGE, edges_of(PATTERN))
def pc_unstable_planted(spark, sf):
    return same_table(spark, search.pc(ind.FisherZ(stats(spark, sf), ALPHA), stable=False))


def _skeleton(g: Graph) -> list[tuple]:
    return [(min(a, b), max(a, b), "-", "-") for a, b, _, _ in g.edges()]


@known(EDGE, _skeleton(PATTERN))
def skeleton_fan_out_planted(spark, sf):
    """The tests of each depth as tasks."""
    g = search.skeleton_fan_out(spark, stats(spark, sf), ALPHA)[0]
    return spark.createDataFrame(_skeleton(g), "src string, dst string, ep_src string, ep_dst string")


@known(EDGE, edges_of(PATTERN))
def fges_lineitem(spark, sf):
    return same_table(spark, search.fges(scores.SemBic(stats(spark, sf), 4.0)))


@known(EDGE, edges_of(PATTERN))
def images_planted(spark, sf):
    """One pattern for three data sets."""
    parts = grouped_stats(linear(spark, sf).withColumn("part", F.pmod("id", F.lit(3))), "part", DAG.nodes)
    return same_table(spark, search.fges(scores.Images([scores.SemBic(s, 4.0) for s in parts.values()])))


@known(EDGE, edges_of(DAG))
def pc_tiers(spark, sf):
    """Background knowledge in tiers orients what the pattern leaves open."""
    k = Knowledge(tiers=[[v] for v in DAG.topological_order()])
    return same_table(spark, search.pc(ind.FisherZ(stats(spark, sf), ALPHA), knowledge=k))


@known(EDGE, edges_of(gr.cpdag(DISCRETE_DAG)))
def pc_discrete(spark, sf):
    return same_table(spark, search.pc(ind.GSquare(discrete(spark, sf), DISCRETE_DAG.nodes, ALPHA)))


@known(EDGE, edges_of(gr.cpdag(DISCRETE_DAG)))
def fges_bdeu(spark, sf):
    return same_table(spark, search.fges(scores.BDeu(discrete(spark, sf), DISCRETE_DAG.nodes, 10.0, 1.0)))


@known(EDGE, edges_of(gr.cpdag(DISCRETE_DAG)))
def fges_discrete_bic(spark, sf):
    return same_table(spark, search.fges(scores.DiscreteBic(discrete(spark, sf), DISCRETE_DAG.nodes, 2.0)))


@known(EDGE, edges_of(search.dag_to_pag(DISCRETE_DAG)))
def fci_discrete(spark, sf):
    return same_table(spark, search.fci(ind.ChiSquare(discrete(spark, sf), DISCRETE_DAG.nodes, ALPHA)))


def _latent_test(spark, sf):
    return ind.FisherZ(sufficient_stats(with_latent(spark, sf), ["Y1", "Y2", "Y3", "Y4"]), ALPHA)


@known(EDGE, edges_of(PAG))
def fci_latent(spark, sf):
    return same_table(spark, search.fci(_latent_test(spark, sf)))


@known(EDGE, edges_of(PAG))
def rfci_latent(spark, sf):
    return same_table(spark, search.rfci(_latent_test(spark, sf)))


@known(EDGE, edges_of(PAG))
def cfci_latent(spark, sf):
    return same_table(spark, search.cfci(_latent_test(spark, sf)))


@known(EDGE, edges_of(PAG))
def fci_max_latent(spark, sf):
    return same_table(spark, search.fci_max(_latent_test(spark, sf)))


@known(EDGE, edges_of(PAG))
def gfci_latent(spark, sf):
    test = _latent_test(spark, sf)
    return same_table(spark, search.gfci(test, scores.SemBic(test.stats, 4.0)))


@known("target member", [("X3", v) for v in sorted(DAG.markov_blanket("X3"))])
def iamb_planted(spark, sf):
    found = search.iamb(ind.FisherZ(stats(spark, sf), ALPHA), "X3")
    return spark.createDataFrame([("X3", v) for v in sorted(found)], "target string, member string")


@known("target member", [("X2", v) for v in sorted(DAG.markov_blanket("X2"))])
def grow_shrink_planted(spark, sf):
    found = search.grow_shrink(ind.FisherZ(stats(spark, sf), ALPHA), "X2")
    return spark.createDataFrame([("X2", v) for v in sorted(found)], "target string, member string")


@known("target member", [("X3", v) for v in sorted(DAG.markov_blanket("X3"))])
def blanket_from_pattern(spark, sf):
    found = search.mb_from_pattern(ind.FisherZ(stats(spark, sf), ALPHA), "X3")
    return spark.createDataFrame([("X3", v) for v in sorted(found)], "target string, member string")


@known(EDGE, [("U", "V", "-", "-"), ("V", "G", "-", "-")])
def mgm_lineitem(spark, sf):
    """Edges of a mixed graphical model: continuous with continuous, and with discrete."""
    return same_table(spark, mixed.mgm(mixed_rows(spark, sf), ["U", "V", "W"], ["G"], (0.15, 0.15, 0.15)).graph())


@known("src dst frequency", [(min(a, b), max(a, b), 1.0) for a, b, _, _ in PATTERN.edges()])
def bootstrap_edges(spark, sf):
    """Edges that all weighted bootstrap replicates have."""
    return mixed.bootstrap_frequencies(linear(spark, sf), DAG.nodes, 20, 7, "id", ALPHA)


@known("alpha", [(1e-7,)])
def stars_planted(spark, sf):
    """The largest level whose skeleton is stable under subsampling."""
    return spark.createDataFrame([(mixed.stars(linear(spark, sf), DAG.nodes, [0.5, 1e-7], "id", 12, 0.01, 3),)], "alpha double")


@known("src dst", [e[:2] for e in _skeleton(PATTERN)])
def skeleton_fdr_planted(spark, sf):
    """Edges by a bound on the share of wrong ones."""
    g = lofs.skeleton_fdr(ind.FisherZ(stats(spark, sf), 1e-4), -1, 1e-6)
    return spark.createDataFrame([e[:2] for e in _skeleton(g)], "src string, dst string")


@known(EDGE, [(a, b, "-", "-") for a, b, _, _ in DAG.moral().edges()])
def precision_edges_planted(spark, sf):
    """Pairs with a partial correlation given all others: the moral graph."""
    return same_table(spark, ind.precision_edges(stats(spark, sf), 0.1))


@known(EDGE, edges_of(PATTERN))
def pooled_planted(spark, sf):
    """Data sets' p-values pooled for each test of a search."""
    parts = grouped_stats(linear(spark, sf).withColumn("part", F.pmod("id", F.lit(2))), "part", DAG.nodes)
    return same_table(spark, search.pc(ind.Pooled([ind.FisherZ(s) for s in parts.values()], "fisher", ALPHA)))


@known("src dst", [e[:2] for e in edges_of(DAG)])
def lingam_planted(spark, sf):
    """Directions from non-normal noise, on a bounded sample of rows as the method takes a matrix."""
    x = kernel.sample_rows(linear(spark, sf, flat), DAG.nodes, "id", 4000)
    g, _ = search.lingam(x, DAG.nodes, 0.2, 1)
    return spark.createDataFrame([e[:2] for e in g.edges()], "src string, dst string")


@known("src dst", [e[:2] for e in edges_of(DAG)])
def skew_orientation(spark, sf):
    """A skeleton oriented pair by pair by the robust skew of skewed noise."""
    skewed = lambda key, k: -F.log(1 - 0.999 * tr.unit_hash(key, 100 * k)) - 1
    df = linear(spark, sf, skewed)
    pattern = Graph(DAG.nodes)
    for a, b, _, _ in DAG.edges():
        pattern.add_edge(a, b, "-", "-")
    return spark.createDataFrame([e[:2] for e in lofs.orient(pattern, df, "rskew").edges()], "src string, dst string")


# tests: the same four questions


QUESTIONS = [("X1", "X2", ()), ("X1", "X3", ()), ("X1", "X4", ("X3",)), ("X2", "X5", ("X4",))]


def _decisions(spark, name: str, test, questions) -> list[tuple]:
    return [(name, x, y, ",".join(z), bool(test.independent(x, y, z))) for x, y, z in questions]


_TESTS = ["correlation_t", "cramer_t", "fisher_z", "generalized_inverse", "partial_correlation", "regression", "score"]


def _separated(test: str, x: str, y: str, z: tuple) -> bool:
    return DAG.d_separated(x, y, [v for v in DAG.nodes if v not in (x, y)] if test == "partial_correlation" else z)  # that one is given all others


@known("test x y given independent", [(t, x, y, ",".join(z), bool(_separated(t, x, y, z))) for t in _TESTS for x, y, z in QUESTIONS])
def gaussian_decisions(spark, sf):
    s = stats(spark, sf)
    tests = {
        "fisher_z": ind.FisherZ(s, ALPHA), "correlation_t": ind.CorrelationT(s, ALPHA), "cramer_t": ind.CramerT(s, ALPHA), "partial_correlation": ind.PartialCorrelation(s, ALPHA),
        "generalized_inverse": ind.GeneralizedInverse(s, ALPHA), "regression": ind.Regression(s, ALPHA), "score": ind.ScoreTest(scores.SemBic(s, 4.0)),
    }
    return spark.createDataFrame([r for n, t in tests.items() for r in _decisions(spark, n, t, QUESTIONS)], "test string, x string, y string, given string, independent boolean")


_DISCRETE_QUESTIONS = [("A", "B", ()), ("A", "C", ()), ("A", "D", ("C",)), ("A", "B", ("C",))]
_DISCRETE_TESTS = ["bayesian", "chi_square", "g_square", "score"]


@known("test x y given independent", [(t, x, y, ",".join(z), DISCRETE_DAG.d_separated(x, y, z)) for t in _DISCRETE_TESTS for x, y, z in _DISCRETE_QUESTIONS])
def discrete_decisions(spark, sf):
    df, names = discrete(spark, sf), DISCRETE_DAG.nodes
    tests = {
        "chi_square": ind.ChiSquare(df, names, ALPHA), "g_square": ind.GSquare(df, names, ALPHA), "bayesian": glm.BayesianConstraint(df, names), "score": ind.ScoreTest(scores.BDeu(df, names, 10.0, 1.0)),
    }
    return spark.createDataFrame([r for n, t in tests.items() for r in _decisions(spark, n, t, _DISCRETE_QUESTIONS)], "test string, x string, y string, given string, independent boolean")


_MIXED = [("U", "W", (), True), ("U", "V", (), False), ("V", "G", (), False), ("U", "G", ("V",), True)]


@known("test x y given independent", [(t, x, y, ",".join(z), v) for t in ("conditional_gaussian", "mixed_regression") for x, y, z, v in _MIXED])
def mixed_decisions(spark, sf):
    df = mixed_rows(spark, sf)
    tests = {"mixed_regression": glm.MixedRegression(df, ["G"], ["U", "V", "W"], ALPHA), "conditional_gaussian": ind.LikelihoodRatio(scores.ConditionalGaussian(df, ["G"], ["U", "V", "W"]), 1e-30)}
    asked = {n: [q[:3] for q in _MIXED] for n in tests}
    return spark.createDataFrame([r for n, t in tests.items() for r in _decisions(spark, n, t, asked[n])], "test string, x string, y string, given string, independent boolean")


@known("test x y given independent", [(t, x, y, ",".join(z), v) for t, qs in (("hsic", [("p", "q", (), False), ("p", "r", (), True)]), ("kernel_ci", [("p", "q", (), False), ("p", "r", (), True), ("q", "s", ("p",), True)])) for x, y, z, v in qs])
def kernel_decisions(spark, sf):
    """Dependence without correlation: q is the square of p with noise, s another noisy copy of p; by the sample of rows that kernel tests use."""
    df = rows_of(spark, sf).withColumns({"p": gauss("id", 61), "r": gauss("id", 63)})
    df = df.withColumns({"q": F.col("p") * F.col("p") + 0.3 * gauss("id", 62), "s": F.col("p") + 0.3 * gauss("id", 64)})
    x = kernel.sample_rows(df, ["p", "q", "r", "s"], "id", 300)
    out = [("hsic", a, b, "", bool(kernel.hsic_p_value(x[:, [i]], x[:, [j]]) > 0.001)) for a, b, i, j in (("p", "q", 0, 1), ("p", "r", 0, 2))]
    kci = kernel.Kci(x, ["p", "q", "r", "s"], 0.001)
    out += _decisions(spark, "kernel_ci", kci, [("p", "q", ()), ("p", "r", ()), ("q", "s", ("p",))])
    return spark.createDataFrame(out, "test string, x string, y string, given string, independent boolean")


@known("method independent_xz independent_xy", [(m, True, False) for m in ("average", "fdr", "fisher", "majority", "mudholkergeorge", "percent", "stouffer", "tippett", "worsleyfriston")])
def pooled_decisions(spark, sf):
    """Every way to pool the p-values of four data sets."""
    parts = grouped_stats(linear(spark, sf).withColumn("part", F.pmod("id", F.lit(4))), "part", DAG.nodes)
    tests = [ind.FisherZ(s, 1e-4) for s in parts.values()]
    out = []
    for m in ("average", "fdr", "fisher", "majority", "mudholkergeorge", "percent", "stouffer", "tippett", "worsleyfriston"):
        p = ind.Pooled(tests, m, 1e-4)
        out.append((m, bool(p.independent("X1", "X4", ("X3",))), bool(p.independent("X1", "X3"))))
    return spark.createDataFrame(out, "method string, independent_xz boolean, independent_xy boolean")


@known("rank_all rank_one", [(1, 1)])
def canonical_rank_planted(spark, sf):
    """Four indicators of one factor and four of another share one dimension; so do one and four."""
    s = sufficient_stats(measured(spark, sf), [f"M{k}" for k in range(1, 9)])
    a, b = [f"M{k}" for k in range(1, 5)], [f"M{k}" for k in range(5, 9)]
    return spark.createDataFrame([(ind.canonical_rank(s, a, b, ALPHA), ind.canonical_rank(s, a[:1], b, ALPHA))], "rank_all int, rank_one int")


# scores: adding a true parent helps, adding a stranger does not


@known("score true_parent stranger", [(n, True, False) for n in ("bde", "bdeu", "conditional_gaussian", "discrete_bic", "images", "sem_bic")])
def score_preferences(spark, sf):
    s, df = stats(spark, sf), discrete(spark, sf)
    wide = linear(spark, sf).select("id", "X1", "X2", "X3").withColumn("H", F.when(F.col("X3") > 0, "a").otherwise("b"))
    sem = scores.SemBic(s, 2.0)
    cont = {"sem_bic": sem, "images": scores.Images([sem, scores.SemBic(s, 2.0)])}
    names = DISCRETE_DAG.nodes
    disc = {"discrete_bic": scores.DiscreteBic(df, names, 2.0), "bdeu": scores.BDeu(df, names, 10.0, 1.0), "bde": scores.BDe(df, names)}
    gain = lambda x, y, a: x.local(y, [a]) - x.local(y, []) > 0
    out = [(n, gain(x, "X3", "X1"), gain(x, "X2", "X1")) for n, x in cont.items()] + [(n, gain(x, "C", "A"), gain(x, "B", "A")) for n, x in disc.items()]
    cg = scores.ConditionalGaussian(wide, ["H"], ["X1", "X2", "X3"], 2.0)
    out.append(("conditional_gaussian", gain(cg, "H", "X1"), gain(cg, "X2", "X1")))
    return spark.createDataFrame([(n, bool(a), bool(b)) for n, a, b in out], "score string, true_parent boolean, stranger boolean")


# models


@known("src dst coefficient", [(a, b, c) for (a, b), c in sorted(COEFFICIENTS.items())])
def sem_fit_planted(spark, sf):
    fit = models.fit_sem(stats(spark, sf), DAG)
    return spark.createDataFrame([(a, b, round(c * 10) / 10) for (a, b), c in sorted(fit.edges.items())], "src string, dst string, coefficient double")


@known("accepted degrees", [(True, 5)])
def sem_test_planted(spark, sf):
    """The chi-square test does not reject the planted graph."""
    fit = models.fit_sem(stats(spark, sf), DAG)
    return spark.createDataFrame([(bool(fit.p > 1e-6), int(fit.df))], "accepted boolean, degrees int")


@known("src dst effect", [("X1", "X5", 0.45), ("X2", "X5", 1.3)])
def total_effects_planted(spark, sf):
    fit = models.fit_sem(stats(spark, sf), DAG)
    return spark.createDataFrame([(a, "X5", round(models.total_effect(fit, a, "X5") * 20) / 20) for a in ("X1", "X2")], "src string, dst string, effect double")


@known("cause effect value", [("X3", "X5", 0.55), ("X4", "X5", 0.7)])
def ida_planted(spark, sf):
    """Possible effects from the pattern; here there is one for each pair."""
    s = stats(spark, sf)
    out = [(x, "X5", round(v * 20) / 20) for x in ("X3", "X4") for v in models.ida(s, PATTERN, x, "X5")]
    return spark.createDataFrame(out, "cause string, effect string, value double")


@known("var coefficient", [("a", 1.5), ("b", -1.0), ("const", 0.5)])
def logistic_planted(spark, sf):
    df = rows_of(spark, sf).withColumns({"a": gauss("id", 71), "b": gauss("id", 72)})
    p = 1 / (1 + F.exp(-(0.5 + 1.5 * F.col("a") - F.col("b"))))
    fit = models.logistic(df.withColumn("y", (tr.unit_hash("id", 7300) < p).cast("int")), "y", ["a", "b"])
    return spark.createDataFrame([(v, round(float(c) * 4) / 4) for v, c in zip(fit.names, fit.coef, strict=True)], "var string, coefficient double")


@known("A B C p", [(a, a, c, q if c else round(1 - q, 1)) for a, q in ((0, 0.1), (1, 0.9)) for c in (0, 1)])
def cpt_planted(spark, sf):
    """Conditional probabilities with a Dirichlet prior; those of 0.45 and 0.55, which would round either way, are left out."""
    t = models.cpt(discrete(spark, sf), "C", ["A", "B"], 1.0)
    return t.where("A = B").select("A", "B", "C", F.round("p", 1).alias("p"))


@known("C p", [(0, 0.0), (1, 1.0)])
def bayes_net_query(spark, sf):
    """The more likely value of C given A and B, by variable elimination."""
    net = models.BayesNet.fit(discrete(spark, sf), DISCRETE_DAG, 1.0)
    return net.marginal(["C"], {"A": 1, "B": 1}).select("C", F.round("p").alias("p"))


@known("cluster member", [("1", f"M{k}") for k in range(1, 5)] + [("2", f"M{k}") for k in range(5, 9)])
def one_factor_clusters_planted(spark, sf):
    found = clusters.one_factor_clusters(sufficient_stats(measured(spark, sf), [f"M{k}" for k in range(1, 9)]), 1e-5)
    rows = [(str(k + 1), v) for k, c in enumerate(sorted(map(sorted, found))) for v in c]
    return spark.createDataFrame(rows, "cluster string, member string")


@known("var factor", [(f"M{k}", 1 if k < 5 else 2) for k in range(1, 9)])
def factor_rotation(spark, sf):
    """Each indicator's larger loading after rotation; factors are numbered by their first indicator."""
    names = [f"M{k}" for k in range(1, 9)]
    load = np.abs(clusters.varimax(clusters.principal_factors(sufficient_stats(measured(spark, sf), names), 2)))
    own = load.argmax(axis=1)
    number = {f: k + 1 for k, f in enumerate(dict.fromkeys(own.tolist()))}
    return spark.createDataFrame([(v, number[int(f)]) for v, f in zip(names, own, strict=True)], "var string, factor int")


@known("cluster rows_near", [(0, True), (1, True)])
def kmeans_planted(spark, sf):
    """Two groups far apart are found from poor starting centres."""
    df = rows_of(spark, sf).withColumn("g", coin("id", 81, 0.3)).withColumns({"x": gauss("id", 82) + 10 * F.col("g"), "y": gauss("id", 83) - 10 * F.col("g")})
    centres, out = models.kmeans(df, ["x", "y"], [[-1.0, 0.0], [1.0, -1.0]])
    return out.groupBy("cluster").agg((F.max("distance2") < 60).alias("rows_near"))


@known("src dst", [("x", "y")])
def granger_planted(spark, sf):
    df = series(spark, sf)
    out = [(a, b) for a, b in (("x", "y"), ("y", "x")) if timeseries.granger(_steps(df), a, b, "step", 1) < 1e-9]
    return spark.createDataFrame(out, "src string, dst string")


def _steps(df: DataFrame) -> DataFrame:
    """One long series in place of many: pairs of neighbouring steps only."""
    return df.withColumn("step", F.col("s") * 10 + F.col("t"))


@known("target source lag coefficient", [("x", "x", 1, 0.0), ("x", "y", 1, 0.0), ("y", "x", 1, 0.8), ("y", "y", 1, 0.0)])
def var_planted(spark, sf):
    """A vector autoregression pooled over many short series."""
    names = ["x", "y"]
    coef, _ = timeseries.var_model(series(spark, sf), names, "t", 1, ["s"])
    rows = [(a, b, k + 1, abs(round(float(m[i, j]) * 10) / 10)) for k, m in enumerate(coef) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "target string, source string, lag int, coefficient double")


@known("src dst", [("x:1", "y")])
def ts_search_planted(spark, sf):
    g = timeseries.ts_search(series(spark, sf), ["x", "y"], "t", 1, "pc", ALPHA, ["s"])
    return spark.createDataFrame([e[:2] for e in g.edges()], "src string, dst string")


# graphs: measures of a search's result against the planted graph, and algebra on it


@known("measure value", [("adjacency_precision", 1.0), ("adjacency_recall", 1.0), ("arrow_recall", 1.0), ("shd", 0.0)])
def recovery_planted(spark, sf):
    est = search.pc(ind.FisherZ(stats(spark, sf), ALPHA))
    adj, arrows = gr.adjacency_confusion(est, PATTERN), gr.arrow_confusion(est, PATTERN)
    rows = [
        ("adjacency_precision", adj["tp"] / (adj["tp"] + adj["fp"])), ("adjacency_recall", adj["tp"] / (adj["tp"] + adj["fn"])),
        ("arrow_recall", arrows["tp"] / (arrows["tp"] + arrows["fn"])), ("shd", float(gr.shd(est, PATTERN))),
    ]
    return spark.createDataFrame(rows, "measure string, value double")


def _found(spark, sf) -> Graph:
    """A graph with the pattern that the data show."""
    return gr.dag_from_pattern(search.pc(ind.FisherZ(stats(spark, sf), ALPHA)))


@known("node ancestor", sorted((v, a) for v in DAG.nodes for a in DAG.ancestors([v]) if a != v))
def graph_ancestors(spark, sf):
    g = _found(spark, sf)
    return spark.createDataFrame(sorted((v, a) for v in g.nodes for a in g.ancestors([v]) if a != v), "node string, ancestor string")


@known("node descendant", sorted((v, a) for v in DAG.nodes for a in DAG.descendants([v]) if a != v))
def graph_descendants(spark, sf):
    g = _found(spark, sf)
    return spark.createDataFrame(sorted((v, a) for v in g.nodes for a in g.descendants([v]) if a != v), "node string, descendant string")


_TRIPLES = [(x, y, z) for i, x in enumerate(DAG.nodes) for y in DAG.nodes[i + 1 :] for z in ["", *DAG.nodes] if z not in (x, y)]


@known("x y given separated", [(x, y, z, bool(DAG.d_separated(x, y, [z] if z else []))) for x, y, z in _TRIPLES])
def d_separation_planted(spark, sf):
    """Separations of the found graph; the expected ones are those of the planted graph."""
    g = _found(spark, sf)
    return spark.createDataFrame([(x, y, z, bool(g.d_separated(x, y, [z] if z else []))) for x, y, z in _TRIPLES], "x string, y string, given string, separated boolean")


@known("path", [("X1-->X3-->X4-->X5",)])
def graph_paths(spark, sf):
    return spark.createDataFrame([("-->".join(p),) for p in gm.directed_paths(_found(spark, sf), "X1", "X5")], "path string")


@known("format equal", [(n, True) for n in ("json", "matrix", "text")])
def graph_round_trips(spark, sf):
    """Text and JSON forms read back give the same graph; the matrix has an entry for each edge."""
    g = _found(spark, sf)
    m = gr.to_matrix(g)
    rows = [("json", gr.from_json(gr.to_json(g)) == g), ("text", gr.from_text(gr.to_text(g)) == g), ("matrix", sum(map(any, m)) > 0 and len(m) == len(g.nodes))]
    return spark.createDataFrame([(n, bool(v)) for n, v in rows], "format string, equal boolean")


@known("node", [(v,) for v in DAG.topological_order()])
def graph_order(spark, sf):
    return spark.createDataFrame([(v,) for v in _found(spark, sf).topological_order()], "node string")


# blankets by subsets, hybrid and penalised searches, graphs with bidirected edges


@known("method target member", [(m, v, u) for m in ("inter_iamb", "max_min", "interleaved") for v in ("X2", "X3") for u in sorted(DAG.markov_blanket(v))])
def blankets_planted(spark, sf):
    test = ind.FisherZ(stats(spark, sf), ALPHA)
    found = {"inter_iamb": ms.inter_iamb, "max_min": ms.blanket_by_subsets, "interleaved": lambda t, v: ms.blanket_by_subsets(t, v, greedy=False)}
    return spark.createDataFrame([(m, v, u) for m, f in found.items() for v in ("X2", "X3") for u in f(test, v)], "method string, target string, member string")


@known("target member", sorted((v, u) for v in DAG.nodes for u in DAG.adj(v)))
def parents_and_children_planted(spark, sf):
    test = ind.FisherZ(stats(spark, sf), ALPHA)
    return spark.createDataFrame(sorted((v, u) for v in DAG.nodes for u in ms.parents_and_children(test, v)), "target string, member string")


@known("src dst", [e[:2] for e in _skeleton(PATTERN)])
def max_min_hill_climb_planted(spark, sf):
    """Adjacencies; directions of a hill climb may be those of a local optimum."""
    s = stats(spark, sf)
    g = ms.max_min_hill_climb(ind.FisherZ(s, ALPHA), scores.SemBic(s, 2.0))
    return spark.createDataFrame([e[:2] for e in _skeleton(g)], "src string, dst string")


@known("not_worse acyclic", [(True, True)])
def hill_climb_planted(spark, sf):
    """A hill climb among all pairs ends no lower than where it could end, with the empty graph as its start."""
    s = stats(spark, sf)
    score = scores.SemBic(s, 2.0)
    g = ms.hill_climb(score, {frozenset((a, b)) for i, a in enumerate(DAG.nodes) for b in DAG.nodes[i + 1 :]})
    gain = score.graph(g) - score.graph(Graph(DAG.nodes))
    return spark.createDataFrame([(bool(gain > 0.9 * (score.graph(DAG) - score.graph(Graph(DAG.nodes)))), not g.has_directed_cycle())], "not_worse boolean, acyclic boolean")


@known("src dst", [e[:2] for e in _skeleton(DAG.moral())])
def graphical_lasso_planted(spark, sf):
    """The entries of a lightly penalised precision matrix are those of the moral graph."""
    inverse, g = ms.graphical_lasso(stats(spark, sf), 0.002)
    at = {v: k for k, v in enumerate(DAG.nodes)}
    return spark.createDataFrame([(a, b) for a, b, _, _ in _skeleton(g) if abs(inverse[at[a], at[b]]) > 0.1], "src string, dst string")


def _bidirected() -> Graph:
    g = Graph(["Y1", "Y2", "Y3", "Y4"])
    g.add_edge("Y3", "Y1")
    g.add_edge("Y4", "Y2")
    g.add_edge("Y1", "Y2", ">", ">")
    return g


@known("src dst kind value", [("Y3", "Y1", "coefficient", 0.9), ("Y4", "Y2", "coefficient", 0.9), ("Y1", "Y2", "error", 1.0)])
def bidirected_fit_planted(spark, sf):
    """A graph with a bidirected edge for the hidden cause."""
    edges, errors, _ = ms.fit_mixed_graph(sufficient_stats(with_latent(spark, sf), ["Y1", "Y2", "Y3", "Y4"]), _bidirected())
    rows = [(a, b, "coefficient", round(c, 1)) for (a, b), c in edges.items()] + [(a, b, "error", round(c, 1)) for (a, b), c in errors.items() if a != b]
    return spark.createDataFrame(rows, "src string, dst string, kind string, value double")


@known("method coefficient", [("instrument", 0.5), ("least_squares", 0.8)])
def instruments_planted(spark, sf):
    """A cause that shares an error with its effect: the instrument gives 0.5, least squares is misled."""
    df = rows_of(spark, sf).withColumns({"u": gauss("id", 91), "z": 1.5 * gauss("id", 92)})
    df = df.withColumn("x", F.col("z") + F.col("u") + 0.5 * gauss("id", 93)).withColumn("y", 0.5 * F.col("x") + 1.05 * F.col("u") + 0.5 * gauss("id", 94))
    s = sufficient_stats(df, ["y", "x", "z"])
    rows = [("instrument", round(ms.two_stage_least_squares(s, "y", ["x"], ["z"])["x"], 1)), ("least_squares", round(float(s.regress("y", ["x"])[0][0]), 1))]
    return spark.createDataFrame(rows, "method string, coefficient double")


@known("var mean variance", [("X1", 0.0, 1.0), ("X2", 0.0, 1.0), ("X4", 1.6, 1.0), ("X5", 1.1, 2.1)])
def updated_means(spark, sf):
    """Distributions of a Gaussian model after X3 is set to 2, its causes cut off (rounded to tenths)."""
    cut = interventions.manipulated(models.fit_sem(stats(spark, sf), DAG), {"X3": 2.0})
    rows = [(v, abs(round(m, 1)), round(x, 1)) for v, m, x in sorted(zip(cut.names, map(float, cut.means), map(float, np.diag(cut.cov)), strict=True)) if v != "X3"]
    return spark.createDataFrame(rows, "var string, mean double, variance double")


@known("var normal", [("bell", True), ("flat", False), ("skewed", False)])
def normality_planted(spark, sf):
    """The Anderson-Darling test of three columns."""
    u, v = F.greatest(tr.unit_hash("id", 9501), F.lit(2.0**-53)), tr.unit_hash("id", 9502)
    df = rows_of(spark, sf).withColumns({"bell": F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v), "flat": flat("id", 96), "skewed": F.exp(0.5 * gauss("id", 97))})
    return spark.createDataFrame([(c, bool(kernel.anderson_darling_normal(df, c)[1] > 1e-4)) for c in ("bell", "flat", "skewed")], "var string, normal boolean")


@known("src dst weight", [("X1", "X3", 1.0), ("X2", "X3", 1.0), ("X2", "X5", 1.0), ("X3", "X4", 1.0), ("X4", "X5", 1.0)])
def subsample_frequencies(spark, sf):
    """How often edges are in skeletons of half samples, drawn by hashes of row ids."""
    parts = mixed.bootstrap_stats(linear(spark, sf), DAG.nodes, 10, 5, "id", 0.5)
    f = mixed.edge_frequencies(parts, ALPHA)
    return spark.createDataFrame([(min(a, b), max(a, b), round(v, 6)) for (a, b), v in sorted(f.items())], "src string, dst string, weight double")


@known("pair halves together", [(0, 2, True), (1, 2, True), (2, 2, True)])
def complementary_halves_planted(spark, sf):
    """Each pair of halves holds every row once, in halves that differ by one row at most."""
    n = rows_of(spark, sf).count()
    halves = tr.complementary_halves(rows_of(spark, sf), 3, 4, "id").groupBy("pair", "half").agg(F.count("*").alias("n"))
    return halves.groupBy("pair").agg(F.count("*").cast("int").alias("halves"), ((F.sum("n") == n) & (F.max("n") - F.min("n") <= 1)).alias("together"))


@known("var", [("X1",), ("X2",)])
def diverse_variables(spark, sf):
    """The two most relevant variables for X3 that do not repeat each other; a noisy copy of X2 is put off."""
    df = linear(spark, sf).withColumn("C", F.col("X2") + 0.3 * gauss("id", 98)).select("X1", "X2", "X3", "C")
    s = sufficient_stats(df, ["X1", "X2", "X3", "C"])
    relevance = {c: abs(float(s.corr[s.index["X3"], s.index[c]])) for c in ("X1", "X2", "C")}
    found = mixed.preferential_diversity(relevance, s.select(["X1", "X2", "C"]), 2, 0.7, 0.5)
    return spark.createDataFrame([(v,) for v in sorted(found)], "var string")


@known("x y lag1", [("x", 0, 0.0), ("y", 1, 0.8)])
def lagged_dependence(spark, sf):
    """Covariance with x one step before, within each series."""
    wide = tr.lagged(series(spark, sf), ["x"], "t", 1, ["s"])
    s = sufficient_stats(wide, ["x", "y", "x_lag1"])
    rows = [(v, k, abs(round(float(s.cov[s.index[v], s.index["x_lag1"]]), 1))) for k, v in enumerate(("x", "y"))]
    return spark.createDataFrame(rows, "x string, y int, lag1 double")
