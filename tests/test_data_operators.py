"""Operators on data, against NumPy, planted models and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalspark.operators import calculator as calc
from causalspark.operators import clusters, kernel, mixed, models, scores, search, timeseries, transforms
from causalspark.operators.graph import Graph, cpdag, dag_from_pattern
from causalspark.operators.independence import ChiSquare, CorrelationT, CramerT, FisherZ, GSquare, LikelihoodRatio, Pooled, Regression, ScoreTest, canonical_rank
from causalspark.plans.harness import averages, compare, simulate, utilities
from causalspark.plans.suffstats import SuffStats, grouped_stats, sufficient_stats
from causalspark.sources.tabular import format_covariance, infer_types, parse_covariance, read_table

DAG = Graph.parse("X1-->X3,X2-->X3,X3-->X4,X4-->X5,X2-->X5")


@pytest.fixture(scope="module")
def planted(spark):
    return models.simulate_sem(spark, DAG, 4000, 3, 0.7, 1.3, 4).cache()


def test_sufficient_statistics_and_groups(spark, planted):
    x = np.array(planted.select(*DAG.nodes).collect())
    s = sufficient_stats(planted, DAG.nodes)
    assert np.allclose(s.cov, np.cov(x.T)) and np.allclose(s.means, x.mean(axis=0)) and s.n == 4000
    big = planted.select((F.col("X1") + 1e9).alias("a"), F.when(F.col("X2") > 0, F.col("X2")).alias("b"))
    t = sufficient_stats(big)
    keep = x[x[:, DAG.nodes.index("X2")] > 0]
    at = [DAG.nodes.index(v) for v in ("X1", "X2")]
    assert t.n == len(keep) and np.allclose(t.cov, np.cov(keep[:, at].T), atol=1e-5)
    g = grouped_stats(planted.withColumn("g", F.col("row_id") % 2), "g", DAG.nodes)
    assert sum(v.n for v in g.values()) == 4000
    assert sufficient_stats(planted.limit(0), DAG.nodes).n == 0


def test_searches_recover_the_planted_graph(spark, planted):
    s = sufficient_stats(planted, DAG.nodes)
    want = cpdag(DAG)
    assert search.pc(FisherZ(s, 0.001)) == want and search.fges(scores.SemBic(s, 2.0)) == want
    g, sepsets = search.skeleton_fan_out(spark, s, 0.001)
    h, _ = search.skeleton(FisherZ(s, 0.001))
    assert g == h and all(k not in g.marks for k in sepsets)
    pag = search.gfci(FisherZ(s, 0.001), scores.SemBic(s, 2.0))
    assert pag.marks == search.dag_to_pag(DAG).marks
    halves = [sufficient_stats(planted.where(F.col("row_id") % 2 == k), DAG.nodes) for k in (0, 1)]
    assert search.fges(scores.Images([scores.SemBic(h, 2.0) for h in halves])) == want
    assert search.pc(Pooled([FisherZ(h) for h in halves], "fisher", 0.001)) == want
    assert set(search.iamb(FisherZ(s, 0.001), "X3")) == DAG.markov_blanket("X3")


def test_gaussian_tests_agree(planted):
    s = sufficient_stats(planted, DAG.nodes)
    ind, dep = ("X1", "X2", ()), ("X1", "X3", ("X2",))
    for test in (FisherZ(s), CorrelationT(s), CramerT(s), Regression(s), ScoreTest(scores.SemBic(s))):
        assert test.p_value(*dep) < 1e-6 and not test.independent(*dep), type(test).__name__
    r = s.partial_correlation("X1", "X3", ["X2"])
    res = models.ols(s, "X3", ["X1", "X2"])
    assert res.t[1] == pytest.approx(r * math.sqrt((s.n - 3) / (1 - r * r)), rel=1e-9)
    assert Regression(s).p_value("X3", "X1", ["X2"]) == pytest.approx(res.p[1], abs=1e-12)
    assert FisherZ(s).p_value(*ind) > 1e-4 and canonical_rank(s, ["X1", "X2"], ["X4", "X5"]) >= 1
    for m in ("fisher", "tippett", "worsleyfriston", "stouffer", "mudholkergeorge", "average", "majority", "percent", "fdr"):
        assert Pooled([FisherZ(s), CramerT(s)], m).p_value(*dep) < 0.01, m


def test_singular_submatrices_count_as_independent():
    cov = np.array([[1.0, 1.0, 0.5], [1.0, 1.0, 0.5], [0.5, 0.5, 1.0]])
    assert FisherZ(SuffStats(["a", "b", "c"], 100, cov)).independent("a", "c", ["b"])


def test_discrete_tests_and_scores(spark):
    r = np.random.default_rng(1)
    a = r.integers(0, 2, 3000)
    b = np.where(r.random(3000) < 0.8, a, 1 - a)
    c = np.where(r.random(3000) < 0.8, b, 1 - b)
    df = spark.createDataFrame([(int(x), int(y), int(z)) for x, y, z in zip(a, b, c)], "a int, b int, c int")
    want = cpdag(Graph.parse("a-->b,b-->c"))
    for t in (ChiSquare, GSquare):
        assert search.pc(t(df, alpha=0.01)) == want
        assert t(df).statistic("a", "c", ("b",))[1] == 2
    for sc in (scores.DiscreteBic(df), scores.BDeu(df, sample=10), scores.BDe(df)):
        assert search.fges(sc) == want, type(sc).__name__
    net = models.BayesNet.fit(df, Graph.parse("a-->b,b-->c"))
    p = {x["c"]: x["p"] for x in net.marginal(["c"], {"a": 1}).collect()}
    q, u = np.mean(b[a == 1]), [np.mean(c[b == k]) for k in (0, 1)]
    assert p[1] == pytest.approx(q * u[1] + (1 - q) * u[0], abs=1e-9)
    small = net.em(df.drop("b"), 2)
    assert sum(x["p"] for x in small.marginal(["b"]).collect()) == pytest.approx(1)


def test_mixed_model_and_conditional_gaussian(spark, monkeypatch):
    r = np.random.default_rng(2)
    d = r.integers(0, 2, 2000)
    e = np.where(r.random(2000) < 0.85, d, 1 - d)
    x = d * 2.0 + r.normal(size=2000)
    y = x + r.normal(size=2000)
    z = r.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(b), float(c), str(u), str(v)) for a, b, c, u, v in zip(x, y, z, d, e)], "x double, y double, z double, d string, e string")
    g = mixed.mgm(df, ["x", "y", "z"], ["d", "e"], (0.15, 0.15, 0.15)).graph()
    assert {frozenset(t[:2]) for t in g.edges()} == {frozenset(p) for p in (("x", "y"), ("x", "d"), ("d", "e"))}
    monkeypatch.setattr(mixed, "LOCAL_ROWS", 0)
    far = mixed.mgm(df, ["x", "y", "z"], ["d", "e"], (0.15, 0.15, 0.15), rounds=3)
    monkeypatch.undo()
    near = mixed.mgm(df, ["x", "y", "z"], ["d", "e"], (0.15, 0.15, 0.15), rounds=3)
    assert np.allclose(far.rho, near.rho) and np.allclose(far.beta, near.beta) and far.objective == pytest.approx(near.objective)
    dense = mixed.mgm(df, ["x", "y", "z"], ["d", "e"], (0.0, 0.0, 0.0))
    assert len(dense.graph().edges()) >= 8
    cg = scores.ConditionalGaussian(df, ["d", "e"], ["x", "y", "z"])
    skeleton_of = lambda g: {frozenset(t[:2]) for t in g.edges()}
    assert skeleton_of(search.fges(cg)) == skeleton_of(g)
    assert LikelihoodRatio(cg).p_value("d", "x") < 1e-9 < LikelihoodRatio(cg).p_value("z", "x")


def test_stability(spark, planted):
    f = {frozenset((r.src, r.dst)): r.frequency for r in mixed.bootstrap_frequencies(planted, DAG.nodes, 10, 1, "row_id", 0.001).collect()}
    assert all(f[frozenset(e[:2])] > 0.9 for e in DAG.edges())
    assert mixed.stars(planted, DAG.nodes, [0.3, 0.001], "row_id", 6, 0.08) in (0.3, 0.001)
    assert mixed.complementary_pairs_bound(10, 100, 0.9, 50) < mixed.complementary_pairs_bound(10, 100, 0.6, 50)
    s = sufficient_stats(planted, DAG.nodes)
    assert mixed.preferential_diversity({"X1": 0.9, "X3": 0.8, "X4": 0.7}, s, 2, 1.0) == ["X1", "X3"]


def test_structural_equations(planted):
    s = sufficient_stats(planted, DAG.nodes)
    fit = models.fit_sem(s, DAG)
    assert fit.p > 1e-4 and fit.df == 5 and np.allclose(np.diag(fit.implied), np.diag(s.cov), rtol=0.01)
    want = fit.edges["X3", "X4"] * fit.edges["X4", "X5"]
    assert models.total_effect(fit, "X3", "X5") == pytest.approx(want)
    assert models.ida(s, cpdag(DAG), "X4", "X5")


def test_logistic(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=3000)
    y = (r.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    res = models.logistic(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y int, x double"), "y", ["x"])
    assert res.coef == pytest.approx([0.5, 1.5], abs=0.2) and res.p[1] < 1e-9


def test_directions_and_lingam():
    r = np.random.default_rng(6)
    e = r.exponential(size=(5000, 3)) - 1
    x = np.stack([e[:, 0], 0.9 * e[:, 0] + e[:, 1], np.zeros(5000)], axis=1)
    x[:, 2] = 0.8 * x[:, 1] + e[:, 2]
    g, b = search.lingam(x, ["a", "b", "c"], 0.1)
    assert g == Graph.parse("a-->b,b-->c") and b[1, 0] == pytest.approx(0.9, abs=0.1)


def test_time_series(spark):
    r = np.random.default_rng(7)
    x, y = np.zeros(3000), np.zeros(3000)
    for t in range(1, 3000):
        x[t] = 0.5 * x[t - 1] + r.normal()
        y[t] = 0.8 * x[t - 1] + r.normal()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y double")
    g = timeseries.ts_search(df, ["x", "y"], "t", 1, "pc", 0.001)
    assert g.directed("x:1", "y") and g.directed("x:1", "x") and not g.adjacent("y:1", "x")
    a, _ = timeseries.var_model(df, ["x", "y"], "t", 1)
    assert a[0] == pytest.approx(np.array([[0.5, 0], [0.8, 0]]), abs=0.1)
    assert timeseries.granger(df, "x", "y", "t", 1) < 1e-9 and timeseries.granger(df, "y", "x", "t", 1) > 1e-4


def test_clusters_and_kernels(spark):
    r = np.random.default_rng(8)
    f = r.normal(size=(4000, 2))
    x = np.concatenate([f[:, [0]] + 0.5 * r.normal(size=(4000, 4)), f[:, [1]] + 0.5 * r.normal(size=(4000, 4))], axis=1)
    s = SuffStats([f"v{k}" for k in range(8)], 4000, np.cov(x.T), x.mean(axis=0))
    assert sorted(map(sorted, clusters.one_factor_clusters(s, 0.001))) == [[f"v{k}" for k in range(4)], [f"v{k}" for k in range(4, 8)]]
    load = np.abs(clusters.varimax(clusters.principal_factors(s, 2)))
    assert (load.argmax(axis=1)[:4] != load.argmax(axis=1)[4:]).all()
    u = r.normal(size=300)
    assert kernel.hsic_p_value(u, u**2 + 0.1 * r.normal(size=300)) < 0.01 < kernel.hsic_p_value(u, r.normal(size=300))
    v = u + 0.3 * r.normal(size=300)
    k = kernel.Kci(np.stack([u, v, v + 0.3 * r.normal(size=300)], axis=1), ["a", "b", "c"])
    assert k.p_value("a", "c") < 0.01 < k.p_value("a", "c", ["b"])
    df = spark.createDataFrame([(float(a), float(np.exp(a))) for a in r.normal(size=800)], "n double, l double")
    assert kernel.anderson_darling_normal(df, "n")[1] > 0.01 > kernel.anderson_darling_normal(df, "l")[1]


def test_calculator(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, -3.0)], "X double, Y double")
    value = lambda e: [r[0] for r in df.select(calc.compile_expression(e)).collect()]
    assert value("X + Y * 2 ^ 2") == [9.0, -8.0] and value("-(X - 1) / 2") == [0.0, -1.5] and value("max(X, Y, 3)") == [3.0, 4.0]
    assert value("IF(X < 2, Y, Switch(1, X, 7))") == [2.0, 7.0] and value("OR(X = 1, Y > 0)") == [1.0, 0.0] and value("+(X, Y, 1)") == [4.0, 2.0]
    assert value("round(X / 2)") == [1.0, 2.0] and value("XOR(X = 1, Y = 2)") == [0.0, 0.0]
    many = spark.range(4000).withColumn("X", F.lit(1.0))
    for e, mean, tol in (("N(2, 1)", 2, 0.1), ("U(0, 4)", 2, 0.1), ("Gamma(2, 3)", 6, 0.5), ("Poisson(3)", 3, 0.2), ("Beta(1, 1)", 0.5, 0.05), ("Indicator(0.25)", 0.25, 0.05), ("ExponentialDist(2)", 0.5, 0.1), ("Discrete(1, 1)", 0.5, 0.05), ("Triangular(0, 1, 2)", 1, 0.05), ("Split(0, 1, 3, 4)", 2, 0.1)):
        assert many.select(calc.compile_expression(e, 5).alias("v")).agg(F.avg("v")).first()[0] == pytest.approx(mean, abs=tol), e
    assert calc.expand_templates("TSUM($ * 2)", ["A", "B"]) == "((A * 2) + (B * 2))"
    with pytest.raises(ValueError):
        calc.parse("X +")


def test_transforms(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(100)], "id int, a double, b double")
    z = transforms.standardize(df, ["a"]).agg(F.avg("a"), F.stddev_samp("a")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)
    v = sorted(i % 7 for i in range(100))
    assert transforms.quantile_points(df, "a", 4) == [v[25], v[50], v[75]]
    again = [transforms.add_missing(df, ["a"], 0.3, 1, "id").where("a is null").count() for _ in range(2)]
    assert again[0] == again[1] and 10 < again[0] < 50
    b = transforms.bootstrap(df, 5, 1, "id").groupBy("replicate").agg(F.sum("weight").alias("w")).collect()
    assert len(b) == 5 and all(60 < r.w < 140 for r in b)
    h = transforms.complementary_halves(df, 3, 1, "id").groupBy("pair", "id").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(h) == (1, 300)
    n = transforms.nonparanormal(df.select("id", F.exp(F.col("id") / 20).alias("x")), "x", "y").agg(F.corr("id", "y")).first()[0]
    assert n > 0.95 and transforms.is_binary(df.select((F.col("id") % 2).alias("q")), "q") and not transforms.is_binary(df, "a")
    assert transforms.drop_constant(df.withColumn("c", F.lit(1))).columns == df.columns
    assert transforms.normalise_missing(spark.createDataFrame([(-99, float("nan"))], "i int, x double")).first() == (None, None)


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text('// a comment\nA\tB\tC\n1\tx\t1.5\n2\t"y"\t*\n\n3\tx\t-2e1\n')
    df = read_table(spark, str(tmp_path / "t.txt"), max_discrete=5)
    assert [k for _, k in df.dtypes] == ["string", "string", "double"] and df.where("B = 'y' and C is null").count() == 1
    assert dict(infer_types(df, 0).dtypes)["A"] == "double"
    s = parse_covariance("/covariance\n100\nX Y Z\n1.0\n0.5 2.0\n0.1 0.2 3.0\n")
    assert s.n == 100 and s.cov[0, 1] == s.cov[1, 0] == 0.5 and np.allclose(parse_covariance(format_covariance(s)).cov, s.cov)
    with pytest.raises(ValueError):
        parse_covariance("10\nX Y\n1.0")


def test_comparison_harness(spark):
    out = compare(spark, {"pc_stable": {"alpha": [0.001, 0.01]}, "fges": {"penalty": [2.0]}}, {"nodes": [6], "edges": [6], "n": [2000]}, runs=3).cache()
    assert out.select("algorithm", "parameters", "run").distinct().count() == 9
    a = {(r.algorithm, r.parameters): r["mean"] for r in averages(out).where("statistic = 'adj_recall'").collect()}
    assert all(v > 0.7 for v in a.values()) and utilities(out, {"adj_precision": 1.0, "shd": 0.5}).count() == 3
    assert simulate(DAG, 50, 1).n == 50 and not dag_from_pattern(cpdag(DAG)).has_directed_cycle()


def test_kmeans(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (10.0, 10.0), (10.0, 11.0)], "x double, y double")
    centres, out = models.kmeans(df, ["x", "y"], [[0.0, 0.0], [5.0, 5.0]])
    assert centres == [[0.0, 0.5], [10.0, 10.5]] and sorted(r.cluster for r in out.collect()) == [0, 0, 1, 1]
