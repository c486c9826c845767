"""Mixed regressions, model texts, the command line, streams and the driver's entry points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from causalspark.__main__ import main
from causalspark.operators import model_io, models, search
from causalspark.operators.glm import BayesianConstraint, MixedRegression
from causalspark.operators.graph import Graph, cpdag, from_text
from causalspark.operators.independence import ChiSquare
from causalspark.streaming.stats import RunningStats


def test_mixed_regression(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=1500)
    d = (x + r.normal(size=1500) > 0).astype(int) + (x + r.normal(size=1500) > 1)
    y = d + r.normal(size=1500)
    df = spark.createDataFrame([(float(a), str(b), float(c)) for a, b, c in zip(x, d, y)], "x double, d string, y double")
    t = MixedRegression(df, ["d"], ["x", "y"])
    assert t.p_value("x", "d") < 1e-9 and t.p_value("d", "y") < 1e-9 and t.p_value("x", "y", ["d"]) > 1e-3 > t.p_value("x", "y")


def test_discrete_simulation_search_and_xml(spark):
    dag = Graph.parse("A-->C,B-->C,C-->D")
    df = model_io.simulate_discrete(spark, dag, 8000, 2, 3).cache()
    assert df.count() == 8000
    assert search.pc(ChiSquare(df, dag.nodes, 0.001)) == cpdag(dag)
    b = BayesianConstraint(df, dag.nodes)
    assert b.p_value("A", "B") > 1e-3 > b.p_value("A", "C", ["B"])
    net = models.BayesNet.fit(df, dag)
    again = model_io.bayes_net_from_xml(spark, model_io.bayes_net_to_xml(net))
    p, q = ({str(r["D"]): r["p"] for r in n.marginal(["D"]).collect()} for n in (net, again))
    assert p.keys() == q.keys() and all(p[k] == pytest.approx(q[k]) for k in p)


def test_sem_xml(spark):
    dag = Graph.parse("A-->B")
    fit = models.fit_sem(models.simulate_sem(spark, dag, 500, 1), dag)
    g, edges, variances = model_io.sem_from_xml(model_io.sem_to_xml(fit))
    assert g == dag and edges == fit.edges and variances == {k: float(v) for k, v in fit.variances.items()}
    mixed = model_io.simulate_mixed(spark, Graph.parse("A-->B,B-->C"), ["B"], 300, 3, 1)
    assert mixed.select("B").distinct().count() == 3


def test_command_line(spark, tmp_path):
    dag = Graph.parse("X1-->X3,X2-->X3")
    rows = models.simulate_sem(spark, dag, 1500, 5, 0.8, 1.2).select(*dag.nodes).collect()
    (tmp_path / "d.txt").write_text("\t".join(dag.nodes) + "\n" + "\n".join("\t".join(map(str, r)) for r in rows) + "\n")
    for algorithm in ("pc", "pc.stable", "fges"):
        assert from_text(main(["-data", str(tmp_path / "d.txt"), "-algorithm", algorithm, "-significance", "0.001", "-penaltydiscount", "2"])) == dag
    assert "Graph Edges:" in main(["-algorithm", "randomDag", "-outfile", str(tmp_path / "g.txt")])


def test_running_statistics_of_batches(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    run = RunningStats(["a", "b"])
    for k in range(3):
        run(df.where(F.col("a") % 3 == k), k)
    run(df, 2)  # a repeated batch counts once
    assert run.stats.n == 1000 and run.stats.cov[0, 0] == pytest.approx(df.agg(F.var_samp("a")).first()[0])


def test_entry_points(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_some_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("nation", "customer", "part", "orders", "lineitem", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("cov_matrix", "fisher_z_pairs", "chi_square_cond", "equal_count", "lag_expand", "cpt_dirichlet", "bn_joint", "ancestors", "shd"):
        got, want = entry_module.queries()[name](spark, sf).toPandas(), con.execute(entry_module.oracle_sql()[name]).df()
        rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).values.tolist()))
        assert rows(got) == rows(want), name
