"""Column changes, edge tables and repeatable draws on awkward inputs."""

import numpy as np
import pytest

from causalspark.operators import columns as co
from causalspark.operators import marked_tables as mt
from causalspark.operators.calculator import compile_expression, gamma_draws, poisson_draws
from causalspark.operators.search import assignment


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, ep_src string, ep_dst string")


def test_edge_tables(spark):
    g = edges(spark, [("A", "B", "-", ">"), ("B", "A", "-", ">"), ("C", "B", ">", ">"), ("C", "C", "-", "-"), (None, "A", "-", ">")])
    assert [tuple(r) for r in mt.two_cycles(g).collect()] == [("A", "B")]
    assert {r.rule: r.n for r in mt.violations(g.where("src is not null")).collect()} == {"no_edges_to_self": 1, "directed_only": 2, "directed_or_undirected": 1, "at_most_one_edge": 1}
    assert sorted(map(tuple, mt.adjacencies(g).collect())) == [("A", "B"), ("B", "C")]
    assert sorted(map(tuple, mt.unshielded(edges(spark, [("A", "B", "-", ">"), ("C", "B", ">", ">")])).collect())) == [("A", "B", "C", True)]
    empty = g.limit(0)
    assert mt.hamming(empty, empty).first()["shd"] == 0 and mt.cliques(empty, 3).count() == 0
    assert {r.rule: r.n for r in mt.violations(empty).collect()} == dict.fromkeys(["no_edges_to_self", "directed_only", "directed_or_undirected", "at_most_one_edge"], 0)
    full = edges(spark, [(a, b, "-", "-") for a, b in ("AB", "AC", "BC", "CD")])
    assert [r.nodes for r in mt.cliques(full, 3).collect()] == [["A", "B", "C"]]
    assert sorted(r.nodes for r in mt.maximal(mt.cliques(full, 2), full).collect()) == [["C", "D"]]


def test_columns(spark):
    df = spark.createDataFrame([(1, 0.0, "1.5", 7), (2, 0.0, "x", 8), (3, 0.0, None, 9)], "id long, zero double, label string, key int")
    assert [r.label for r in co.numeric_labels(df, ["label"]).orderBy("id").collect()] == [1.5, None, None]
    noisy = co.noisy_zeroes(df, ["zero", "key"], "id", 1)
    assert noisy.where("zero = 0").count() == 0 and noisy.select("key").distinct().count() == 3
    assert sorted(map(tuple, noisy.collect())) == sorted(map(tuple, co.noisy_zeroes(df.repartition(3), ["zero", "key"], "id", 1).collect()))
    assert co.copy_column(df, df.limit(1), "id", "key").columns == ["id", "zero", "label", "key"]
    with pytest.raises(ValueError):
        co.reorder_columns(df, ["nothing"])
    assert co.collect_variables([df, df.select("key")]) == df.columns and sorted(co.shuffle_columns(df, 3).columns) == sorted(df.columns)
    assert co.restrict_to_measured(df, {"key"}).columns == df.columns[:3] and len(co.continuous_schema(3)) == 3
    assert co.drop_nan(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"), ["x"]).count() == 1


def test_draws_follow_from_row_ids(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    for f in ("Normal(0, 1)", "Gamma(0.5, 2)", "Poisson(4)", "Beta(2, 3)", "StudentT(5)"):
        one = {r.k: r.x for r in df.withColumn("x", compile_expression(f, 3, "k")).collect()}
        two = {r.k: r.x for r in df.repartition(7).withColumn("x", compile_expression(f, 3, "k")).collect()}
        assert one == two and len(set(one.values())) > 5, f
    u = np.random.default_rng(0).random(50_000)
    x, y = gamma_draws(u, np.full(len(u), 0.4), np.full(len(u), 3.0)), poisson_draws(u, np.full(len(u), 7.0))
    assert abs(x.mean() - 1.2) < 0.05 and abs(x.var() - 3.6) < 0.3 and abs(y.mean() - 7) < 0.1 and abs(y.var() - 7) < 0.3


def test_assignment_is_the_best_one():
    from itertools import permutations

    r = np.random.default_rng(4)
    for _ in range(60):
        p = int(r.integers(1, 6))
        cost = r.exponential(1, (p, p)) ** 3
        got = assignment(cost)
        assert abs(sum(cost[got[i], i] for i in range(p)) - min(sum(cost[q[i], i] for i in range(p)) for q in permutations(range(p)))) < 1e-9
