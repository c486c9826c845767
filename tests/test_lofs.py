import numpy as np

from causalspark.operators import lofs, search
from causalspark.operators.graph import Graph, random_dag
from causalspark.operators.independence import DSeparation, FisherZ
from causalspark.plans.suffstats import sufficient_stats


def test_directions_from_skew_and_spacing(spark):
    r = np.random.default_rng(3)
    x = r.exponential(size=4000) - 1
    y = 0.9 * x + 0.7 * (r.exponential(size=4000) - 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for rule in lofs.RULES[:2]:
        assert ("x", "y") in lofs.pairwise_directions(df, ["x", "y"], rule), rule
    g = lofs.orient(Graph.parse("x---y"), df, "skew")
    assert g.directed("x", "y")
    u = r.random(4000)
    both = spark.createDataFrame([(float(a), float(a**3)) for a in u], "a double, b double")
    assert lofs.igci(both, "a", "b") < 0
    s = sufficient_stats(df, ["x", "y"])
    assert abs(lofs.total_strength(s, ["x", "y"])[1, 0] - 0.9) < 0.1
    assert lofs.skeleton_fdr(FisherZ(s)).adjacent("x", "y")


def test_skeleton_with_false_discovery_bound_and_oracle():
    for seed in range(5):
        dag = random_dag(6, 6, seed)
        want, _ = search.skeleton(DSeparation(dag))
        assert lofs.skeleton_fdr(DSeparation(dag)) == want
