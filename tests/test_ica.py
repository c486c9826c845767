import itertools

import numpy as np
import pytest

from causalspark.operators import ica
from causalspark.plans.suffstats import SuffStats


def table(spark, b, n=6000, seed=1):
    r = np.random.default_rng(seed)
    x = r.uniform(-1.7, 1.7, size=(n, len(b))) @ np.linalg.inv(np.eye(len(b)) - b).T
    names = [f"x{k}" for k in range(len(b))]
    rows = [tuple(map(float, v)) for v in x] + [(float("nan"),) * len(b)]
    return spark.createDataFrame(rows, ", ".join(f"{v} double" for v in names)).repartition(4), names


def test_components_and_an_acyclic_model(spark):
    b = np.zeros((4, 4))
    b[1, 0], b[2, 1], b[3, 0], b[3, 2] = 0.8, -0.9, 0.7, 0.8
    df, names = table(spark, b)
    found = ica.independent_components(df, names)
    assert found.converged and found.w @ found.stats.cov @ found.w.T == pytest.approx(np.eye(4), abs=1e-8)
    mixed = found.w @ np.linalg.inv(np.eye(4) - b)
    assert np.sort(np.abs(mixed), axis=1)[:, -2].max() < 0.1 * np.abs(mixed).max()  # one error each
    g, coef = ica.lingam(found, 0.1)
    assert set(str(g).split(",")) == {"x0-->x1", "x1-->x2", "x0-->x3", "x2-->x3"} and coef == pytest.approx(b, abs=0.06)
    assert not ica.independent_components(df, names, rounds=1).converged
    with pytest.raises(ValueError):
        ica.independent_components(df.selectExpr("x0", "2 * x0 as y"), ["x0", "y"])


def test_models_with_a_cycle(spark):
    b = np.zeros((4, 4))
    b[1, 0], b[2, 1], b[1, 2], b[3, 2] = 0.9, 0.8, -0.6, 0.7
    df, names = table(spark, b, 12000, 2)
    models = ica.ling(ica.independent_components(df, names), 0.15)
    assert [m.stable for m in models] == [True, False]
    assert {(a, c): pytest.approx(w, abs=0.08) for a, c, w in models[0].edges()} == {("x0", "x1"): 0.9, ("x1", "x2"): 0.8, ("x2", "x1"): -0.6, ("x2", "x3"): 0.7}
    assert models[0].graph().bidirected("x1", "x2") and models[0].graph().directed("x0", "x1")


def test_orders_without_a_zero_on_the_diagonal():
    r = np.random.default_rng(3)
    for _ in range(40):
        some = r.random((4, 4)) < 0.6
        want = {p for p in itertools.permutations(range(4)) if all(some[p[j], j] for j in range(4))}
        assert {tuple(o) for o in ica.zeroless_orders(some)} == want
    w = np.array([[2.0, 1.0], [1.0, 3.0]])
    both = ica.ling(ica.Unmixing(SuffStats(["a", "b"], 10, np.eye(2)), w, True, 1), 0.0)
    assert [m.stable for m in both] == [True, False] and both[0].b == pytest.approx(np.array([[0, -0.5], [-1 / 3, 0]]))
