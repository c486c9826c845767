import numpy as np
import pytest
from pyspark.sql import functions as F

from causalspark.operators import folds as f
from causalspark.operators import mixed, transforms
from causalspark.operators.independence import FisherZ
from causalspark.operators.search import skeleton
from causalspark.plans.suffstats import SuffStats


def table(spark, n=203, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    x[:, 1] += x[:, 0]
    rows = [(int(7 * k - 500), *map(float, t)) for k, t in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5), x


def finder():
    def find(s: SuffStats):  # not a name of this module, which tasks cannot import
        return skeleton(FisherZ(s, 0.01))[0]

    return find


def same(s, x):
    assert s.n == len(x) and s.means == pytest.approx(x.mean(axis=0)) and s.cov == pytest.approx(np.cov(x.T))


@pytest.mark.parametrize("bits", [12, 3])
def test_order_statistics_are_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(f, "BITS", bits)
    df, _ = table(spark)
    ids = np.array([7 * k - 500 for k in range(203)])
    n, bounds = f.order_statistics(df, "id", 3, [0.25, 0.5, 1.0], 9)
    assert n == 203
    for d in range(3):
        h = [int(v) for v in f.drawn(ids, d, 9)]
        assert [sum(v < b for v in h) for b in bounds[d]] == [51, 102, 203]


def test_folds_and_training_sets(spark):
    df, x = table(spark)
    parts = f.fold_stats(df, ["a", "b", "c"], "id", 5, 3)
    assert sorted(p.n for p in parts) == [40, 40, 41, 41, 41]
    ids = np.array([7 * k - 500 for k in range(203)])
    order = np.argsort(f.drawn(ids, 0, 3))
    cuts = [round(203 * k / 5) for k in range(6)]
    for k, (train, test) in enumerate(f.training_sets(parts)):
        inside = order[cuts[k] : cuts[k + 1]]
        same(test, x[inside])
        same(train, np.delete(x, inside, axis=0))
        design = np.column_stack((np.ones(train.n), np.delete(x, inside, axis=0)[:, [0, 2]]))
        w = np.linalg.lstsq(design, np.delete(x, inside, axis=0)[:, 1], rcond=None)[0]
        want = np.mean((x[inside, 1] - w[0] - x[inside][:, [0, 2]] @ w[1:]) ** 2)
        assert f.prediction_error(train, test, "b", ["a", "c"]) == pytest.approx(want)


def test_halves_hold_each_row_once(spark):
    df, x = table(spark)
    for first, second in f.half_stats(df, ["a", "b", "c"], "id", 4, 2):
        assert (first.n, second.n) == (102, 101)
        same(f.together([first, second]), x)
    long = transforms.complementary_halves(df.withColumnRenamed("c", "sides"), 3, 2, "id")
    assert long.columns == ["id", "a", "b", "sides", "pair", "half"]
    sizes = {(r["pair"], r["half"]): r["count"] for r in long.groupBy("pair", "half").count().collect()}
    assert sizes == {(p, h): 102 - h for p in range(3) for h in (0, 1)}
    first = long.where("pair = 0 and half = 0").agg(F.avg("a")).first()[0]
    assert first == pytest.approx(f.half_stats(df, ["a", "b", "c"], "id", 3, 2)[0][0].means[0])


def test_leave_one_out_matches_refits(spark):
    df, x = table(spark, 60)
    got = {r["row_id"]: r for r in f.leave_one_out(df, ["a", "b", "c"], "b", "id").collect()}
    for k in range(60):
        rest = np.delete(x, k, axis=0)
        w = np.linalg.lstsq(np.column_stack((np.ones(59), rest[:, [0, 2]])), rest[:, 1], rcond=None)[0]
        r = got[7 * k - 500]
        assert r["features"] == ["a", "c"] and r["loss"] == pytest.approx((x[k, 1] - w[0] - x[k, [0, 2]] @ w[1:]) ** 2)
    by_search = f.leave_one_out(df, ["a", "b", "c"], "b", "id", finder())
    assert {tuple(r["features"]) for r in by_search.collect()} == {("a",)}


def test_features_and_edges_that_stay(spark):
    df, _ = table(spark, 400)
    found = f.validated_features(spark, f.fold_stats(df, ["a", "b", "c"], "id", 4), "b", finder()).collect()
    assert [r["features"] for r in found] == [["a"]] * 4 and all(0.7 < r["error"] < 1.4 for r in found)
    assert f.feature_stability([set(r["features"]) for r in found], 2) == 1.0
    assert f.feature_stability([{"a"}, {"b"}], 2) < 0
    edges = {(r["a"], r["b"]): r for r in f.stable_edges(df, ["a", "b", "c"], "id", finder(), 10, 0.5).collect()}
    assert edges["a", "b"]["share"] == 1.0 and edges["a", "b"]["kept"] and all(not r["kept"] for k, r in edges.items() if k != ("a", "b"))


def test_bound_of_wrong_edges():
    """Continuous where its two forms meet, falling in the threshold, and as published for 50 pairs."""
    at = lambda t: mixed.complementary_pairs_bound(10, 100, t, 50)
    assert at(0.75) == pytest.approx(at(0.7500001), rel=1e-3)
    values = [at(t / 100) for t in range(55, 100, 5)]
    assert values == sorted(values, reverse=True) and at(0.9) == pytest.approx(4 * 0.11 / 1.02)
    assert f.selection_threshold(1, 3, 10, 1e-9) == 1.01


def test_columns_of_the_table_stay(spark):
    df = spark.createDataFrame([(1, 5, 2, 0.5), (2, 6, 1, 1.5), (3, 7, 1, 4.5)], "t int, row int, k int, x double")
    lagged = transforms.lagged(df, ["x"], "t", 1)
    assert lagged.columns == ["t", "row", "k", "x", "x_lag1"] and [r["row"] for r in lagged.collect()] == [6, 7]
    assert transforms.difference(df, ["x"], "t").columns == df.columns
    assert transforms.case_expand(df, "row").columns == ["t", "k", "x"] and transforms.case_expand(df, "t").count() == 6
    with pytest.raises(ValueError):
        transforms.bootstrap(df.withColumnRenamed("x", "Weight"), 2, 1, "t")
