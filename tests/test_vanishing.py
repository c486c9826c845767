from itertools import combinations

import numpy as np
import pytest

from causalspark.functions.special import chi2_sf
from causalspark.operators import vanishing as v
from causalspark.plans.suffstats import SuffStats, sufficient_stats


def table(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))


def one_factor(n, p, seed, noise=0.7):
    r = np.random.default_rng(seed)
    return r.exponential(size=(n, 1)) @ r.uniform(0.6, 1.2, (1, p)) + noise * r.normal(size=(n, p))


def test_fourth_moments_match_plain_loops(spark):
    names = list("abcde")
    x = one_factor(300, 5, 1)
    df = table(spark, x, names).repartition(7)
    stats = sufficient_stats(df, names)
    products = v.needed_products([v.tetrads(*"abcd"), v.tetrads(*"abce")[:1]])
    assert len(set(products)) == len(products) < 70  # of the 70 of five variables
    found = v.fourth_moments(df, products, stats)
    c = x - x.mean(axis=0)
    for p in products:
        want = sum(np.prod([row[names.index(k)] for k in p]) for row in c) / len(c)
        assert found(*reversed(p)) == pytest.approx(want, rel=1e-9)


def test_few_products_take_the_other_way(spark):
    names = [f"x{k}" for k in range(12)]
    x = one_factor(100, 12, 2)
    df = table(spark, x, names)
    products = [tuple(names[k : k + 4]) for k in range(0, 9, 2)]
    found = v.fourth_moments(df, products, sufficient_stats(df, names))
    c = x - x.mean(axis=0)
    for p in products:
        assert found(*p) == pytest.approx(np.mean(np.prod(c[:, [names.index(k) for k in p]], axis=1)), rel=1e-9)
    assert v.fourth_moments(df.limit(0), products, SuffStats(names, 0, np.eye(12), np.zeros(12))).n == 0


def test_tetrad_statistic_matches_its_definition(spark):
    """T by numeric derivatives and moments over rows, written out."""
    names, x = list("abcd"), one_factor(400, 4, 3)
    test = v.delta_test(table(spark, x, names), names, v.tetrads(*names)[:2])
    c = x - x.mean(axis=0)
    pairs = list(combinations(range(4), 2))
    s = np.cov(x.T)
    vec = np.array([s[i, j] for i, j in pairs])

    def differences(u):
        m = dict(zip(pairs, u, strict=True))
        return np.array([m[0, 1] * m[2, 3] - m[0, 2] * m[1, 3], m[0, 1] * m[2, 3] - m[0, 3] * m[1, 2]])

    slopes = np.array([(differences(vec + h) - differences(vec - h)) / 2e-5 for h in np.eye(6) * 1e-5])
    spread = np.array([[np.mean(c[:, i] * c[:, j] * c[:, k] * c[:, m]) - s[i, j] * s[k, m] for k, m in pairs] for i, j in pairs])
    t = differences(vec)
    want = len(x) * t @ np.linalg.solve(slopes.T @ spread @ slopes, t)
    assert test.chi_square(*v.tetrads(*names)[:2]) == pytest.approx(want, rel=1e-6)
    assert test.p_value(*v.tetrads(*names)[:2]) == pytest.approx(chi2_sf(want, 2), rel=1e-6)


def test_sextad_slopes_match_numeric_ones():
    r = np.random.default_rng(4)
    m = r.normal(size=(6, 6))
    stats = SuffStats(list("abcdef"), 100, m @ m.T)
    test = v.DeltaTest(stats)
    value, slope = test._difference(tuple("adbcef"))
    for (a, b), want in slope.items():
        moved = stats.cov.copy()
        i, j = stats.index[a], stats.index[b]
        moved[i, j] += 1e-6
        moved[j, i] = moved[i, j]
        assert (v.DeltaTest(SuffStats(list("abcdef"), 100, moved))._difference(tuple("adbcef"))[0] - value) / 1e-6 == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_p_values_are_even_where_the_model_holds():
    r = np.random.default_rng(5)
    load, names = r.uniform(0.5, 1.2, (6, 2)), list("abcdef")
    load[::2, 1] *= -1
    one, two, corr = [], [], []
    for _ in range(200):
        x = r.normal(size=(1500, 2)) @ load.T + 0.7 * r.normal(size=(1500, 6))
        stats = SuffStats(names, 1500, np.cov(x.T), x.mean(axis=0))
        halves = [tuple(names[k] for k in h) for h in ((0, 3, 5, 1, 2, 4), (0, 2, 5, 1, 3, 4), (0, 1, 3, 2, 4, 5), (0, 1, 4, 2, 3, 5))]
        two.append(v.DeltaTest(stats).p_value(*halves))
        corr.append(v.DeltaTest(stats, correlations=True).p_value(*halves))
        y = r.normal(size=(1500, 1)) + 0.7 * r.normal(size=(1500, 4))
        one.append(v.DeltaTest(SuffStats(names[:4], 1500, np.cov(y.T))).p_value(*v.tetrads(*names[:4])[:2]))
    for p in (one, two, corr):
        assert 0.4 < np.median(p) < 0.6 and 0.15 < np.mean(np.array(p) < 0.25) < 0.35


def test_dependent_differences_have_no_statistic():
    stats = SuffStats(list("abcd"), 100, np.cov(one_factor(100, 4, 6).T))
    assert np.isnan(v.DeltaTest(stats).chi_square(*v.tetrads(*"abcd")))
    with pytest.raises(ValueError):
        v.DeltaTest(stats, v.FourthMoments(1, {}), correlations=True)


def test_clusters_of_small_tables(spark):
    r = np.random.default_rng(7)
    f = r.normal(size=(4000, 2))
    f[:, 1] += 0.5 * f[:, 0]
    x = np.concatenate([f[:, [0]] @ [[1, 0.8, 1.2]], f[:, [1]] @ [[1, 0.9, 1.1, 0.7]]], axis=1) + 0.5 * r.normal(size=(4000, 7))
    names = [f"x{k}" for k in range(7)]
    test = v.DeltaTest(SuffStats(names, 4000, np.cov(x.T), x.mean(axis=0)))
    assert v.build_pure_clusters(spark, test, 1e-4) == [["x0", "x1", "x2"], ["x3", "x4", "x5", "x6"]]
    assert v.two_factor_clusters(spark, v.DeltaTest(test.stats.select(names[:5])), 1e-4) == []
    g = v.factor_graph([["a", "b"]], 2)
    assert g.latent == {"L1", "L2"} and g.parents("b") == ["L1", "L2"]
