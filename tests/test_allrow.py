import numpy as np
import pytest

from causalspark.operators.allrow import FeatureKernel, ResidualPowers
from causalspark.operators.search import pc

NAMES = list("abcd")


def table(spark, n, seed):
    """b follows a's square, c follows b, d alone; some rows lack a value."""
    r = np.random.default_rng(seed)
    a, d = r.normal(size=n), r.exponential(size=n)
    b = np.abs(a) + 0.4 * r.normal(size=n)
    c = np.sin(2 * b) + 0.3 * r.normal(size=n)
    rows = [tuple(map(float, t)) for t in zip(a, b, c, d, strict=True)] + [(None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3), np.array(rows[:-2])


@pytest.mark.parametrize("kind", [FeatureKernel, ResidualPowers])
def test_decisions_that_linear_tests_miss(spark, kind):
    test = kind(table(spark, 4000, 1)[0], NAMES, 1e-4)
    test.prefetch([("a", "b", ()), ("a", "c", ()), ("a", "d", ()), ("a", "c", ("b",)), ("c", "b", ("a", "d"))])
    assert len(test.answers) == 5
    got = {q: p > 1e-4 for q, p in test.answers.items()}
    assert got == {("a", "b", ()): False, ("a", "c", ()): False, ("a", "d", ()): True, ("a", "c", ("b",)): True, ("b", "c", ("a", "d")): False}
    assert test.p_value("c", "a", ["b"]) == test.answers["a", "c", ("b",)]


def test_kernel_statistic_matches_plain_arrays(spark):
    df, x = table(spark, 500, 2)
    test = FeatureKernel(df, NAMES, given=8)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    q = ("a", "c", ("b",))
    left, right, given = (f(z) for f in (*test._sides(q), test._given(q[2])))
    f = np.concatenate((left, right), axis=1)
    f, g = f - f.mean(axis=0), given - given.mean(axis=0)
    zz = g.T @ g / len(g)
    r = f - g @ np.linalg.solve(zz + 1e-6 * np.trace(zz) / 8 * np.eye(8), g.T @ f / len(g))
    u = (r[:, :5, None] * r[:, None, 5:]).reshape(len(r), -1)
    spread = np.cov(u.T, bias=True)
    first, second = np.trace(spread), 2 * (spread**2).sum()
    from causalspark.functions.special import gamma_cdf

    want = 1 - gamma_cdf(len(x) * float(u.mean(axis=0) @ u.mean(axis=0)), first**2 / second, second / first)
    assert test.p_value(*q) == pytest.approx(want, abs=1e-9)


def test_power_statistic_matches_plain_arrays(spark):
    df, x = table(spark, 400, 3)
    test = ResidualPowers(df, NAMES, powers=2)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    largest = 0.0
    for i in (1, 2):
        for j in (1, 2):
            a, b = z[:, 0] ** i, z[:, 3] ** j
            a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
            r = float((a * b).mean())
            largest = max(largest, abs(np.sqrt(len(z)) * np.arctanh(r) / np.sqrt((a * a * b * b).mean())))
    from causalspark.functions.special import normal_cdf

    assert test.p_value("a", "d") == pytest.approx(2 * (1 - normal_cdf(largest)))


def test_p_values_are_even_without_dependence(spark):
    r = np.random.default_rng(4)
    rows = [tuple(map(float, v)) for v in r.normal(size=(1500, 24))]
    names = [f"v{k}" for k in range(24)]
    df = spark.createDataFrame(rows, ", ".join(f"{v} double" for v in names))
    test = FeatureKernel(df, names, given=20)
    test.prefetch([(names[k], names[k + 1], (names[(k + 2) % 24],) if k % 4 else ()) for k in range(0, 24, 2)] + [(names[k], names[k + 8], ()) for k in range(16)])
    p = np.array(list(test.answers.values()))
    assert 0.3 < np.median(p) < 0.7 and p.min() > 1e-3


def test_a_search_asks_the_test(spark):
    test = FeatureKernel(table(spark, 3000, 5)[0].select("a", "b", "c"), list("abc"), 1e-4)
    g = pc(test)
    assert {frozenset(e[:2]) for e in g.edges()} == {frozenset("ab"), frozenset("bc")}
