import numpy as np
import pytest

from causalspark.operators.generalized_sem import Equation, fit_equation, fit_equations, mean_log_likelihoods


def table(spark, n=1500, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    y = 0.8 * x + 0.5 * x**2 + 0.7 * r.normal(size=n)
    z = 2.0 / (1 + np.exp(-1.5 * y)) + r.laplace(0, 0.3, size=n)
    return spark.createDataFrame([tuple(map(float, v)) for v in zip(x, y, z, strict=True)] + [(1.0, None, 2.0)], "x double, y double, z double").repartition(2), x, y, z


def test_likelihoods_of_many_points_match_numpy(spark):
    df, x, y, _ = table(spark)
    e = Equation("y", "a * x + b * x^2", "Normal(0, s)", {"a": 1.0, "b": 0.1, "s": 1.0})
    assert e.causes == ["x"]
    points = [{"a": 1.0, "b": -0.2, "s": 0.5}, {"a": -1e-5, "b": 2.0, "s": 3.0}, {"a": 1.0, "b": 1.0, "s": -1.0}]
    got, n = mean_log_likelihoods(df.dropna(), e, points)
    for p, v in zip(points[:2], got[:2], strict=True):
        r = (y - p["a"] * x - p["b"] * x**2) / p["s"]
        assert v == pytest.approx(np.mean(-0.5 * r**2 - np.log(p["s"]) - 0.5 * np.log(2 * np.pi)))
    assert n == 1500 and got[2] == -np.inf


def test_a_linear_model_in_its_parameters_is_least_squares(spark):
    df, x, y, _ = table(spark)
    fit = fit_equation(df, Equation("y", "a * x + b * x^2", "Normal(0, s)", {"a": 0.0, "b": 0.0, "s": 1.0}))
    w, rss = np.linalg.lstsq(np.column_stack((x, x**2)), y, rcond=None)[:2]
    assert fit.converged and fit.rows == 1500
    assert [fit.values["a"], fit.values["b"], fit.values["s"]] == pytest.approx([*w, np.sqrt(rss[0] / 1500)], abs=1e-4)


def test_a_system_with_other_errors(spark):
    df, *_ = table(spark, 3000, 2)
    system = [Equation("y", "a * x + b * x^2", "Normal(0, s)", {"a": 0.1, "b": 0.1, "s": 1.0}), Equation("z", "c * logistic(k * y)", "Laplace(0, t)", {"c": 1.0, "k": 1.0, "t": 1.0})]
    fit = fit_equations(df, system)
    assert str(fit.graph) == "x-->y,y-->z" or set(str(fit.graph).split(",")) == {"x-->y", "y-->z"}
    z = fit.fits["z"].values
    assert (z["c"], z["k"], z["t"]) == (pytest.approx(2.0, abs=0.06), pytest.approx(1.5, abs=0.15), pytest.approx(0.3, abs=0.03))
    assert fit.normality(df, "y")[1] > 1e-3


def test_refused_equations(spark):
    df, *_ = table(spark)
    with pytest.raises(ValueError):
        Equation("y", "a * x", "Normal", {"a": 1.0})
    with pytest.raises(ValueError):
        Equation("y", "a * x", "Normal(0, s)", {"a": 1.0})
    with pytest.raises(ValueError):
        fit_equation(df, Equation("y", "a * x", "Uniform(0, s)", {"a": 1.0, "s": 0.1}))
    with pytest.raises(ValueError):
        fit_equations(df, [Equation("x", "a * y", "Normal(0, s)", {"a": 1.0, "s": 1.0}), Equation("y", "a * x", "Normal(0, s)", {"a": 1.0, "s": 1.0})])
