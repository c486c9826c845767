import numpy as np
import pytest

from causalspark.operators.graph import Graph
from causalspark.operators.latent import discrepancy, fit_clusters, fit_latent_sem, latent_structure, minimised
from causalspark.plans.suffstats import SuffStats


def measured(n=20000, seed=1):
    r = np.random.default_rng(seed)
    k = r.normal(size=(n, 4))
    k[:, 2] = 0.7 * k[:, 0] + 0.7 * k[:, 1] + 0.5 * k[:, 2]
    k[:, 3] = 0.9 * k[:, 2] + 0.6 * k[:, 3]
    x = np.concatenate([k[:, [j]] * [1.0, 0.8, 1.2] + 0.5 * r.normal(size=(n, 3)) for j in range(4)], axis=1)
    names = [f"i{a}{b}" for a in range(4) for b in range(3)]
    return SuffStats(names, n, np.cov(x.T), x.mean(axis=0)), [names[3 * a : 3 * a + 3] for a in range(4)]


def test_gradient_of_the_measurement_model_by_differences(monkeypatch):
    from causalspark.operators import latent

    stats, clusters = measured(500)
    seen = {}
    monkeypatch.setattr(latent, "minimised", lambda f, x, **_: (seen.update(f=f, x=x), (x, f(x)[0], True))[1])
    fit_clusters(stats, clusters)
    x = seen["x"] + np.random.default_rng(2).normal(size=len(seen["x"])) * 0.05
    value, slope = seen["f"](x)
    for k in range(len(x)):
        h = np.zeros(len(x))
        h[k] = 1e-6
        assert (seen["f"](x + h)[0] - seen["f"](x - h)[0]) / 2e-6 == pytest.approx(slope[k], abs=1e-5)


def test_latents_and_their_graph():
    stats, clusters = measured()
    g, fit = latent_structure(stats, clusters, ["a", "b", "c", "d"], 1e-4)
    assert fit.converged and fit.df == 78 - 12 - 12 - 6 and fit.p > 1e-3
    assert fit.loadings["i02"] == pytest.approx(1.2, abs=0.03) and fit.errors["i01"] == pytest.approx(0.25, abs=0.02)
    assert fit.latents.corr[0, 1] == pytest.approx(0.0, abs=0.03)
    assert str(g.subgraph(set("abcd"))) == "a-->c,b-->c,c-->d" and g.latent == set("abcd") and g.parents("i31") == ["d"]
    g, fit = latent_structure(stats, [clusters[0], clusters[1][:2], clusters[2]], ["a", "b", "c"])
    assert fit.latents.names == ["a", "c"] and "b" not in g.nodes


def test_negative_loadings_keep_the_first_positive():
    stats, clusters = measured(5000)
    flip = np.diag([1, -1, 1, 1, 1, 1, -1, -1, -1, 1, 1, 1.0])
    a, b = fit_clusters(stats, clusters), fit_clusters(SuffStats(stats.names, stats.n, flip @ stats.cov @ flip), clusters)
    assert b.loadings["i01"] == pytest.approx(-a.loadings["i01"], abs=1e-4) and b.loadings["i20"] == pytest.approx(a.loadings["i20"], abs=1e-4)
    assert b.latents.corr[0, 2] == pytest.approx(-a.latents.corr[0, 2], abs=1e-4)


def test_em_reaches_the_same_fit_as_the_gradient():
    """A saturated graph among latents implies what free correlations imply."""
    stats, clusters = measured(3000, 4)
    g = Graph.parse("Latent(K0)-->Latent(K1),Latent(K0)-->Latent(K2),Latent(K1)-->Latent(K2)")
    for k in range(3):
        for v in clusters[k]:
            g.add_edge(f"K{k}", v)
    em = fit_latent_sem(stats.select([v for c in clusters[:3] for v in c]), g, starts=2)
    by_gradient = fit_clusters(stats, clusters[:3])
    assert em.converged and em.df == by_gradient.df and em.chi2 == pytest.approx(by_gradient.chi2, abs=0.02)
    assert em.edges["K1", "i11"] == pytest.approx(by_gradient.loadings["i11"] / by_gradient.loadings["i10"], rel=1e-2)


def test_em_never_raises_the_discrepancy_and_keeps_fixed_coefficients():
    stats, clusters = measured(1000, 5)
    g = Graph.parse("Latent(K)-->i00,Latent(K)-->i01,Latent(K)-->i02")
    values = []
    for k in (12, 30, 200, 5000):
        fit = fit_latent_sem(stats.select(clusters[0]), g, {("K", "i01"): 0.8}, rounds=k)
        values.append(fit.chi2)
        assert fit.edges["K", "i01"] == 0.8
    assert values == sorted(values, reverse=True) and fit.converged and fit.df == 0
    plain = fit_latent_sem(stats.select(clusters[0]), Graph.parse("i00-->i01,i01-->i02"))
    assert plain.edges["i00", "i01"] == pytest.approx(stats.regress("i01", ["i00"])[0][0])


def test_minimiser_and_discrepancy():
    x, value, converged = minimised(lambda v: (float((v[0] - 1) ** 2 + 10 * (v[1] - v[0] ** 2) ** 2), np.array([2 * (v[0] - 1) - 40 * v[0] * (v[1] - v[0] ** 2), 20 * (v[1] - v[0] ** 2)])), np.array([-1.0, 2.0]))
    assert converged and x == pytest.approx([1, 1], abs=1e-5) and value < 1e-9
    assert discrepancy(np.eye(2), np.eye(2)) == 0 and discrepancy(np.eye(2), np.diag([1.0, -1.0])) == float("inf")
