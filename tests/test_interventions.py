import itertools

import numpy as np
import pytest

from causalspark.operators.graph import Graph
from causalspark.operators.interventions import NotIdentified, effect, evaluated, identify, manipulated, projected
from causalspark.operators.models import fit_sem
from causalspark.plans.suffstats import SuffStats

GRAPHS = {
    "back door": ("Z-->X,Z-->Y,X-->Y", True),
    "bow": ("Latent(U)-->X,Latent(U)-->Y,X-->Y", False),
    "front door": ("Latent(U)-->X,Latent(U)-->Y,X-->M,M-->Y", True),
    "instrument": ("Z-->X,X-->Y,Latent(U)-->X,Latent(U)-->Y", False),
    "napkin": ("W-->Z,Z-->X,X-->Y,Latent(U)-->W,Latent(U)-->X,Latent(V)-->W,Latent(V)-->Y", True),
    "effect first": ("Latent(U)-->X,Latent(U)-->Y,Y-->X", True),
    "two paths": ("X-->M,M-->Y,X-->N,N-->Y,Latent(U)-->X,Latent(U)-->N,Latent(V)-->M,Latent(V)-->Y", None),
    "hidden chain": ("X-->Latent(U),Latent(U)-->Y,Z-->X,Z-->Y", True),
    "collider": ("X-->Z,Latent(U)-->Z,Latent(U)-->Y,X-->Y", True),
}


def joint(g, seed, do=None):
    """{values in the order of nodes: probability} of a random binary model, with some variables set."""
    r, do = np.random.default_rng(seed), do or {}
    tables = {v: r.uniform(0.1, 0.9, [2] * len(g.parents(v))) for v in g.nodes}
    out = {}
    for full in itertools.product((0, 1), repeat=len(g.nodes)):
        at, p = dict(zip(g.nodes, full, strict=True)), 1.0
        for v in g.nodes:
            one = float(tables[v][tuple(at[u] for u in g.parents(v))])
            p *= float(at[v] == do[v]) if v in do else one if at[v] else 1 - one
        out[full] = p
    return out


def margin(table, nodes, keep):
    out = {}
    for full, p in table.items():
        key = tuple(x for v, x in zip(nodes, full, strict=True) if v in keep)
        out[key] = out.get(key, 0.0) + p
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_effects_match_the_manipulated_model(spark, name):
    text, possible = GRAPHS[name]
    g = Graph.parse(text)
    try:
        e = identify(g, ["Y"], ["X"])
    except NotIdentified as found:
        assert not possible and found.hedge[1] <= found.hedge[0]
        return
    assert possible is not False and str(e)
    seen = [v for v in g.nodes if v not in g.latent]
    rows = [(*k, float(p)) for k, p in margin(joint(g, 3), g.nodes, seen).items()]
    cells = spark.createDataFrame(rows, ", ".join(f"{v} int" for v in seen) + ", p double").coalesce(1)
    got = evaluated(e, cells).toPandas()
    for x in (0, 1):
        want = margin(joint(g, 3, {"X": x}), g.nodes, ["Y"])
        here = got[got["X"] == x] if "X" in got.columns else got
        assert set(here["Y"]) == {0, 1}
        for r in here.itertuples():  # the same for all values of variables that the expression leaves free
            assert r.p == pytest.approx(want[(int(r.Y),)])


def test_effects_from_rows(spark):
    g = Graph.parse("Z-->X,Z-->Y,X-->Y")
    rows = [(z, x, y) for z, x, y, n in [(0, 0, 0, 5), (0, 0, 1, 3), (0, 1, 0, 1), (0, 1, 1, 3), (1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 0, 2), (1, 1, 1, 8)] for _ in range(n)]
    df = spark.createDataFrame([*rows, (None, 1, 1)], "Z int, X int, Y int")
    got = {r["Y"]: r["p"] for r in effect(df, g, ["Y"], {"X": 1}).collect()}
    assert got == {1: pytest.approx(12 / 24 * 3 / 4 + 12 / 24 * 8 / 10), 0: pytest.approx(12 / 24 / 4 + 12 / 24 * 2 / 10)}
    with pytest.raises(ValueError):
        identify(g, ["Y"], ["Y"])


def test_a_free_variable_is_averaged_over(spark):
    g = Graph.parse(GRAPHS["napkin"][0])
    r = np.random.default_rng(8)
    u, v = r.random(3000) < 0.5, r.random(3000) < 0.5
    w = r.random(3000) < 0.2 + 0.3 * u + 0.3 * v
    z = r.random(3000) < 0.3 + 0.4 * w
    x = r.random(3000) < 0.1 + 0.4 * z + 0.4 * u
    y = r.random(3000) < 0.1 + 0.5 * x + 0.3 * v
    df = spark.createDataFrame([tuple(map(int, t)) for t in zip(w, z, x, y, strict=True)], "W int, Z int, X int, Y int")
    got = {r["Y"]: r["p"] for r in effect(df, g, ["Y"], {"X": 1}).collect()}
    assert got[1] == pytest.approx(0.75, abs=0.06) and got[0] + got[1] == pytest.approx(1.0)


def test_projection_of_hidden_paths():
    m = projected(Graph.parse("A-->Latent(H),Latent(H)-->B,Latent(H)-->C,Latent(K)-->Latent(H),Latent(K)-->D"))
    assert m.into["B"] == {"A"} and m.into["D"] == set()
    assert m.joined == {frozenset("BC"), frozenset("BD"), frozenset("CD")}


def test_setting_a_variable_of_a_linear_model():
    g = Graph.parse("A-->B,B-->C,A-->C")
    b = np.array([[0, 0, 0], [0.5, 0, 0], [0.3, 2.0, 0]])
    total = np.linalg.inv(np.eye(3) - b)
    fit = fit_sem(SuffStats(list("ABC"), 1000, total @ total.T, np.zeros(3)), g)
    cut = manipulated(fit, {"B": 3.0}, {"A": 1.0, "B": 0.5, "C": 1.3})
    assert cut.means == pytest.approx([1.0, 3.0, 0.3 + 6.0 + (1.3 - 0.3 - 1.0)])
    assert cut.cov == pytest.approx(np.array([[1, 0, 0.3], [0, 0, 0], [0.3, 0, 1.09]]))
