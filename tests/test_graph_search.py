"""Searches against the d-separation oracle, and graph algebra."""

import pytest

from causalspark.functions import special as sp
from causalspark.operators import graph as G
from causalspark.operators import search as S
from causalspark.operators.graph import Graph
from causalspark.operators.independence import DSeparation, Facts
from causalspark.operators.knowledge import Knowledge
from causalspark.operators.scores import DSeparationScore


# fixed values: small graphs and the patterns and partial ancestral graphs that are known for them
@pytest.mark.parametrize(
    ("dag", "pattern"),
    [
        ("X1-->X2,X1-->X3,X2-->X4,X3-->X4", "X1---X2,X1---X3,X2-->X4,X3-->X4"),
        ("A-->D,A-->B,B-->D,C-->D,D-->E", "A-->D,A---B,B-->D,C-->D,D-->E"),
        ("A-->B,B-->C", "A---B,B---C"),
    ],
)
def test_pc_with_oracle(dag, pattern):
    truth, want = Graph.parse(dag), Graph.parse(pattern)
    for search in (S.pc, S.cpc, S.pc_max):
        assert search(DSeparation(truth)) == want, search.__name__
    assert G.cpdag(truth) == want


@pytest.mark.parametrize(
    ("dag", "pag"),
    [
        ("X1-->X2,X1-->X3,X2-->X4,X3-->X4", "X1o-oX2,X1o-oX3,X2-->X4,X3-->X4"),
        ("X1-->X3,X2-->X3,X3-->X4", "X1o->X3,X2o->X3,X3-->X4"),
        ("Latent(L1)-->X1,Latent(L1)-->X2,X3-->X1,X4-->X2", "X3o->X1,X4o->X2,X1<->X2"),
    ],
)
def test_fci_with_oracle(dag, pag):
    truth, want = Graph.parse(dag), Graph.parse(pag)
    for search in (S.fci, S.rfci, S.cfci, S.fci_max):
        assert str(search(DSeparation(truth))) and search(DSeparation(truth)).marks == want.marks, search.__name__
    assert S.dag_to_pag(truth).marks == want.marks


def test_random_patterns_are_found_by_pc_and_fges():
    for seed in range(12):
        dag = G.random_dag(8, 10, seed)
        want = G.cpdag(dag)
        assert S.pc(DSeparation(dag)) == want, seed
        assert G.cpdag(G.dag_from_pattern(want)) == want, seed
        assert not dag.has_directed_cycle() and G.shd(want, want) == 0
        fast = S.fci(DSeparation(dag))
        assert {frozenset(e[:2]) for e in fast.edges()} == {frozenset(e[:2]) for e in want.edges()}
        assert fast.marks == S.dag_to_pag(dag).marks, seed


def test_fges_with_the_oracle_score():
    dag = Graph.parse("X1-->X3,X2-->X3,X3-->X4")
    assert S.fges(DSeparationScore(dag)) == G.cpdag(dag)


def test_markov_blankets():
    dag = Graph.parse("A-->T,T-->C,B-->C,C-->D,A-->E")
    test = DSeparation(dag)
    assert set(S.iamb(test, "T")) == set(S.grow_shrink(test, "T")) == set(S.mb_from_pattern(test, "T")) == dag.markov_blanket("T") == {"A", "B", "C"}


def test_knowledge_directs_edges():
    dag = Graph.parse("A-->B,B-->C")
    k = Knowledge.parse("/knowledge\naddtemporal\n1 A\n2 B C\nforbiddirect\nC B\nrequiredirect\n")
    assert k.forbidden("B", "A") and k.forbidden("C", "B") and not k.forbidden("B", "C")
    assert S.pc(DSeparation(dag), knowledge=k) == Graph.parse("A-->B,B-->C")
    assert Knowledge.parse(k.text()).tiers == k.tiers


def test_separation_and_text_forms():
    g = Graph.parse("A-->C,B-->C,C-->D,Latent(L)-->A,Latent(L)-->B")
    assert not g.d_separated("A", "B") and g.d_separated("A", "B", ["L"]) and not g.d_separated("A", "B", ["L", "D"])
    assert g.ancestors(["D"]) == {"A", "B", "C", "D", "L"} and g.descendants(["C"]) == {"C", "D"}
    assert G.from_text(G.to_text(g)) == g and G.from_json(G.to_json(g)) == g and "A" in G.to_dot(g)
    assert g.moral().adjacent("A", "B") and G.inducing_path(g, "A", "B")
    f = Facts([("X", "Y", ()), ("X", "Z", ("Y",))])
    assert f.independent("Y", "X") and not f.independent("X", "Z")
    m = G.to_matrix(g)
    assert m[g.nodes.index("A")][g.nodes.index("C")] == 2 and m[g.nodes.index("C")][g.nodes.index("A")] == 3


def test_recovery_statistics():
    truth, est = Graph.parse("A-->B,B-->C,C---D"), Graph.parse("A-->B,C-->B,A-->D,C---D")
    r = G.recovery(est, truth)
    assert r["shd"] == 3 and r["adj_precision"] == 0.75 and r["adj_recall"] == 1.0
    assert G.adjacency_confusion(est, truth) == {"tp": 3, "fp": 1, "fn": 0, "tn": 2}


def test_special_functions():
    assert sp.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95) and sp.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert sp.f_cdf(3.0, 4, 12) == pytest.approx(0.937493, abs=1e-5) and sp.binomial_cdf(3, 10, 0.5) == pytest.approx(0.171875)
    assert sp.poisson_cdf(2, 3.0) == pytest.approx(0.42319, abs=1e-5) and sp.digamma(1) == pytest.approx(-0.5772156649)
    for q, cdf, args in ((sp.chi2_quantile, sp.chi2_cdf, (5,)), (sp.t_quantile, sp.t_cdf, (7,)), (sp.f_quantile, sp.f_cdf, (3, 9)), (sp.beta_quantile, sp.beta_cdf, (2, 3))):
        assert cdf(q(0.3, *args), *args) == pytest.approx(0.3)
    assert sp.fdr_cutoff(0.05, [0.001, 0.01, 0.2, 0.9], False) == (0.01, 1)
