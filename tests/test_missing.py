import itertools
import math

import numpy as np
import pytest

from causalspark.functions.special import log_gamma
from causalspark.operators import missing as m
from causalspark.operators.graph import Graph

DAG = Graph.parse("a-->c,b-->c,c-->d")


def rows(n=400, seed=1, holes=0.3):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b = int(r.random() < 0.5), ["x", "y", "z"][r.integers(3)]
        c = int(r.random() < 0.2 + 0.5 * a + 0.2 * (b == "z"))
        d = c if r.random() < 0.8 else 1 - c
        out.append(tuple(None if r.random() < holes else v for v in (a, b, c, d)))
    return out + [(None, None, None, None)] * 3


def plain_counts(data, values, dag, tables, family):
    """Expected counts and log-likelihood by listing every completion of every row."""
    names = list(values)
    out, like = {}, 0.0
    for row in data:
        weights = {}
        for full in itertools.product(*[values[v] if x is None else [x] for v, x in zip(names, row, strict=True)]):
            at = dict(zip(names, full, strict=True))
            weights[full] = math.prod(tables[v][tuple(values[c].index(at[c]) for c in (*dag.parents(v), v))] for v in names)
        total = sum(weights.values())
        like += math.log(total)
        for full, w in weights.items():
            key = tuple(values[c].index(full[names.index(c)]) for c in family)
            out[key] = out.get(key, 0.0) + w / total
    return out, like


@pytest.mark.parametrize("cells", [1 << 20, 5])
def test_expected_counts_match_plain_loops(spark, monkeypatch, cells):
    monkeypatch.setattr(m, "CELLS", cells)
    data = rows(60 if cells == 5 else 300)
    held = m.counted_rows(spark.createDataFrame(data, "a int, b string, c int, d int").repartition(3), ["a", "b", "c", "d"])
    assert held.values == {"a": [0, 1], "b": ["x", "y", "z"], "c": [0, 1], "d": [0, 1]}
    net = m.starting_network(held, DAG, 5)
    families = [("a",), ("a", "b", "c"), ("d", "a", "c"), ("b", "d")]
    counts, like = m.expected_counts(held, net, families)
    for f in families:
        want, want_like = plain_counts(data, held.values, DAG, net.tables, f)
        assert {k: pytest.approx(x) for k, x in want.items()} == {k: float(x) for k, x in np.ndenumerate(counts[f])}
    assert like == pytest.approx(want_like)


def test_em_matches_plain_em_and_never_loses_likelihood(spark):
    data = rows(200, 2)
    held = m.counted_rows(spark.createDataFrame(data, "a int, b string, c int, d int"), ["a", "b", "c", "d"])
    net = m.starting_network(held, DAG, 3)
    likes = []
    for _ in range(4):
        tables = {}
        for v in DAG.nodes:
            family = (*DAG.parents(v), v)
            want, like = plain_counts(data, held.values, DAG, net.tables, family)
            t = np.zeros([len(held.values[c]) for c in family])
            for k, x in want.items():
                t[k] = x
            tables[v] = t / t.sum(axis=-1, keepdims=True)
        got = m.fit_tables(held, DAG, net, rounds=1)
        likes.append(got.log_likelihood)
        assert got.log_likelihood == pytest.approx(like) and not got.converged
        for v in DAG.nodes:
            assert got.tables[v] == pytest.approx(tables[v])
        net = got
    assert likes == sorted(likes)


def test_complete_rows_give_shares_and_score(spark):
    data = [r for r in rows(300, 4, 0.0) if None not in r]
    held = m.counted_rows(spark.createDataFrame(data, "a int, b string, c int, d int"), ["a", "b", "c", "d"])
    net = m.fit_tables(held, DAG)
    assert net.converged
    one = [r for r in data if r[0] == 1 and r[1] == "z"]
    assert net.tables["c"][1, 2, 1] == pytest.approx(sum(r[2] for r in one) / len(one))
    counts = np.array([[3.0, 5.0], [0.0, 2.0]])
    want = sum(math.lgamma(2.0) - math.lgamma(2.0 + sum(r)) + sum(math.lgamma(1.0 + x) - math.lgamma(1.0) for x in r) for r in counts)
    assert m.family_score(counts, 4.0) == pytest.approx(want)
    p = net.bayes_net(spark).marginal(["d"], {"a": 1}).toPandas()
    assert p["p"].sum() == pytest.approx(1.0)


def test_structure_from_rows_with_holes(spark):
    held = m.counted_rows(spark.createDataFrame(rows(3000, 6, 0.15), "a int, b string, c int, d int"), ["a", "b", "c", "d"])
    net = m.structural_em(held)
    assert net.converged and {frozenset(e[:2]) for e in net.dag.edges()} == {frozenset("ac"), frozenset("bc"), frozenset("cd")}
    assert len(net.history) > 1 and net.history[-1] == net.history[-2] and not net.dag.has_directed_cycle()
    again = m.structural_em(held, DAG)
    assert {frozenset(e[:2]) for e in again.dag.edges()} == {frozenset("ac"), frozenset("bc"), frozenset("cd")}


def test_log_gamma():
    x = np.array([1e-6, 0.1, 0.5, 1, 2, 3.7, 9.99, 10, 55.5, 1e6])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)
