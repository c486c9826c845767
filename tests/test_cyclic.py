import random
from itertools import combinations

from causalspark.operators.cyclic import CyclicSeparation, best_sets, ccd, ccd_max
from causalspark.operators.graph import Graph
from causalspark.operators.independence import FisherZ
from causalspark.plans.suffstats import SuffStats


def systems(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        names = list("ABCDEF")[: r.randint(3, 6)]
        yield names, [(a, b) for a in names for b in names if a != b and r.random() < 0.28]


def causes(edges, a):
    out, todo = {a}, [a]
    while todo:
        v = todo.pop()
        for x, y in edges:
            if x == v and y not in out:
                out.add(y)
                todo.append(y)
    return out


def test_separation_agrees_with_graphs_that_have_no_cycle():
    r = random.Random(1)
    for _ in range(60):
        names = list("ABCDE")
        edges = [(a, b) for a, b in combinations(names, 2) if r.random() < 0.4]
        g = Graph(names)
        for a, b in edges:
            g.add_edge(a, b)
        t = CyclicSeparation(edges, names)
        for a, b in combinations(names, 2):
            rest = [v for v in names if v not in (a, b)]
            for k in range(4):
                for z in combinations(rest, k):
                    assert t.independent(a, b, z) == g.d_separated(a, b, z)


def test_marks_and_triples_hold_in_random_cyclic_graphs():
    marks = dots = 0
    for names, edges in systems(150, 2):
        found = ccd(CyclicSeparation(edges, names))
        for (a, b), m in found.graph.marks.items():
            if m != "o":
                marks += 1
                assert (a in causes(edges, b)) == (m == "-"), (edges, a, b)
        for b, ends in found.underlined:
            assert causes(edges, b) & ends
        for b, ends in found.dotted:
            dots += 1
            effects = set.intersection(*({v for x, v in edges if x == e} for e in ends))
            assert not any(b in causes(edges, v) for v in effects)
    assert marks > 100


def test_equal_separations_give_equal_classes():
    """The two-node feedback system and the same with the causes of the loop swapped cannot be told apart."""
    names = list("ABXY")
    one = ccd(CyclicSeparation([("A", "X"), ("B", "Y"), ("X", "Y"), ("Y", "X")], names))
    two = ccd(CyclicSeparation([("A", "Y"), ("B", "X"), ("X", "Y"), ("Y", "X")], names))
    assert one.rows() == two.rows()
    assert one.rows() == [
        ("dotted", "A", "X", "B", ""), ("dotted", "A", "Y", "B", ""), ("edge", "A", "X", "", "-->"), ("edge", "A", "Y", "", "-->"),
        ("edge", "B", "X", "", "-->"), ("edge", "B", "Y", "", "-->"), ("edge", "X", "Y", "", "---"),
    ]


def test_three_nodes_in_two_loops():
    found = ccd(CyclicSeparation([("A", "B"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "C"), ("E", "D")], list("ABCDE")))
    assert found.dotted == {("C", frozenset("AE"))}
    assert ("edge", "B", "C", "", "o-o") in found.rows() and ("edge", "C", "D", "", "o-o") in found.rows()


def test_max_p_marks_feedback_and_carries_on():
    found = ccd_max(CyclicSeparation([("A", "X"), ("B", "Y"), ("X", "Y"), ("Y", "X"), ("X", "Z")], list("ABXYZ")))
    assert found.feedback == {frozenset("XY")} and found.graph.directed("X", "Z")
    plain = ccd_max(CyclicSeparation([("A", "B"), ("C", "B"), ("B", "D")], list("ABCD")), feedback=False)
    assert str(plain.graph) == "A-->B,B-->D,C-->B" or set(str(plain.graph).split(",")) == {"A-->B", "B-->D", "C-->B"}


def test_sets_of_triples_by_tasks(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(500, 6))
    x[:, 2] += x[:, 0] + x[:, 1]
    x[:, 4] += x[:, 2] + x[:, 3]
    test = FisherZ(SuffStats(list("ABCDEF"), 500, np.cov(x.T)), 0.01)
    g = Graph.parse("A---C,B---C,C---E,D---E,F---E")
    pairs = [("A", "B"), ("A", "E"), ("C", "D"), ("D", "F")]
    assert best_sets(test, g, pairs, -1, spark) == best_sets(test, g, pairs)
