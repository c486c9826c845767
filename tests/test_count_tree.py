import random
from collections import Counter
from itertools import permutations

import pytest

from causalspark.operators.count_tree import CountTree, tree_test
from causalspark.operators.independence import ChiSquare, GSquare
from causalspark.operators.scores import BDeu
from causalspark.operators.search import pc


def rows(n, seed, holes=0.0):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.choice("xxxyz"), r.choice([0, 0, 0, 1])
        c = int(r.random() < 0.1 + 0.4 * (a == "x") + 0.4 * b)
        d = c if r.random() < 0.8 else 2
        out.append(tuple(None if r.random() < holes else v for v in (a, b, c, d)))
    return out


def plain(data, names):
    at = ["abcd".index(v) for v in names]
    out = Counter(tuple(None if row[k] is None else str(row[k]) for k in at) for row in data)
    return {k: n for k, n in out.items() if None not in k}


@pytest.mark.parametrize("holes", [0.0, 0.1])
def test_counts_of_every_set(spark, holes):
    data = rows(500, 1, holes)
    tree = CountTree(spark.createDataFrame(data, "a string, b int, c int, d int").repartition(3), depth=3)
    assert tree.whole == (holes == 0)
    assert tree.values[0][0] == "x" and tree.values[1] == ["0", "1"]
    for k in range(1, 5):
        for names in permutations("abcd", k):
            assert tree.counts(names) == plain(data, names)


def test_small_sets_need_no_scan(spark):
    data = rows(300, 2)
    tree = CountTree(spark.createDataFrame(data, "a string, b int, c int, d int"), depth=2)
    tree._df = None
    assert tree.counts(("d", "a")) == plain(data, "da")
    with pytest.raises(AttributeError):
        tree.counts(("a", "b", "c"))


def test_tests_scores_and_searches_on_a_tree(spark):
    df = spark.createDataFrame(rows(2000, 3), "a string, b int, c int, d int")
    tree = CountTree(df, alpha=0.001, depth=4)
    for kind in (ChiSquare, GSquare):
        one, two = kind(df, alpha=0.001), tree_test(kind, tree)
        for q in (("a", "b", ()), ("a", "d", ("c",)), ("c", "d", ("a", "b"))):
            assert two.statistic(*q) == pytest.approx(one.statistic(*q))
        assert str(pc(one)) == str(pc(two))
    assert BDeu(tree).local("c", {"a", "b"}) == pytest.approx(BDeu(df).local("c", {"a", "b"}))


def test_empty_and_constant_tables(spark):
    df = spark.createDataFrame([("k", 1), ("k", 1)], "a string, b int")
    assert CountTree(df).counts(("b", "a")) == {("1", "k"): 2}
    assert CountTree(df.limit(0)).counts(("a",)) == {}
    with pytest.raises(ValueError):
        CountTree(spark.createDataFrame([(str(k),) for k in range(5)], "a string"), most=4)
