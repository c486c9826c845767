import random

import pytest

from causalspark.llm import common
from causalspark.llm.minhash import drop_near_duplicates, near_duplicates


def brute(rows, width=2, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = (t or "").translate(low).encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in sets}


def corpus():
    r = random.Random(3)
    vocab = ["w%d" % k for k in range(400)]
    rows, i = [], 1000

    def add(words):
        nonlocal i
        i -= 1
        rows.append((i, " ".join(words)))

    for _ in range(40):
        add(r.choices(vocab, k=r.randint(1, 60)))
    base = r.choices(vocab, k=120)
    for _ in range(150):  # a large group of near copies, some of them too far away
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = "x%d" % r.randrange(10**6)
        add(w)
    chain = r.choices(vocab, k=100)  # each links to the next only
    for _ in range(12):
        chain = chain[8:] + ["c%d" % r.randrange(10**6) for _ in range(8)]
        add(chain)
    for _ in range(8):
        add(["same", "Text", "here"])
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "É é"), (7, "é é"), (8, "a " * 30000)]
    return rows


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_components_match_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "BROADCAST_IDS", sent)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = {tuple(r) for r in near_duplicates(df, 2, 80).collect()}
    assert got == brute(rows)


def test_five_word_shingles_keep_the_smallest_id(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _, c in brute(rows, 5) if i == c}
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == want


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in near_duplicates(df, 2).collect())))
    assert got == sorted(map(str, [(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)]))
    assert near_duplicates(df.limit(0), 2).count() == 0
    assert drop_near_duplicates(df).count() == 3
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id_but_not_the_text(spark):
    a, b = "red green blue grey", "one two three four"
    rows = [(1, a, "x", 7), (5, a, "y", 7), (5, b, "z", 7), (9, b, "x", 7), (9, b, "x", 7), (5, None, "n", 7), (5, None, "n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string, node long")
    got = sorted(map(str, (tuple(r) for r in near_duplicates(df, 2).collect())))
    assert got == sorted(map(str, [(1, 3, 1), (5, 3, 1), (5, 3, 5), (9, 3, 5), (9, 3, 5), (5, 0, 5), (5, 0, 5)]))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(1, a, "x", 7), (5, b, "z", 7), (5, None, "n", 7)]))


@pytest.mark.parametrize("percent", [60, 90])
def test_other_thresholds(spark, percent):
    rows = corpus()[-180:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df, 2, percent).collect()} == brute(rows, 2, percent)


def test_thresholds_out_of_range(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 2, 50)


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs just at 0.8: 160 common words of 200, as sets of one-word shingles; all are found."""
    r = random.Random(5)
    rows = []
    for k in range(400):
        common = [f"p{k}c{j}" for j in range(160)]
        for side in range(2):
            words = common + [f"p{k}s{side}x{j}" for j in range(20)]
            r.shuffle(words)
            rows.append((2 * k + side, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(df, 1, 80).where("component_id = doc_id").count() == 400
