import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from causalspark.llm import jaccard_join
from causalspark.llm.jaccard_join import jaccard_components, jaccard_pairs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = (text or "").translate(LOW).encode().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset()


def linked(x, y, percent):
    return x and y and 100 * len(x & y) >= percent * len(x | y)


def brute(rows, width, percent):
    """The multiset of (doc_id, set size, component) by comparing all rows."""
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if linked(sets[a], sets[b], percent):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(300)]
    rows, i = [], 2000

    def add(words):
        nonlocal i
        i -= 1
        rows.append((i, " ".join(words)))

    for _ in range(50):
        add(r.choices(vocab, k=r.randint(1, 80)))
    base = r.choices(vocab, k=150)
    for _ in range(120):  # a large group of near copies, some of them too far away
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = "x%d" % r.randrange(10**6)
        add(w)
    chain = r.choices(vocab, k=120)  # each links to the next only
    for _ in range(12):
        chain = chain[10:] + ["c%d" % r.randrange(10**6) for _ in range(10)]
        add(chain)
    passages = [r.choices(vocab, k=30) for _ in range(4)]
    for _ in range(40):  # texts made of frequent passages
        add(sum(r.sample(passages, 3), []) + r.choices(vocab, k=r.randint(0, 20)))
    for k in range(6, 40):  # pairs of short texts at and around the threshold
        w = r.choices(vocab, k=k)
        add(w)
        add(w + r.choices(vocab, k=max(1, k // 5)))
        add(w[: k - k // 5])
    for _ in range(8):
        add(["same", "Text", "here"])
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "É é"), (7, "é é"), (8, "a " * 30000)]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 5, 80), (2, 2, 80), (3, 1, 60), (4, 3, 100)])
def test_components_match_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_components(df, width, percent).collect()), key=str)
    assert got == brute(rows, width, percent)


def test_all_pairs_match_brute_force(spark):
    rows = corpus(5)
    members, pairs = jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    node = {i: n for i, n in members.collect()}
    of = {}
    for i, t in rows:
        of.setdefault(node[i], set()).add(shingles(t, 2))
    assert all(len(s) == 1 for s in of.values())
    sets = {n: next(iter(s)) for n, s in of.items() if n is not None}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]) + len(sets[b])) for a in sets for b in sets if a < b and linked(sets[a], sets[b], 80)}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_that_repeat_ids_or_lack_them(spark):
    text = " ".join("abcdefghijkl")
    rows = [(7, text), (7, text), (7, text + " m"), (7, "other words than these ones"), (None, text), (None, None), (None, "alone in here by itself"), (3, text.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_components(df, 5, 80).collect()), key=str)
    assert got == brute(rows, 5, 80)


def test_empty_table_and_refused_threshold(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df).collect() == []
    with pytest.raises(ValueError):
        jaccard_components(df, 5, 40)


def test_small_batches_give_the_same(spark):
    rows = corpus(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, 5, 80)


def test_filters_never_reject_what_is_similar():
    """The suffix filter's bound: parities of parts differ in no more places than sets do."""
    r = random.Random(9)
    for _ in range(200):
        x = {r.randrange(2**63) for _ in range(r.randint(1, 300))}
        y = set(list(x)[r.randint(0, 20) :]) | {r.randrange(2**63) for _ in range(r.randint(0, 30))}
        parts = 64 * jaccard_join.WORDS
        odd = [{p for p in range(parts) if sum(1 for v in s if v % parts == p) % 2} for s in (x, y)]
        assert len(odd[0] ^ odd[1]) <= len(x ^ y)


def test_sets_and_postings_of_long_texts_are_sent_in_small_batches(monkeypatch):
    monkeypatch.setattr(jaccard_join, "TOGETHER", 5000)
    texts = [" ".join(f"w{k % 7}x{j}" for j in range(n)) for k, n in enumerate([*range(0, 3000, 60), 2, 9000, 1])]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["node", "text"])
    sets = list(jaccard_join._set_batches(iter([given]), 5))
    assert max(sum(b.column(1).to_pylist()[:-1]) for b in sets) < 5000
    rows = [r for b in sets for r in b.to_pylist()]
    powers = jaccard_join._Powers()
    for k, (r, t) in enumerate(zip(rows, texts, strict=True)):
        assert r["node"] == k and r["n"] == len(r["shingles"])
        assert r["shingles"] == jaccard_join.shingle_set(t, 5, powers).view(np.int64).tolist()
    full = [b.filter(pa.compute.greater(b.column(1), 0)) for b in sets]
    one = pa.Table.from_batches(full).combine_chunks().to_batches()
    posted = list(jaccard_join._posted_batches(iter(one), 80))
    assert len(posted) > 1 and all(b.num_rows * len(jaccard_join._POSTED) < 5000 + 9 * (9000 // 5 + 1) for b in posted)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 10**9)
    assert pa.Table.from_batches(posted).to_pylist() == pa.Table.from_batches(jaccard_join._posted_batches(iter(one), 80)).to_pylist()
