import math
import random

import numpy as np

from causalspark.llm.topk import PIVOTS, choose_pivots, integer_vectors, pivot_rows, search_block, top_k


def test_matches_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(300)]  # a frequent vector: ties by id
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[1][1]), (50, rows[50][1]), (1000, [0.0] * 8), (1050, [1e9] * 8)]
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<double>, score int")
    v = integer_vectors(df, "vec_id", "embedding")
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 50 = 0"), 5).collect()))
    ints = {i: [math.floor(256 * x) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted((-min(max(sum(a * b for a, b in zip(ints[q], ints[c])), -(2**63)), 2**63 - 1), c) for c in ints if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    v = integer_vectors(df, "vec_id", "embedding")
    assert list(map(tuple, top_k(v, v.where("vec_id = 0")).collect())) == [(0, 1, 1, 256 * 512)]
    assert top_k(v.limit(0), v.limit(0)).count() == 0


def test_pivots_eliminate_and_bounds_hold():
    r = np.random.default_rng(1)
    c = np.floor(256 * r.normal(0, 1 / 8, (4000, 64))).astype(np.int64)
    basis = choose_pivots(c, PIVOTS)
    assert basis.shape == (64, PIVOTS) and np.allclose(basis.T @ basis, np.eye(PIVOTS), atol=1e-9)
    table = pivot_rows(c, basis)
    score = c[:100] @ c.T
    assert (table[:100].astype(float) @ table.T.astype(float) + 2 >= score).all()
    least = np.sort(score[:, :2000], axis=1)[:, -6]
    ids = [[i] for i in range(4000)]
    found, evaluated = search_block(list(range(100)), c[:100], table[:100], least, ids, c, table, 5)
    assert evaluated < 0.2 * 100 * 4000
    for q in range(100):
        best = sorted((-int(s), i) for i, s in enumerate(score[q]) if i != q)[:5]
        assert [(i, -s) for s, i in best] == [(i, s) for o, i, s in found if o == q]


def test_many_blocks_and_flat_spans(spark, monkeypatch):
    """Vectors of one line, repeated ids, and blocks of a few rows."""
    import causalspark.llm.topk as module

    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "ASKED", 3)
    monkeypatch.setattr(module, "SAMPLE", 7)
    rows = [(i, [float(i % 9 - 4), 2.0 * (i % 9 - 4)]) for i in range(120)] + [(50, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = integer_vectors(df, "vec_id", "embedding")
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 10 = 0"), 3).collect()))
    ints = [(i, [math.floor(256 * x) for x in e]) for i, e in rows]
    want = []
    for q in sorted({i for i, _ in rows if i % 10 == 0}):
        best = sorted({(-max(sum(a * b for a, b in zip(mine, e)) for o, mine in ints if o == q), c) for c, e in ints if c != q})
        want.append((q, best[0][1], -best[0][0]))
    assert {(q, c, s) for q, k, c, s in got if k == 1} == set(want)


def _results(spark):
    """Bytes that the tasks of each stage returned, beside their metrics."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {s.stageId(): s.resultSize() - 10_000 * s.numTasks() for s in (stages.apply(i) for i in range(stages.size()))}


def test_driver_gets_the_sample_only(spark, monkeypatch):
    """Every partition sent as many rows to the driver as the sample has."""
    import causalspark.llm.topk as module

    monkeypatch.setattr(module, "SAMPLE", 300)
    few = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "100k", "spark.sql.files.openCostInBytes": "100k"}
    before = {k: spark.conf.get(k) for k in few}
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(0, 1 / 8, (4000, 32)))], "vec_id long, embedding array<double>")
    try:
        for key, value in few.items():
            spark.conf.set(key, value)
        v = integer_vectors(df, "vec_id", "embedding")
        old = _results(spark)
        found = top_k(v, v.where("vec_id % 50 = 0"), 5)
        found.write.format("noop").mode("overwrite").save()
        new = {k: x for k, x in _results(spark).items() if k not in old}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert max(new.values()) < 300_000  # twice the sample; all 4000 are over a million


def test_ids_of_many_vectors_and_least_longs(spark):
    """Thresholds leave out all vectors of the query's own id; products of least longs do not wrap round."""
    rows = [(50, [100.0 + i, 0.0]) for i in range(12)] + [(i, [1.0 + i, float(i)]) for i in range(1, 9)] + [(100, [-1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = integer_vectors(df, "vec_id", "embedding")
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 50 = 0"), 3).collect()))
    whole = lambda x: min(max(math.floor(256 * x), -(2**63)), 2**63 - 1)
    ints = [(i, [whole(x) for x in e]) for i, e in rows]
    want = []
    for q in (50, 100):
        scores = [(-min(max(sum(a * b for a, b in zip(mine, e)), -(2**63)), 2**63 - 1), c) for o, mine in ints if o == q for c, e in ints if c != q]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(sorted(scores)[:3])]
    assert got == want


def test_exact_in_floats_of_any_kind():
    """Lengths for single and double floats and for none, ties by id, several ids of a vector."""
    r = np.random.default_rng(5)
    for size in (2.0, 2e3, 2e8, 2e17):
        c = np.unique(np.floor(size * r.normal(0, 1, (300, 6))).astype(np.int64), axis=0)
        ids = [[3 * i] + [1000 + i] * (i % 5 == 0) for i in range(len(c))]
        basis = choose_pivots(c, 3)
        table = pivot_rows(c, basis)
        found, _ = search_block([3 * i for i in range(40)], c[:40], table[:40], [-(2**63)] * 40, ids, c, table, 5)
        for q in range(40):
            scores = [(-min(max(sum(int(a) * int(b) for a, b in zip(c[q], c[j])), -(2**63)), 2**63 - 1), i) for j, mine in enumerate(ids) for i in mine if i != 3 * q]
            assert [(i, s) for o, i, s in found if o == 3 * q] == [(i, -s) for s, i in sorted(scores)[:5]]
