import random
import zlib
from fractions import Fraction
from hashlib import sha256

from pyspark.sql import functions as F

from causalspark.llm.periodic_runs import SquareCatcher, periodic_runs, runs_of
from causalspark.llm.queries import op13_periodic_runs


def brute(w, least=2):
    """Maximal stretches by comparing each word with that q later, for every q; the smallest q of a stretch stays."""
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e - s >= q:
                seen.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items() if e - s >= least * q)


def sequences(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        k, n = r.choice([1, 2, 2, 3, 5]), r.randint(0, 60)
        w = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.5 and n > 5:
            p = r.randint(1, n // 2)
            a = r.randrange(n - p)
            w = w[:a] + (w[a : a + p] * 60)[: n - a]
        yield r, w


def test_runs_match_brute_force():
    for _, w in sequences(2000, 1):
        assert runs_of(w) == brute(w)


def test_runs_of_every_prefix_while_words_are_appended():
    for r, w in sequences(300, 2):
        catcher, i = SquareCatcher(), 0
        while i < len(w):
            m = r.choice([1, 1, 2, 7])
            catcher.append(w[i : i + m])
            i += m
            assert [(s, e - s, q) for s, e, q in catcher.found()] == brute(w[:i])


def test_long_repetitive_texts():
    assert runs_of(["a"] * 30000) == [(0, 30000, 1)]
    assert runs_of([1, 2, 3] * 7000) == [(0, 21000, 3)]
    assert runs_of(list(range(5000)) * 3) == [(0, 15000, 5000)]
    word = [0, 1]  # Thue-Morse: squares, but no run of more than two periods
    for _ in range(11):
        word = word + [1 - x for x in word]
    assert runs_of(word, 3) == [] and runs_of(word[:600]) == brute(word[:600])


def expected(doc_id, text, plant=True):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = sorted((r for r in brute(w) if r[1] >= max(6, 4 * r[2])), key=lambda r: (r[0], r[2]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    digest = lambda t: sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def test_query_matches_plain_loops(spark, tmp_path):
    r = random.Random(4)
    rows = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "a"), (-5, "x " * 6), (-6, "x " * 5), (-7, "a b " * 4 + "a"), (None, "n n n n n n n"), (None, None), (-8, "é é " * 9)]
    for k in range(300):
        w = [r.choice(["a", "b", "c", "A", "dd"][: r.randint(1, 5)]) for _ in range(r.randint(0, 120))]
        rows.append((k, r.choice([" ", "  ", "\n"]).join(w)))
    rows += rows[40:44]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted((expected(*x) for x in rows), key=str)


def test_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "so so so so so so it is is is"), (2, "no runs here")], "doc_id int, text string")
    got = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert (got[1].runs, got[1].collapsed, got[1].n_runs) == ("0,6,1\n", "so it is is is", 1)
    assert (got[2].runs, got[2].collapsed, got[2].start) == ("", "no runs here", None)
    assert periodic_runs(df.where(F.lit(False))).collect() == []
