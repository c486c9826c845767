import random
import re

from causalspark.llm.minhash import _Powers
from causalspark.llm.spans import LEAST, SPAN, remove_repeated_spans, sentences


def brute(rows):
    powers, seen, out = _Powers(), {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        first, _, _ = sentences(t, powers)
        words = (t or "").encode().lower().split()
        units = [tuple(words[a:b]) for a, b in zip(first, first[1:])]
        gone = set()
        ends = [(k, next((e for e in range(k + SPAN, len(units) + 1) if first[e] - first[k] >= LEAST), None)) for k in range(len(units))]
        tail = [k for k in range(len(units) - SPAN + 1) if len(words) - first[k] >= LEAST][-1:]
        for k, e in dict.fromkeys([(k, e) for k, e in ends if e] + [(k, len(units)) for k in tail]):
            run = sum(units[k:e], ())
            if run in seen:
                gone.update(range(k, e))
            seen.setdefault(run, (i, k))
        out[i] = [b" ".join(u) for k, u in enumerate(units) if k not in gone]
    return out


def test_matches_brute_force(spark):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choices("abcdefgé", k=5)) + r.choice(["", "", "", ",", ".", "!", "\n"]) for _ in range(n))
    shared = [say(60) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [say(r.randint(0, 80)) for _ in range(3)]
        if i % 2:
            parts.insert(r.randint(0, 3), r.choice(shared))
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "few words"), (103, rows[1][1]), (104, "One, two. " * 2000), (200, rows[4][1] + "\n" + rows[4][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, place int")
    want = brute(rows)
    got = remove_repeated_spans(df).collect()
    assert len(got) == len(rows)
    for g in got:
        assert re.sub(rb"\s+", b" ", (g.text or "").encode().lower()).split() == b" ".join(want[g.doc_id]).split(), g.doc_id
    by = {g.doc_id: g for g in got}
    assert by[100].text is None and by[103].text == "" and by[102].text == "few words"
    text = " ".join(g.text or "" for g in got)
    for s in shared:  # of each passage one occurrence is left
        middle = " ".join(s.split()[15:40])
        assert len(re.findall(re.escape(middle), re.sub(r"\s+", " ", text))) == 1


def test_repeated_rows_and_empty(spark):
    t = " ".join(f"w{k} x{k} y{k} z{k}." for k in range(12))
    rows = [(1, t, 0, 0), (1, t, 0, 0), (1, "short text", 0, 0), (None, t, 0, 0), (2, "x y", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, span int, _doc int")
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in remove_repeated_spans(df).collect())
    assert got == [("1", "", 12), ("1", "", 12), ("1", "short text", 0), ("2", "x y", 0), ("None", t, 0)]
    alone = remove_repeated_spans(df.where("doc_id = 1")).collect()
    assert sorted(r.n_removed for r in alone) == [0, 0, 0]
    assert remove_repeated_spans(df.limit(0)).count() == 0


def test_frequent_spans_are_broadcast(spark, monkeypatch):
    import causalspark.llm.spans as module

    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choices("abcdefg", k=5)) for _ in range(n))
    common, rows = say(60), []
    rows = [(i, f"{say(20)} {common} {say(20)}") for i in range(50)]
    rows += [(60, rows[3][1] + " more"), (61, say(50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, remove_repeated_spans(df).collect()))
    monkeypatch.setattr(module, "HOT", 500)
    assert sorted(map(tuple, remove_repeated_spans(df).collect())) == want
    assert sum(n > 0 for _, _, n in want) == 50


def test_passages_without_marks_and_in_scripts_without_blanks(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefg", k=6))
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))
    rows, passages = [], []
    for i in range(40):
        wide = i % 2
        p = han(100) if wide else " ".join(word() for _ in range(51))
        say, gap = (han, "") if wide else (lambda n: " ".join(word() for _ in range(n)), " ")
        passages.append(p)
        rows += [(2 * i, say(30) + gap + p + gap + say(30)), (2 * i + 1, say(25) + gap + p + gap + say(35))]
    rows += [(100, han(40) + "。" + han(9) + "،")]
    got = {g.doc_id: g for g in remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by = dict(rows)
    for i, p in enumerate(passages):
        assert got[2 * i].text == by[2 * i] and got[2 * i].n_removed == 0
        a, b = got[2 * i + 1].text, by[2 * i + 1]
        assert got[2 * i + 1].n_removed >= SPAN and len(b) - len(a) >= LEAST
        k = b.index(p)
        assert a.startswith(b[:k]) and a.endswith(b[k + len(p) :])
    assert got[100].text == by[100]
    ends = sentences("ab؟ cd। 好。好 e", _Powers())
    assert list(ends[0]) == [0, 1, 2, 4, 6] and len(ends[2]) == 6
