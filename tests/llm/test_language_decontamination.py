import importlib
import re
import zlib

import pytest

from causalspark.llm.decontaminate import contamination, decontaminate
from causalspark.llm.language_id import keep_identified, language_id

decontaminate_module = importlib.import_module("causalspark.llm.decontaminate")

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - 12, 1) if w else 0):
            wins.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, its = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    its |= wins[x]
        out.append((i, len(w), len(hit), sorted(its), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_contamination_matches_brute_force(spark, monkeypatch, sent):
    """With windows sent to all executors, and joined by a shuffle."""
    monkeypatch.setattr(decontaminate_module, "BROADCAST_ROWS", sent)
    long = " ".join("tok%d" % k for k in range(30))
    items = [(1, long), (2, "Short Item-here"), (3, None), (4, "..."), (5, " ".join("tok%d" % k for k in range(5, 25))), (6, "same same same same"), (7, "naïve É 東京")]
    docs = [
        (1, "x " * 20 + long + " y"), (2, "a short, ITEM here b " + "w " * 90), (3, None), (4, ""), (5, " ".join("tok%d" % k for k in range(12))), (6, "same " * 40),
        (7, "naïve É 東京 z"), (8, "tok12 tok13 " * 30), (9, long[: len(long) // 2] + " q " + long), (1, "other text with id one"), (10, "short item " * 5000 + "here"), (11, "naïve é 東京"),
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = contamination(df, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=str) == brute(docs, items)
    clean = decontaminate(df, bench)
    assert sorted(map(str, (r.text for r in clean.collect()))) == sorted(str(t) for (i, t), b in ((d, brute([d], items)[0]) for d in docs) if not b[4])
    assert contamination(df.limit(0), bench).count() == 0 and not contamination(df, bench.limit(0)).where("contaminated or n_hit > 0").count()


SAYINGS = {"en": "the quick brown fox jumps over the lazy dog and then runs with the wind through that field", "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann durch das große feld", "fr": "le renard brun rapide saute par dessus le chien paresseux et court après dans les champs"}


def test_language_held_out_and_und(spark):
    rows = []
    for i in range(300):
        lang = ["en", "de", "fr"][i % 3]
        w = SAYINGS[lang].split()
        rows.append((i, " ".join(w[(i * 7 + k * 5) % len(w)] for k in range(12)), lang))
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (1003, "und der hund springt über das feld", None), (1003, "und der hund springt über das feld", None), (1004, "le chien " * 20000, "fr")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = language_id(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1003].lang_pred == "de" and by[1004].lang_pred == "fr"
    held = [(by[i].lang_pred, lang) for i, _, lang in rows[:300] if by[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    kept = keep_identified(df).collect()
    assert len(kept) == len(rows) - 3 and {r.lang for r in kept if r.doc_id == 1003} == {"de"}
    assert language_id(df.limit(0)).count() == 0


def test_profiles_match_plain_loops(spark):
    """Predictions and scores of a small table against letter by letter sums."""
    import numpy as np

    from causalspark.llm.language_id import CLASSES, DIM, held_out, language_id

    texts = ["the cat sat on the mat", "el gato come pan y vino", "Der Hund läuft über die Straße", "le chat boit du lait", "THE dog and the cat!", "el perro y el gato", "die Katze und der Hund", "123", None, "", "x", "日本 the"]
    rows = [(i, texts[i % len(texts)] if texts[i % len(texts)] is None else texts[i % len(texts)] + " " * (i % 3), ["en", "es", "de", "fr", "en", "es", "de", None, "en", "en", None, "en"][i % len(texts)]) for i in range(96)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    held = {r.doc_id: r.h for r in docs.select("doc_id", held_out("doc_id").alias("h")).collect()}
    base = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.int8), size=(CLASSES, DIM)).astype(float)

    def code(c: str) -> int:
        if "a" <= c <= "z":
            return ord(c) - 96
        return 27 + (ord(c) * 2654435761 >> 7) % (CLASSES - 27) if c.isalpha() else 0

    def vector(t):
        codes = [0]
        for c in (t or "").lower():
            if code(c) or codes[-1]:
                codes.append(code(c))
        if not any(codes):
            return None
        codes += [0] if codes[-1] else []
        out = np.zeros(DIM)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            out += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
        return out / np.linalg.norm(out)

    sums = {}
    for i, t, lang in rows:
        v = vector(t)
        if not held[i] and lang and v is not None:
            s = sums.setdefault(lang, [np.zeros(DIM), 0])
            s[0] += v
            s[1] += 1
    means = {k: a / n for k, (a, n) in sums.items()}
    centre = np.mean(list(means.values()), axis=0)
    profiles = {k: (m - centre) / np.linalg.norm(m - centre) for k, m in sorted(means.items())}
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        v, r = vector(t), got[i]
        cos = {k: float(p @ v) for k, p in profiles.items()} if v is not None else {}
        assert r.held_out == held[i]
        if not cos:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert abs(r.score - min(1.0, max(0.0, (1 + max(cos.values())) / 2))) < 1e-5
            assert cos[r.lang_pred] > max(cos.values()) - 1e-5
