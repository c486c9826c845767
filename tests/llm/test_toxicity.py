import math
import random
import re

import numpy as np

from causalspark.llm.minhash import _Powers, word_hashes
from causalspark.llm.toxicity import PENALTY, _logistic, score_toxicity, toxicity, train_chain


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(4)
    vocab, bad = ["word%s" % chr(97 + k // 26) + chr(97 + k % 26) for k in range(300)], ["nasty", "vile", "awful"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = r.choices(vocab, k=r.randint(20, 200))
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", ",", "!"]))
        docs.append((i, " ".join(w), 0))
        if i < 600:
            labels.append((i, int(i % 2), int(toxic)))
    labels += [(3, 0, 0), (None, 1, 1), (5, None, 1), (99999, 1, 1)]
    docs += [(2000, None, 0), (2001, "", 0), (2002, "fine words " * 20000, 0), (2003, "nasty vile " * 20000, 0), (1, docs[1][1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity(df, lb).collect()
    assert len(got) == len(docs)
    by = {g.doc_id: g for g in got}
    test = [(by[i].toxic, i % 5 == 0) for i in range(600, 900)]
    assert sum(a == b for a, b in test) >= 0.97 * len(test) and not any(a and not b for a, b in test)
    assert not by[2000].toxic and not by[2002].toxic and by[2003].toxic and 0 <= by[2000].p_toxic <= 1
    assert toxicity(df.limit(0), lb).count() == 0
    assert not any(g.toxic for g in toxicity(df, lb.limit(0)).collect())


def test_scores_match_plain_loops(spark):
    """Every probability from words and format, weight by weight, one category feeding the next."""
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["Calm", "kind", "plain", "Rude,", "vile!", "x1y", "naïve"]) for _ in range(n))
    docs = [(i, say(r.randint(1, 60)), 0) for i in range(240)] + [(900, None, 0), (901, "", 0), (902, "vile " * 3000, 0)]
    labels = [(i, int("kind" in t), int("vile" in t)) for i, t, _ in docs[:200]]
    df, lb = spark.createDataFrame(docs, "doc_id long, text string, x int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = train_chain(df, lb, ["quality", "toxic"])
    known, powers = {int(w): k for k, w in enumerate(chain.words)}, _Powers()
    got = {g.doc_id: g for g in score_toxicity(df, chain).collect()}
    assert len(chain.words) >= 5
    for i, t, _ in docs:
        t = t or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        words = set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        hit = {known[int(h)] for w in words for h in word_hashes(w, powers) if int(h) in known}
        data, parts = t.encode(), t.split()
        n = max(len(data), 1)
        form = [
            sum(65 <= b <= 90 for b in data) / n,
            sum(32 < b < 128 and not chr(b).isalnum() for b in data) / n,
            1 - len(set(parts)) / max(len(parts), 1),
            min(n / max(len(parts), 1), 30) / 30,
        ]
        before = []
        for c, w in zip(("quality", "toxic"), chain.models, strict=True):
            m = len(chain.words)
            z = sum(float(w[k]) for k in hit) + sum(float(a) * b for a, b in zip(w[m : m + 4], form)) + float(w[m + 4]) + sum(float(a) * b for a, b in zip(w[m + 5 :], before))
            before.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            assert abs(got[i][f"p_{c}"] - before[-1]) < 1e-4, (i, c)
        assert got[i].toxic == (got[i].p_toxic >= chain.bounds[-1])


def test_logistic_models_are_at_their_optimum():
    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=(400, 3)), np.ones((400, 1))), axis=1).astype(np.float32)
    y = (r.random(400) < 1 / (1 + np.exp(-(x @ np.array([1.0, -2.0, 0.0, 0.5]))))).astype(float)
    w = _logistic(x, y).astype(float)
    slope = x.T.astype(float) @ (1 / (1 + np.exp(-(x @ w))) - y) / 400 + PENALTY * np.append(w[:3], 0)
    assert np.abs(slope).max() < 1e-4
