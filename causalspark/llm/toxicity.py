"""Toxicity by classifier chains.

The categories are the 0/1 columns of the labels, predicted one after the other by linear
(logistic) models on word presence and a few measures of format. Each model also sees the
probabilities of the categories before it. In training these are out-of-fold predictions, so
that later models learn from probabilities as uncertain as those that they will meet.

The models are fitted on a bounded sample of labelled rows (TRAIN_ROWS, by a hash of the id);
every document is then scored by its whole text.

Defined results: null and empty texts have no words and are scored so. A document with
several label rows counts as 1 where any of them is; rows with a null label are not learned
from. Without labelled rows of both kinds, a category's probability is its rate. Repeated
rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .minhash import _Powers, word_hashes

#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 20_000
#: Words kept for each category, and how many sampled documents must have them.
WORDS = 384
SEEN = 8
FOLDS = 4
STEPS = 250
PENALTY = 1e-4
PRECISION = 0.98

#: Everything in ASCII but letters separates words here.
_NOT_LETTERS = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])


def _words(text: str | None, powers: _Powers) -> np.ndarray:
    return np.unique(word_hashes(text, powers, _NOT_LETTERS))


def _format(text: str | None) -> list[float]:
    """Shares of capitals, symbols and repeated words, and the scaled length of words."""
    t = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(t, dtype=np.uint8)
    n = max(len(data), 1)
    words = t.split()
    capitals = ((data >= 65) & (data <= 90)).sum() / n
    symbols = ((data > 32) & (data < 128) & _NOT_LETTERS[data] & ((data < 48) | (data > 57))).sum() / n
    return [float(capitals), float(symbols), 1 - len(set(words)) / max(len(words), 1), min(n / max(len(words), 1), 30) / 30]


class Chain:
    """Fitted models: words (sorted hashes), and for each category its weights and threshold."""

    def __init__(self, categories: list[str], words: np.ndarray) -> None:
        self.categories, self.words = categories, words
        self.models: list[np.ndarray] = []
        self.bounds: list[float] = []

    def features(self, texts: list) -> np.ndarray:
        powers = _Powers()
        out = np.zeros((len(texts), len(self.words) + 5), dtype=np.float32)
        for k, t in enumerate(texts):
            w = _words(t, powers)
            at = np.searchsorted(self.words, w)
            at[at == len(self.words)] = 0
            if len(self.words):
                out[k, at[self.words[at] == w]] = 1
            out[k, -5:-1] = _format(t)
        out[:, -1] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), 0), dtype=np.float32)
        for w in self.models:
            z = np.concatenate((x, out), axis=1) @ w
            out = np.concatenate((out, (1 / (1 + np.exp(-np.clip(z, -30, 30))))[:, None].astype(np.float32)), axis=1)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Chain:
        fold = np.arange(len(x)) % FOLDS
        earlier = np.empty((len(x), 0), dtype=np.float32)
        for c in range(y.shape[1]):
            z = np.concatenate((x, earlier), axis=1)
            out_of_fold = np.full(len(x), y[:, c].mean() if len(y) else 0.0, dtype=np.float32)
            for f in range(FOLDS):
                if (fold == f).any() and (fold != f).any():
                    w = _logistic(z[fold != f], y[fold != f, c])
                    out_of_fold[fold == f] = 1 / (1 + np.exp(-np.clip(z[fold == f] @ w, -30, 30)))
            self.models.append(_logistic(z, y[:, c]))
            self.bounds.append(_threshold(out_of_fold, y[:, c]))
            earlier = np.concatenate((earlier, out_of_fold[:, None]), axis=1)
        return self


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by accelerated gradient steps; the constant is not penalised."""
    n, p = x.shape
    w = np.zeros(p, dtype=np.float32)
    if not n:
        return w
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    v = np.ones(p, dtype=np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (float(np.linalg.norm(x.T @ (x @ v))) / (4 * n) * 1.05 + PENALTY)
    penalty = np.full(p, PENALTY, dtype=np.float32)
    constant = np.flatnonzero((x == 1).all(axis=0))
    penalty[constant] = 0
    w[constant[:1]] = np.log(rate / (1 - rate))
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        q = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (q - y).astype(np.float32) / n + penalty * ahead)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = (new + (before - 1) / t * (new - w)).astype(np.float32)
        w = new.astype(np.float32)
    return w


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Lowest out-of-fold probability from which on the precision is PRECISION; that of best F1 if none."""
    order = np.argsort(-p, kind="stable")
    right, every = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    if not len(p) or not right[-1]:
        return 1.1
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero(last & (right >= PRECISION * every))
    best = good[-1] if len(good) and right[good[-1]] >= 0.5 * right[-1] else int(np.argmax(np.where(last, 2 * right / (every + right[-1]), 0)))
    following = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + following) / 2)


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """A chain from at most TRAIN_ROWS labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories]).dropna()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            y = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(categories))], axis=1) if b.num_rows else np.empty((0, len(categories)))
            found = [_words(t.as_py(), powers) for t in b.column(1)]
            words = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
            rows_of = np.repeat(np.arange(len(found)), [len(w) for w in found])
            ids, at = np.unique(words, return_inverse=True)
            sums = [np.bincount(at, weights=y[rows_of, k], minlength=len(ids)).astype(np.int64) for k in range(len(categories))]
            n = np.bincount(at, minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n), *map(pa.array, sums)], names=["w", "n", *categories])

    sizes = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    fields = ", ".join(f"{c} long" for c in categories)
    counts = rows.select("doc_id", "text", *categories).mapInArrow(count, f"w long, n long, {fields}").groupBy("w").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in categories])
    counts = materialize(counts.where(F.col("n") >= SEEN), "toxicity-words")
    words: set[int] = set()
    for c in categories:
        share = (sizes[c] or 0) / max(sizes["n"], 1)
        surprise = F.abs(F.col(c) - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
        words |= {r["w"] for r in counts.orderBy(F.desc(surprise), "w").limit(WORDS).collect()}
    chain = Chain(categories, np.sort(np.array(sorted(words), dtype=np.int64).view(np.uint64)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = chain.features(b.column(1).to_pylist()) if b.num_rows else np.empty((0, 0), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", *categories, "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", *categories).mapInArrow(vectors, f"doc_id {kind}, {', '.join(f'{c} int' for c in categories)}, x binary").toArrow().sort_by("doc_id")
    width = len(chain.words) + 5
    x = np.frombuffer(b"".join(got["x"].to_pylist()), dtype=np.float32).reshape(-1, width)
    y = np.stack([got[c].to_numpy() for c in categories], axis=1).astype(np.float64) if got.num_rows else np.empty((0, len(categories)))
    return chain.fit(x, y)


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last category's decision) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                p = chain.probabilities(chain.features(part.column(1).to_pylist())).astype(np.float64)
                columns = [part.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= chain.bounds[-1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"p_{c}" for c in chain.categories), "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = "".join(f"p_{c} double, " for c in chain.categories)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """Every row of docs scored by a chain over the categories of labels, in this order."""
    return score_toxicity(docs, train_chain(docs, labels, list(categories)))
