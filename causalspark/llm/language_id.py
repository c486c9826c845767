"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector; a letter trigram is the elementwise product of its
letters' vectors, permuted (rolled) by their place; a text is the sum of its trigrams' vectors,
scaled to length one; a language is the mean of its texts' vectors less the mean over all
languages. A text gets the language of largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import forget

DIM = 512
#: Letters are folded into so many classes: 0 is a gap between words, 1-26 are a-z, others hash.
CLASSES = 64


def letter_codes(text: str) -> np.ndarray:
    """Letter classes of the lower-cased text; every run of non-letters is one gap."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _fold(chars)


_TABLE: np.ndarray | None = None


def _table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x3000, dtype=np.uint8)
        for c in range(len(t)):
            ch = chr(c)
            if "a" <= ch <= "z":
                t[c] = c - 96
            elif ch.isalpha():
                t[c] = 27 + (c * 2654435761 >> 7) % (CLASSES - 27)
        _TABLE = t
    return _TABLE


def _fold(chars: np.ndarray) -> np.ndarray:
    t = _table()
    low = chars < len(t)
    if low.all():
        codes = t[chars]
    else:
        codes = np.zeros(len(chars), dtype=np.uint8)
        codes[low] = t[chars[low]]
        for i in np.flatnonzero(~low):
            if chr(chars[i]).isalpha():
                codes[i] = 27 + (int(chars[i]) * 2654435761 >> 7) % (CLASSES - 27)
    gap = codes == 0
    return codes[~(gap & np.concatenate(([False], gap[:-1])))] if len(codes) else codes


def letter_vectors(dim: int = DIM, seed: int = 7) -> np.ndarray:
    """(3, CLASSES, dim): the letters' bipolar vectors rolled by 2, 1 and 0 places."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(CLASSES, dim))
    return np.stack([np.roll(base, s, axis=1) for s in (2, 1, 0)])


#: Trigrams are bundled in pieces of so many, so that a long text needs little memory.
_PIECE = 4096


def text_vector(text: str | None, vectors: np.ndarray) -> np.ndarray | None:
    """Unit vector of a text; None if it is null or has no letter."""
    codes = letter_codes(text) if text else None
    if codes is None or not codes.any():
        return None
    codes = np.concatenate(([0], codes, [0])).astype(np.int32)
    if codes[1] == 0:
        codes = codes[1:]
    if codes[-2] == 0:
        codes = codes[:-1]
    grams = (codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:]
    ids, counts = np.unique(grams, return_counts=True)
    out = np.zeros(vectors.shape[2], dtype=np.float32)
    for at in range(0, len(ids), _PIECE):
        g, n = ids[at : at + _PIECE], counts[at : at + _PIECE].astype(np.float32)
        bound = vectors[0][g // (CLASSES * CLASSES)] * vectors[1][g // CLASSES % CLASSES] * vectors[2][g % CLASSES]
        out += n @ bound.astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def held_out(doc_id):
    """Column: documents whose crc32(doc_id as text) mod 4 is 2 are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit profile of each language in docs, over all rows with a text and a language.

    Each task returns one sum for each language it met, so what reaches the driver is
    languages x DIM numbers after a second sum.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vectors, sums = letter_vectors(), {}
        for b in batches:
            for t, k in zip(b.column(0), b.column(1), strict=True):
                v = text_vector(t.as_py(), vectors)
                if v is not None:
                    key = k.as_py()
                    s = sums.setdefault(key, [np.zeros(DIM), 0])
                    s[0] += v
                    s[1] += 1
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k in keys for _ in range(DIM)], pa.string()),
                pa.array(list(range(DIM)) * len(keys), pa.int32()),
                pa.array(np.concatenate([sums[k][0] for k in keys]) if keys else [], pa.float64()),
                pa.array([sums[k][1] for k in keys for _ in range(DIM)], pa.int64()),
            ],
            names=["lang", "dim", "total", "n"],
        )

    parts = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    sums = (
        parts.mapInArrow(bundle, "lang string, dim int, total double, n long")
        .groupBy("lang", "dim")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    means: dict[str, np.ndarray] = {}
    for r in sums:
        means.setdefault(r["lang"], np.zeros(DIM))[r["dim"]] = r["total"] / r["n"]
    centre = np.mean(list(means.values()), axis=0) if len(means) > 1 else np.zeros(DIM)
    return {k: (v - centre) / (np.linalg.norm(v - centre) or 1.0) for k, v in sorted(means.items())}


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; `und` with score 0 for null texts and texts without a letter.

    Ties go to the language first in alphabetical order; score is the cosine moved to 0..1.
    With no profile (nothing to learn from) every row is `und`.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names], dtype=np.float32) if names else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = letter_vectors()
        for b in batches:
            best, score = [], []
            for t in b.column(1):
                v = text_vector(t.as_py(), vectors) if names else None
                if v is None:
                    best.append("und")
                    score.append(0.0)
                else:
                    cos = matrix @ v
                    k = int(np.argmax(cos))
                    best.append(names[k])
                    score.append(float(min(1.0, max(0.0, (1 + float(cos[k])) / 2))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(predict, f"{id_col} {kind}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Profiles are learned from text and lang of the rows that are not held out. Null and empty
    texts and texts without letters: `und`, score 0. Rows with a null doc_id count as held out
    (their remainder is unknown). Repeated rows give repeated rows. Other columns are ignored.
    """
    profiles = learn_profiles(docs.where(~held_out("doc_id")))
    return predict_language(docs, profiles).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(True)).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is known or can be told; a null lang is filled with the prediction.

    Rejects texts that are null or have no letter. If docs has no row to learn from, texts
    with a letter stay with their null lang.
    """
    profiles = learn_profiles(docs.where(~held_out("doc_id")))
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names], dtype=np.float32) if names else None
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vectors = letter_vectors()
        for b in batches:
            keep, lang = [], []
            for t, old in zip(b.column(text_at), b.column(lang_at), strict=True):
                v = text_vector(t.as_py(), vectors)
                keep.append(v is not None)
                old = old.as_py()
                lang.append(names[int(np.argmax(matrix @ v))] if old is None and names and v is not None else old)
            columns = list(b.columns)
            columns[lang_at] = pa.array(lang, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
