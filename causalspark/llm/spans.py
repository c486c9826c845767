"""Substring dedup by sliding sentence spans.

Texts are cut into short sentences: at the ends of sentences and clauses, at line ends, and,
in each GAP words without such an end, after the word of least hash, so that equal passages
are cut alike wherever they stand, but for GAP words at their ends, and no sentence is longer
than GAP words. Every run of SPAN sentences, and of as many more as make LEAST words, is
hashed: of each 50 words, wherever they begin and end, GAP - 1 at most are before the first
cut, and a span of LEAST + GAP - 1 at most follows. Shorter repeats, such as a licence line or
a common phrase, are no copied passage and stay. Characters of scripts without blanks are
words, two of which count as one for LEAST.

All spans are written once. One count finds those that repeat, one aggregation each one's
first occurrence, by doc_id, then text, then place; the sentences that the others cover are
removed. Spans that hold more than 1 / HOT of all occurrences, HOT at most, are joined by
broadcast, so that no task gets the occurrences of a common passage.

Defined results: null texts stay null; texts with too few sentences or words stay as they are.
Rows that share doc_id and text are one occurrence, and stay or lose the same sentences; rows
that share a doc_id only are apart. A null doc_id comes first. A text may become empty. An
empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .minhash import _BYTES, _SPACE, _mix, _Powers

SPAN = 3
#: Words that a span has at least: with GAP - 1 before it and in its last sentence, 50 words hold one.
LEAST = 32
#: In so many words in a row at least one ends a sentence.
GAP = 8
#: A span in more than one of so many occurrences is joined by broadcast; there are no more than these.
HOT = 10_000
_ENDS = np.isin(np.arange(256), list(b".,;:!?"))
#: Other marks that end sentences and clauses, by their last UTF-8 bytes.
_MARKS = np.sort([int.from_bytes(c.encode(), "big") for c in "،؛؟۔։।॥።፣፤፥፧፨။၊។៕…‥、。，．：；！？｡､"])
#: Scripts without blanks: Thai to Tibetan, Myanmar, Khmer, Kana and Han, full and half width.
_ALONE = np.zeros((1 << 16) + (1 << 12), dtype=bool)
for _a, _b in ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3000, 0xA000), (0xF900, 0xFB00), (0xFF00, 0xFFF0)):
    _ALONE[_a:_b] = True


def _words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the text, where words begin and end, whether a word is one character of a script without blanks)."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", dtype=np.uint8)
    edge = np.diff(_SPACE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    lead = np.flatnonzero(data[:-2] >= 0xE0) if len(data) > 2 and data.max() >= 0xE0 else np.empty(0, dtype=np.int64)
    d = data.astype(np.int64) if len(lead) else data
    size = np.where(data[lead] >= 0xF0, 4, 3)
    code = (d[lead] & 15) << 12 | (d[lead + 1] & 63) << 6 | d[lead + 2] & 63 if len(lead) else lead
    # of four bytes, planes 2 and 3 are Han
    alone = np.where(size == 4, (data[lead] == 0xF0) & (data[np.minimum(lead + 1, len(data) - 1)] >= 0xA0), _ALONE[code]) if len(lead) else np.empty(0, dtype=bool)
    lead, size = lead[alone], size[alone]
    if not len(lead):
        return data, starts, ends, np.zeros(len(starts), dtype=bool)
    starts, ends = np.unique(np.concatenate((starts, lead, lead + size))), np.unique(np.concatenate((ends, lead, lead + size)))
    starts = starts[starts < len(data)]
    starts = starts[~_SPACE[data[starts]]]
    ends = ends[ends > 0]
    ends = ends[~_SPACE[data[ends - 1]]]
    return data, starts, ends, np.isin(starts, lead)


def _picked(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the word has the least hash of some GAP words in a row none of which is a last one."""
    n = len(ids) - GAP + 1
    if n < 1:
        return np.zeros(len(ids), dtype=bool)
    least = _runs(ids, np.minimum)
    before = np.concatenate(([0], np.cumsum(last)))
    least[before[GAP:] > before[:-GAP]] = 0
    pad = np.zeros(GAP - 1, dtype=np.uint64)
    return (_runs(np.concatenate((pad, least, pad)), np.maximum) == ids) & (ids > 0)


def _runs(x: np.ndarray, f: np.ufunc) -> np.ndarray:
    """f over each GAP values in a row."""
    have = 1
    while have < GAP:
        step = min(have, GAP - have)
        x, have = f(x[:-step], x[step:]), have + step
    return x


def _cut(text: str | None, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `sentences` gives, and the words before each sentence and in all, as LEAST counts them."""
    data, starts, ends, alone = _words(text)
    if not len(starts):
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.zeros(1)
    up, down = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], dtype=np.uint64, out=sums[1:])
    ids = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    last = _ENDS[data[ends - 1]]
    wide = np.flatnonzero((data[ends - 1] >= 0x80) & (ends > 2))
    if len(wide):
        e = ends[wide]
        two = data[e - 2].astype(np.int64) << 8 | data[e - 1]
        last[wide] = np.isin(two, _MARKS) | np.isin(data[e - 3].astype(np.int64) << 16 | two, _MARKS)
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[-1] = True
    last |= _picked(ids, last)
    first = np.concatenate(([0], np.flatnonzero(last) + 1))
    return first, starts, ids, np.concatenate(([0], np.cumsum(np.where(alone, 0.5, 1.0))))[first]


def sentences(text: str | None, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each sentence and the number of words, byte where each word begins, hashes of words)."""
    return _cut(text, powers)[:3]


def span_hashes(first: np.ndarray, ids: np.ndarray, reach: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, sentences, hash) of every span: from each sentence on, SPAN sentences and as many more as make LEAST words.

    The shortest span that ends with the text is among them, so that none of a copy's sentences is left out.
    """
    n = len(first) - 1
    start = np.arange(n)
    end = np.maximum(start + SPAN, np.searchsorted(reach, reach[:-1] + LEAST))
    tail = min(n - SPAN, int(np.searchsorted(reach, reach[-1] - LEAST, side="right")) - 1)
    if tail >= 0 and reach[-1] >= LEAST:
        start, end = np.append(start, tail), np.append(end, n)
    fits = end <= n
    start, end = start[fits], end[fits]
    if len(start) > 1 and start[-1] <= start[-2] and end[start[-1]] == n:
        start, end = start[:-1], end[:-1]
    up, down = powers.upto(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(ids * up[:-1], dtype=np.uint64, out=sums[1:])
    a, b = first[start], first[end]
    return start, end - start, _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def spans(docs: DataFrame) -> DataFrame:
    """(span, doc_id, h, place, size) of every span; h is a hash of the text, place and size are in sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            rows, places, sizes = ([np.empty(0, np.int64)] for _ in range(3))
            hashes = [np.empty(0, np.uint64)]
            for k, t in enumerate(b.column(2)):
                first, _, ids, reach = _cut(t.as_py(), powers)
                at, size, h = span_hashes(first, ids, reach, powers)
                rows.append(np.full(len(at), k, dtype=np.int64))
                places.append(at)
                sizes.append(size)
                hashes.append(h)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), b.column(0).take(take), b.column(1).take(take), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (places, sizes))],
                names=["span", "doc_id", "h", "place", "size"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"span long, doc_id {kind}, h long, place int, size int")


def without(text: str, covered: list[tuple[int, int]], powers: _Powers) -> tuple[str, int]:
    """The text less the sentences of the spans with these places and sizes, and how many sentences that is."""
    first, starts, _ = sentences(text, powers)
    place, size = np.array(covered, dtype=np.int64).T
    edges = np.zeros(len(first), dtype=np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + size, -1)
    gone = np.cumsum(edges)[:-1] > 0
    data = text.encode("utf-8", "surrogatepass")
    at = np.append(starts[first[:-1]], len(data))
    at[0] = 0
    kept = b"".join(data[at[k] : at[k + 1]] for k in np.flatnonzero(~gone))
    return kept.decode("utf-8", "surrogatepass").strip(), int(gone.sum())


def _of_spans(rows: DataFrame, table: DataFrame, limit: float) -> DataFrame:
    """Inner join on span; table (span, times, ...) has each span once, and those with more than `limit` occurrences are broadcast."""
    hot, cold = table.where(F.col("times") > limit).drop("times"), table.where(F.col("times") <= limit).drop("times")
    return rows.join(F.broadcast(hot), "span").unionByName(rows.join(F.broadcast(hot.select("span")), "span", "left_anti").join(cold, "span"))


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_removed (sentences) of every row of docs."""
    every = materialize(spans(docs), "spans")
    limit = every.count() / HOT
    repeated = materialize(every.groupBy("span").agg(F.count("*").alias("times")).where("times > 1"), "repeated-spans")
    hits = materialize(_of_spans(every, repeated, limit), "span-hits")
    firsts = hits.groupBy("span").agg(F.min(F.struct("doc_id", "h", "place")).alias("first"), F.count("*").alias("times"))
    later = (
        _of_spans(hits, materialize(firsts, "first-spans"), limit)
        .where(~F.struct("doc_id", "h", "place").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"))
        .agg(F.collect_set(F.struct("place", "size")).alias("places"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_h"))
    joined = docs.select("doc_id", "text").join(materialize(later, "later-spans"), same, "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            text, removed = [], []
            for t, p in zip(b.column(1), b.column(2), strict=True):
                t, n = t.as_py(), 0
                if p.is_valid:
                    t, n = without(t, [(x["place"], x["size"]) for x in p.as_py()], powers)
                text.append(t)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text string, n_removed long")
