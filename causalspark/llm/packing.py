"""Packing by cutting-stock column generation.

Every document's ids are cut into whole sequences, a body of a multiple of UNIT ids and a
tail of under UNIT. The driver sees the histogram of piece lengths only: at most
CAPACITY / UNIT + UNIT rows. A linear program over patterns (how many pieces of each length
fill a sequence) is solved by column generation: a knapsack dynamic programme prices new
patterns with the program's dual values. Pattern counts are rounded down; the few pieces left
over are packed first-fit decreasing. Pieces are ranked within their length, and rank and
pattern together give each its sequence and offset.

Defined results: a null or empty text is the end-of-text id alone. Repeated rows are packed
each for itself. An empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize
from .tokens import REMEMBERED, default_tokenizer, encoder

CAPACITY = 4096
UNIT = 32
#: Each length's ranks are counted in parts, so that no length is one task's work: so many at
#: least, and as many as keep a part under this number of pieces.
PARTS = 64
PART_ROWS = 500_000
ITERATIONS = 5000


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity."""
    order = np.argsort(sizes)
    size, value = sizes[order], values[order]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], e = best[c - 1], ends[c]
        if e:
            gain = best[c - size[:e]] + value[:e]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], took[c] = gain[k], k
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[order[took[c]]] += 1
            c -= int(size[took[c]])
    return float(best[capacity]), out


def cutting_stock(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern: size to multiplicity, times)], which together hold each size as often as the histogram says."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.float64)
    m = len(sizes)
    patterns = np.diag((capacity // sizes).astype(np.float64))  # a column for each basic variable
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    for step in range(ITERATIONS):
        if step % 200 == 199:  # rounding errors
            inverse = np.linalg.inv(patterns)
            x = np.maximum(inverse @ demand, 0)
        value, column = _best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        rows = np.flatnonzero(direction > 1e-9)
        leave = rows[np.argmin(x[rows] / direction[rows])]
        t = x[leave] / direction[leave]
        x = np.maximum(x - t * direction, 0)
        x[leave] = t
        patterns[:, leave] = column
        inverse[leave] /= direction[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(direction[others], inverse[leave])
    out, left = [], demand.astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        pattern = patterns[:, k].astype(np.int64)
        use = pattern > 0
        times = int(min(np.floor(x[k] + 1e-9), (left[use] // pattern[use]).min()))
        if times > 0:
            out.append(({int(s): int(a) for s, a in zip(sizes[use], pattern[use], strict=True)}, times))
            left = left - times * pattern
    return out + _first_fit(sizes, left, capacity)


def _first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    bins: list[tuple[int, dict[int, int]]] = []
    for s, n in sorted(zip(sizes.tolist(), left.tolist(), strict=True), reverse=True):
        while n:
            for k, (room, held) in enumerate(bins):
                if room >= s:
                    fit = min(n, room // s)
                    held[s] = held.get(s, 0) + fit
                    bins[k] = (room - fit * s, held)
                    n -= fit
                    break
            else:
                bins.append((capacity, {}))
    return [(held, 1) for _, held in bins]


def _cuts(length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    at = length - length % CAPACITY
    out = [(s, CAPACITY) for s in range(0, at, CAPACITY)]
    body = (length - at) // UNIT * UNIT
    if body:
        out.append((at, body))
    if length - at - body:
        out.append((at + body, length - at - body))
    return out


def pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, remembered)
        for b in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for k, t in enumerate(b.column(1)):
                data = enc.encode(t.as_py())
                for s, n in _cuts(len(data) // 4):
                    part = data[4 * s : 4 * (s + n)]
                    rows.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
                    ids.append(part if with_ids else None)
            columns = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            columns += [pa.array(ids, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _plan(histogram: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, first sequence, pieces in a sequence, offset), by first rank."""
    bodies = cutting_stock({n // UNIT: k for n, k in histogram.items() if n % UNIT == 0}, CAPACITY // UNIT)
    tails = cutting_stock({n: k for n, k in histogram.items() if n % UNIT}, CAPACITY)
    ranks = dict.fromkeys(histogram, 0)
    slots: dict[int, list] = {n: [] for n in histogram}
    sequence = 0
    for unit, patterns in ((UNIT, bodies), (1, tails)):
        for pattern, times in patterns:
            offset = 0
            for size, many in sorted(pattern.items(), reverse=True):
                n = size * unit
                slots[n].append((ranks[n], sequence, many, offset))
                ranks[n] += times * many
                offset += many * n
            sequence += times
    assert ranks == histogram, "the patterns hold another number of pieces than there are"
    return {n: np.array(s, dtype=np.int64) for n, s in slots.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    remembered: words whose ids a Python worker keeps, which saves time and takes some 400 bytes each.
    """
    cut = materialize(pieces(docs, tokenizer or default_tokenizer(), with_ids, remembered), "pieces")
    parts = max(PARTS, -(-cut.count() // PART_ROWS))
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = sorted(tuple(r) for r in salted.groupBy("length", "part").agg(F.count("*")).collect())
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for length, part, n in counts:
        first[length, part] = histogram.get(length, 0)
        histogram[length] = first[length, part] + n
    plan = _plan(histogram)
    order = W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(order))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "part", "rank"))
            sequence, offset = np.zeros((2, b.num_rows), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                k = np.array([first[int(n), int(p)] for p in part[at]], dtype=np.int64) + rank[at] - 1
                s = plan[int(n)][np.searchsorted(plan[int(n)][:, 0], k, side="right") - 1]
                sequence[at] = s[:, 1] + (k - s[:, 0]) // s[:, 2]
                offset[at] = s[:, 3] + (k - s[:, 0]) % s[:, 2] * n
            keep = [c for c in b.schema.names if c not in ("part", "rank")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, padding: int = 0) -> DataFrame:
    """(sequence_id, ids binary): the packed ids as little-endian unsigned 32-bit numbers.

    Sequences are padded to CAPACITY, but those as long as a power of two stay as they are.
    """
    pad = padding.to_bytes(4, "little")

    def fill(ids: bytes) -> bytes:
        n = len(ids) // 4
        return ids if n & (n - 1) == 0 else ids + pad * (CAPACITY - n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fill(b"".join(x["ids"] for x in s)) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["sequence_id", "ids"])

    grouped = pack(docs, tokenizer, True).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(run, "sequence_id long, ids binary")
