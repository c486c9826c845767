"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(256 * x). PIVOTS vectors, each as far as possible from the span
of those before it, are the pivots. The table holds every vector's distances to all pivots, in
the equivalent form of its place in their span and its distance from it. From these follows
the largest lower bound on a distance, and upper bound on a product, that the distances to all
pivots allow together: product of the places plus product of the distances from the span. It
is never worse than the triangle inequality at any single pivot.

A query's best products with a sample of candidates give it a first threshold. Queries and
candidates are then packed in blocks, and each part of the candidates meets each block of
queries in a Cartesian product, which copies neither. In a block a query evaluates its STEP
candidates of highest bounds, which may raise the threshold, and then all others whose bounds
reach it, ties included. The threshold stays for the part's later blocks, and the part returns
a query's k best only; those of all parts meet in the end. Of equal vectors the k + 1 smallest
ids go on, which is all that a query can return of them.

The driver gets the sample and no more, whatever the number of vectors and partitions. The
number of pairs of blocks grows with queries times candidates, memory and disk do not.

Defined results: rows with a null id or vector, or a null or non-finite component, take no
part. Rows that repeat an id and vector are one; an id with two vectors has both. Ties go to
the smaller id. Shorter vectors, empty ones too, count as if filled up with zeros. A component
or score beyond a long is the nearest long. Empty tables give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize

PIVOTS = 48
#: Vectors, by hash, among which pivots are chosen and first thresholds found; results do not depend on it.
SAMPLE = 4096
#: Candidates and queries of a block, at most, and bytes of its vectors.
BLOCK = 4096
ASKED = 16384
BLOCK_BYTES = 2**24
#: Queries of a block whose bounds are held at once.
CHUNK = 256
#: Candidates by highest bound that are evaluated first.
STEP = 64
#: Products that are evaluated at once.
AT_ONCE = 16384
#: Blocks of candidates in a part, if that leaves each core enough parts.
PART = 32
LEAST = -(2**63)


def integer_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v): floor(256 * component), as doubles, of the rows that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))
        .distinct()
    )


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row for each vector, filled up with zeros."""
    flat, lengths = vectors.flatten().to_numpy(), np.diff(vectors.offsets.to_numpy())
    if (lengths == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _top(a: np.ndarray) -> float:
    return max(float(a.max(initial=0)), -float(a.min(initial=0)))  # the absolute value of the least long is no long


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: in doubles where these hold them."""
    top = _top(a) * _top(b) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, 2**63 - 1).astype(np.int64)


def choose_pivots(vectors: np.ndarray, most: int) -> np.ndarray:
    """An orthonormal basis (columns) of the span of up to so many of the vectors, each the farthest from the span of those before."""
    rest = vectors.astype(np.float64)
    first = np.sqrt((rest**2).sum(axis=1)).max(initial=0)
    basis = np.empty((vectors.shape[1], 0))
    while basis.shape[1] < min(most, vectors.shape[1]) and len(rest):
        size = np.sqrt((rest**2).sum(axis=1))
        far = int(size.argmax())
        if size[far] <= 1e-9 * first:
            break
        one = rest[far] / size[far]
        one -= basis @ (basis.T @ one)  # what rounding left
        one /= np.sqrt(one @ one)
        basis = np.concatenate((basis, one[:, None]), axis=1)
        rest -= np.outer(rest @ one, one)
    return basis


def pivot_rows(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of the table: place in the pivots' span and, last, distance from it."""
    x = vectors.astype(np.float64)
    place = x @ basis
    off = np.sqrt(np.maximum((x**2).sum(axis=1) - (place**2).sum(axis=1), 0))
    return np.concatenate((place, off[:, None]), axis=1).astype(np.float32)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row, the least long where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), LEAST, dtype=np.int64)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


class Candidates:
    """A block of candidates: distinct vectors, their rows of the table, and the ids of each, `many` of them, in a row."""

    def __init__(self, ids: np.ndarray, many: np.ndarray, vectors: np.ndarray, table: np.ndarray):
        self.ids, self.many, self.vectors = ids, many, vectors
        self.first = np.cumsum(many) - many
        self.only = np.where(many == 1, ids[self.first], -1) if len(many) else ids
        self.single = many == 1
        self.top = np.sqrt((table.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
        self.across = np.ascontiguousarray(table.T)

        self.as_floats: dict[type, np.ndarray] = {}

    def floats(self, kind: type) -> np.ndarray:
        if kind not in self.as_floats:
            self.as_floats[kind] = self.vectors.astype(kind)
        return self.as_floats[kind]

    def others(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether these candidates have an id beside those given."""
        return ~(self.single[rows] & (self.only[rows] == own))


class Questions:
    """A block of queries with their thresholds `least` and their k best so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.vectors, self.table, self.least, self.k = ids, vectors, table, least.copy(), k
        self.size = np.sqrt((table.astype(np.float64) ** 2).sum(axis=1))
        none = np.empty(0, dtype=np.int64)
        self.best = [(none, none, none)] * -(-len(ids) // CHUNK)  # (query in its chunk, id, score)
        self.evaluated = 0

    def _scores(self, c: Candidates, start: int, qi: np.ndarray, cj: np.ndarray) -> np.ndarray:
        """The products of these pairs, those of a query in a row."""
        self.evaluated += len(qi)
        # sums of integers are exact in floats that hold all up to the product of the lengths, which bounds the sum of absolute terms
        largest = 1.01 * self.size[start : start + CHUNK].max() * c.top
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else None
        out, edges = np.empty(len(qi), dtype=np.int64), [0, *(np.flatnonzero(np.diff(qi)) + 1).tolist(), len(qi)]
        mine = self.vectors[start : start + CHUNK].astype(kind) if kind else None
        for a, b in zip(edges, edges[1:], strict=False):
            i = qi[a] if a < b else 0
            out[a:b] = c.floats(kind)[cj[a:b]] @ mine[i] if kind else _products(c.vectors[cj[a:b]], self.vectors[start + i : start + i + 1])[:, 0]
        return out

    def _keep(self, c: Candidates, start: int, qi: np.ndarray, cj: np.ndarray, score: np.ndarray) -> None:
        """Put these among the best of a chunk and raise its thresholds."""
        near = score >= self.least[start + qi]
        if not near.any():
            return
        qi, cj, score = qi[near], cj[near], score[near]
        many = c.many[cj]
        at = np.repeat(c.first[cj] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        qi, ids, score = np.repeat(qi, many), c.ids[at], np.repeat(score, many)
        other = ids != self.ids[start + qi]
        qi, ids, score = (np.concatenate((old, new[other])) for old, new in zip(self.best[start // CHUNK], (qi, ids, score), strict=True))
        order = np.lexsort((ids, ~score, qi))  # ~ turns the order round without overflow
        qi, ids, score = qi[order], ids[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        last = rank == self.k - 1
        self.least[start + qi[last]] = np.maximum(self.least[start + qi[last]], score[last])
        self.best[start // CHUNK] = tuple(x[rank < self.k] for x in (qi, ids, score))

    def _floor(self, part: slice, kind: type) -> np.ndarray:
        least = self.least[part]
        return np.where(least == LEAST, -np.inf, least.astype(np.float64)).astype(kind)[:, None]  # scores below the least long count as it

    def meet(self, c: Candidates) -> None:
        """Search a block of candidates."""
        for start in range(0, len(self.ids), CHUNK):
            part = slice(start, start + CHUNK)
            own, size = self.ids[part], self.size[part]
            kind = np.float32 if size.max(initial=0) * c.top < 1e30 else np.float64
            bound = self.table[part].astype(kind) @ c.across.astype(kind, copy=False)
            bound += (1e-5 * size * c.top + 1).astype(kind)[:, None]  # rounding

            may = bound >= self._floor(part, kind)
            much = np.flatnonzero(np.count_nonzero(may, axis=1) > STEP)
            if len(much):
                first = np.argpartition(-bound[much], STEP, axis=1)[:, :STEP]
                for at in range(0, len(much), max(AT_ONCE // STEP, 1)):
                    some = much[at : at + max(AT_ONCE // STEP, 1)]
                    qi, cj = np.repeat(some, STEP), first[at : at + len(some)].ravel()
                    score = self._scores(c, start, qi, cj)
                    counted = np.where(c.others(cj, own[qi]), score, LEAST).reshape(len(some), STEP)
                    self.least[start + some] = np.maximum(self.least[start + some], _kth(counted, self.k))
                    self._keep(c, start, qi, cj, score)
                    may[qi, cj] = False
                may &= bound >= self._floor(part, kind)
            qi, cj = np.divmod(np.flatnonzero(may), may.shape[1])
            for at in range(0, len(qi), AT_ONCE):
                i, j = qi[at : at + AT_ONCE], cj[at : at + AT_ONCE]
                self._keep(c, start, i, j, self._scores(c, start, i, j))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score), each query's in their order."""
        rows = [(self.ids[n * CHUNK + qi], ids, score) for n, (qi, ids, score) in enumerate(self.best)]
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def search_block(q_ids, q, q_table, least, c_ids, c, c_table, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """([(query, id, score)], evaluations): each query's k best of a block that reach its threshold `least`.

    c_ids: the ids of each candidate vector.
    """
    asked = Questions(np.array(q_ids, dtype=np.int64), q, q_table, np.array(least, dtype=np.int64), k)
    asked.meet(Candidates(np.array([x for ids in c_ids for x in ids], dtype=np.int64), np.array([len(ids) for ids in c_ids]), c, c_table))
    return list(zip(*(x.tolist() for x in asked.found()), strict=True)), asked.evaluated


def sample_of(classes: DataFrame, n: int) -> list:
    """The SAMPLE rows of smallest hashes among n distinct vectors.

    Rows whose hashes are far above those are left out where they lie, as the sort returns up
    to SAMPLE rows of each partition to the driver.
    """
    h = F.xxhash64("v")
    if 2 * SAMPLE < n:
        below = LEAST + 2 * SAMPLE * 2**64 // n  # twice as many as wanted are below
        near = classes.where(h < below).orderBy(h, "v").limit(SAMPLE).collect()
        if near:
            return near
    return classes.orderBy(h, "v").limit(SAMPLE).collect()


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of this size, the last one smaller."""
    held, rows = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            held.append(b.slice(at, size - rows))
            rows += held[-1].num_rows
            at += held[-1].num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _column(b: pa.RecordBatch, row: int, name: str, kind: type = np.int64) -> np.ndarray:
    """What `tobytes` made of an array."""
    return np.frombuffer(b[name][row].as_buffer(), dtype=kind)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, v) the k best of vectors (vec_id, v), itself excluded."""
    spark = vectors.sparkSession
    of = W.partitionBy("v").orderBy("vec_id")
    # the row-number filter is applied before the shuffle too, so that a frequent vector is not gathered
    few = vectors.withColumn("n", F.row_number().over(of)).where(F.col("n") <= k + 1)
    classes = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "topk-classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    questions = materialize(queries.select("vec_id", "v"), "topk-queries")
    m, wide = questions.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not m:
        return spark.createDataFrame([], T._parse_datatype_string("query_id long, rank int, vec_id long, score long"))
    width = max(width, wide, 1)
    block, ask = (max(1, min(rows, BLOCK_BYTES // (8 * width))) for rows in (BLOCK, ASKED))
    drawn = sample_of(classes.select("v", "ids"), n)
    sample = _matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.int64())), width)
    only, single = np.array([r["ids"][0] for r in drawn]), np.array([len(r["ids"]) == 1 for r in drawn])
    basis = choose_pivots(sample, PIVOTS)
    binary = lambda *columns: [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in columns]

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, block):
            ids, c = t["ids"].combine_chunks(), _matrix(t["v"].combine_chunks(), width)
            yield pa.RecordBatch.from_arrays(binary(ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()).astype(np.int64), c, pivot_rows(c, basis)), names=["c_ids", "c_many", "c", "c_rows"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, ask):
            ids, q = t["vec_id"].combine_chunks().to_numpy(), _matrix(t["v"].combine_chunks(), width)
            least = []
            for at in range(0, len(q), CHUNK):
                score = _products(q[at : at + CHUNK], sample)
                score[single & (only == ids[at : at + CHUNK, None])] = LEAST  # the query's own
                least.append(_kth(score, k))
            yield pa.RecordBatch.from_arrays(binary(ids, q, pivot_rows(q, basis), np.concatenate(least)), names=["q_ids", "q", "q_rows", "least"])

    c_blocks, q_blocks = -(-n // block), -(-m // ask)
    parts = max(min(c_blocks, 4 * spark.sparkContext.defaultParallelism), c_blocks // PART)
    left = classes.select("ids", "v").mapInArrow(tabled, "c_ids binary, c_many binary, c binary, c_rows binary").repartition(parts)
    right = questions.coalesce(q_blocks).mapInArrow(asked, "q_ids binary, q binary, q_rows binary, least binary").withColumn("q_block", F.monotonically_increasing_id()).repartition(q_blocks)
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    places = basis.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, Questions] = {}
        for b in batches:
            for i, q_block in enumerate(b["q_block"].to_pylist()):
                if q_block not in met:
                    q, rows = _column(b, i, "q").reshape(-1, width), _column(b, i, "q_rows", np.float32).reshape(-1, places)
                    met[q_block] = Questions(_column(b, i, "q_ids").copy(), q.copy(), rows.copy(), _column(b, i, "least"), k)  # the batch goes
                c, rows = _column(b, i, "c").reshape(-1, width), _column(b, i, "c_rows", np.float32).reshape(-1, places)
                met[q_block].meet(Candidates(_column(b, i, "c_ids"), _column(b, i, "c_many"), c, rows))
        for one in met.values():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in one.found()], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
