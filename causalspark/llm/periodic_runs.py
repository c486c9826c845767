"""Periodic runs of words by online dyadic square catching.

Words are appended to a `SquareCatcher`. On each level k it keeps a catcher for every completed
block of b = 2**k words. A catcher waits for its block to come again 2 * b to 4 * b words later
(1 to 3 words on the lowest level), so each appended word ends one window of b words a level,
which is compared with two live catchers. A match is carried on by comparing what comes before
block and copy, and then each word that is appended; as soon as a whole period matches, it is
a square. Squares of one period that touch are one run. Every square of period q starts within
b words of a block of the level with 2 * b <= q < 4 * b that is caught with it: none is missed.

A run keeps its smallest period: what a smaller period of a run found before explains is not
followed. Windows are compared by hashes; every match is checked word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words compared in one step, and words of texts that share a catcher: they bound memory only.
CELLS = 1 << 20
TOGETHER = 1 << 17


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + y
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype) -> None:
        self.data, self.n = np.empty(16, dtype=dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.resize(self.data, max(2 * len(self.data), self.n + len(more)))
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.data[: self.n]


class SquareCatcher:
    """Finds the maximal runs (start, end, period) of two periods or more in a growing sequence of word numbers."""

    def __init__(self, longest: int | None = None) -> None:
        """longest: no period is above half of this."""
        self.longest = longest
        self.words = _Column(np.int64)
        self.windows: list[_Column] = []  # by level: the hash of the window that starts at each word
        self.runs: dict[tuple[int, int], int] = {}  # (start, period) to end, as far as words are there
        self.open: list[tuple[int, int]] = []  # (start, period) of matches that reach the last word
        self.pending: dict[tuple[int, int], int] = {}  # ends of those that are no square yet

    def append(self, more: np.ndarray | list[int]) -> None:
        """Append words; runs are then those of all words so far."""
        self.words.extend(np.asarray(more, dtype=np.int64))
        self._advance()
        level = 0
        while self._level(level):
            level += 1

    def found(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of the runs of the words so far, each with its smallest period."""
        best: dict[tuple[int, int], int] = {}
        for (start, period), end in self.runs.items():
            best[start, end] = min(period, best.get((start, end), period))
        return sorted((s, e, q) for (s, e), q in best.items())

    def _advance(self) -> None:
        """Carry on what reached the last word before."""
        waiting, self.open = self.open, []
        w = self.words.values
        for start, period in waiting:
            end = self.runs.get((start, period))
            at = end if end is not None else self.pending.pop((start, period))
            while at < len(w) and w[at] == w[at - period]:
                step = min(CELLS, len(w) - at)
                same = w[at : at + step] == w[at - period : at - period + step]
                at += step if same.all() else int(same.argmin())
            self._note(start, at, period)

    def _note(self, start: int, end: int, period: int) -> None:
        if end - start >= 2 * period:
            self.runs[start, period] = end
        elif end == self.words.n:
            self.pending[start, period] = end
        if end == self.words.n:
            self.open.append((start, period))

    def _level(self, level: int) -> bool:
        """Compare the windows that the appended words end with the catchers of this level; whether there are such windows."""
        b, w = 1 << level, self.words.values
        near = 1 if level == 0 else 2 * b  # the smallest period
        if len(w) < 2 * near or (self.longest is not None and self.longest < 2 * near):
            return False
        if level == len(self.windows):
            self.windows.append(_Column(np.uint64))
        hashes = self.windows[level]
        old, new = hashes.n, len(w) - b + 1
        if level == 0:
            hashes.extend(_mixed(w[old:new].astype(np.uint64), np.uint64(1)))
        else:
            half = self.windows[level - 1].values
            hashes.extend(_mixed(half[old:new], half[old + b // 2 : new + b // 2]))
        h = hashes.values
        for at in range(old, new, CELLS):
            i = np.arange(max(at, near), min(at + CELLS, new))
            places, blocks = [], []
            for back in (1, 2, 3) if level == 0 else (0, 1):
                s = i - back if level == 0 else ((i - near) // b - back) * b
                fit = (s >= 0) & (h[i] == h[s])
                places.append(i[fit])
                blocks.append(s[fit])
            s = np.concatenate(blocks)
            if len(s):
                self._follow(s, np.concatenate(places) - s, b)
        return True

    def _follow(self, s: np.ndarray, p: np.ndarray, b: int) -> None:
        """Extend matches of the blocks at s with what is p words later."""
        w = self.words.values
        new = ~self._explained(s, p, b)
        s, p = s[new], p[new]
        order = np.lexsort((s, p))
        s, p = s[order], p[order]
        # blocks that follow each other with one period are one match
        first = np.ones(len(s), dtype=bool)
        first[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + b)
        last = np.concatenate((first[1:], [True])) if len(s) else first
        start, end, p = s[first], s[last] + b, p[first]
        rows = max(CELLS // b, 1)
        for k in range(0, len(start), rows):
            x, y, q = start[k : k + rows], end[k : k + rows], p[k : k + rows]
            left, right = self._equal(x, q, b, -1), self._equal(y, q, b, 1)
            for s1, e1, q1 in zip((x - left).tolist(), (y + right + q).tolist(), q.tolist(), strict=True):
                if (s1, q1) not in self.runs and (s1, q1) not in self.pending and np.array_equal(w[s1 : e1 - q1], w[s1 + q1 : e1]):
                    self._note(s1, e1, q1)

    def _equal(self, at: np.ndarray, p: np.ndarray, b: int, way: int) -> np.ndarray:
        """How many words before (or from) each place equal those p later."""
        w = self.words.values
        out, todo = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
        steps = np.arange(b) if way > 0 else -1 - np.arange(b)
        while len(todo):
            x = (at[todo] + way * out[todo])[:, None] + steps
            y = x + p[todo, None]
            inside = (x >= 0) & (y < len(w))
            differ = ~inside | (w[np.where(inside, x, 0)] != w[np.where(inside, y, 0)])
            some = differ.any(axis=1)
            out[todo] += np.where(some, differ.argmax(axis=1), b)
            todo = todo[~some]
        return out

    def _explained(self, s: np.ndarray, p: np.ndarray, b: int) -> np.ndarray:
        """Matches within a run found before whose period divides p."""
        out = np.zeros(len(s), dtype=bool)
        long = [(e, x, q) for (x, q), e in self.runs.items() if e - x >= 2 * b]
        if not long:
            return out
        reach, period = np.zeros(self.words.n, dtype=np.int64), np.ones(self.words.n, dtype=np.int64)
        for e, x, q in sorted(long, key=lambda r: (r[0], -r[2])):
            reach[x:e], period[x:e] = e, q
        return (reach[s] >= s + p + b) & (p % period[s] == 0)


def runs_of(words: list, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of so many periods or more, by start and period."""
    numbers: dict = {}
    catcher = SquareCatcher(len(words))
    catcher.append([numbers.setdefault(x, len(numbers)) for x in words])
    return [(s, e - s, q) for s, e, q in catcher.found() if e - s >= least * q]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, with a repeated stretch up to the end for one id in ten."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of several lists of words, of two periods or more."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = [k for k in np.argsort(-sizes, kind="stable").tolist() if sizes[k] > 1]
    at = 0
    while at < len(order):
        # texts of like sizes share a catcher; a number of its own ends each, so that nothing repeats across
        group, total = [], 0
        while at < len(order) and (not group or total + sizes[order[at]] <= TOGETHER):
            group.append(order[at])
            total += int(sizes[order[at]]) + 1
            at += 1
        flat = pa.array([w for k in group for w in texts[k]], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes[group])
        catcher = SquareCatcher(int(sizes[group[0]]))
        catcher.append(np.insert(flat.astype(np.int64), ends, -1 - np.arange(len(group))))
        starts = ends - sizes[group] + np.arange(len(group))
        found = catcher.found()
        of = np.searchsorted(starts, [s for s, _, _ in found], side="right") - 1
        for j, (s, e, q) in zip(of.tolist(), found, strict=True):
            out[group[j]].append((s - int(starts[j]), e - s, q))
    return out


def _by_exponent(x: tuple[int, int, int], y: tuple[int, int, int]) -> int:
    """Greatest length / period first; then the smallest start, then the smallest period."""
    by = y[1] * x[2] - x[1] * y[2]
    return by or (-1 if (x[0], x[2]) < (y[0], y[2]) else 1)


def _row(words: list[bytes], runs: list[tuple[int, int, int]], shortest: int, least: int) -> tuple:
    runs = sorted((r for r in runs if r[1] >= max(shortest, least * r[2])), key=lambda r: (r[0], r[2]))
    top = min(runs, key=cmp_to_key(_by_exponent)) if runs else None
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for s, n, q in runs:
            keep[s + q : s + n] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2], listed, b" ".join(words).decode()


def periodic_runs(docs: DataFrame, shortest: int = 6, least: int = 4, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed of each row of docs (doc_id long, text).

    Words are what stands between white space, as it is. A run is a longest stretch with
    smallest period q of max(shortest, least * q) words or more; words of a run after its
    first q are left out of `collapsed`, kept words are joined by one space. `runs` lists
    start,length,period and a line end for each run, by start and period. start, length,
    period and exponent_milli are of the run with most periods (ties: smallest start, then
    period); null without runs. `plant` first puts a repeated stretch into one document in
    ten, chosen by a hash of doc_id (a null id: none), so that the operator can be measured.

    Null and empty texts and texts of white space have no words: no runs and an empty
    `collapsed`. Repeated rows are each answered. Other columns are ignored. An empty table
    gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [(t.as_py() or "").encode().split() for t in b.column(1)]
            if plant:
                texts = [planted(i, t) for i, t in zip(ids, texts, strict=True)]
            rows = [_row(w, r, shortest, least) for w, r in zip(texts, _batch_runs(texts), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    schema = ", ".join(f"{c} {'string' if c in ('runs', 'collapsed') else 'long'}" for c in names)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
