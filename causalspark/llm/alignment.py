"""Alignment of two tokenizers' ids by divide and conquer at shared cuts.

A text with a space before it is encoded by tokenizer A (byte-level BPE) and B (pieces with
byte fallback). Both give token ends as byte offsets. An interval of tokens of A and of B that
spans the same bytes is divided at a common end near its middle: the end of A's middle token
is looked up in B's ends by bisection, then those next to it, outwards, until one is common;
both halves are divided in turn. Intervals without a common end are the groups. All intervals
of a batch of texts are bisected together, depth by depth.

Links are pairs of an A and a B token that end together, one for each common end. How often an
id pair is linked is counted over all documents. The pairs that are linked most, PAIRS of them
at most, are sent to all executors; rarer ones, none of which can be a large group, are joined.

Encoding: neither tokenizer has a token with a space behind another character, so a text is the
sequence of its chunks, cut before each space that follows no white space. Chunks met before are
remembered, and those that are new are encoded together. Texts in which a chunk's tokens do not
give its bytes are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache, cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import _byte_level, forget

#: Chunks that a Python worker remembers, and an eighth of their ids; beyond, it begins anew.
REMEMBERED = 250_000
#: Characters of texts that are aligned together, and rows whose links are counted together.
TOGETHER = 500_000
ROWS = 500
#: Most linked pairs that every executor gets: 2**16 rows of three numbers.
PAIRS = 1 << 16
#: Where both libraries' classes of letters, digits and white space could differ in version.
_RARE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]")
_DOUBLE = [chr(c) + " " for c in range(0x10000) if chr(c).isspace()]
_CUT = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class _Table:
    """Ids of chunks one after the other, with where each chunk's begin."""

    def __init__(self) -> None:
        self.ids, self.starts, self.sizes = np.empty(1 << 12, dtype=np.int32), np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64)
        self.chunks = self.used = 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.chunks + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes))
        new = slice(self.chunks, self.chunks + len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[new] = sizes
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.chunks += len(sizes)
        self.used += len(ids)

    def gathered(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these chunks one after the other, how many each has)."""
        sizes = self.sizes[chunks]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[chunks] - ends + sizes, sizes)], sizes


class _Pair:
    """Both tokenizers, the bytes of their tokens, and the chunks met lately."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.path_a = path_a
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        chars, vocabulary = _byte_level(), model["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
        self.bytes_a = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = special[i] if i in special else bytes(chars[c] for c in t)
        for i, t in special.items():
            self.bytes_a[i] = t
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["model"]["merges"]]
        self.ranked = None
        if merged == sorted(merged):  # ids are in the order of merges
            import tiktoken
            from public_tokenizers import PATTERN

            ranks = {self.bytes_a[i]: i for i in vocabulary.values() if i not in special}
            self.ranked = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            one = _BYTE.fullmatch(piece)
            self.bytes_b.append(bytes([int(one[1], 16)]) if one and self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.forget()

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path_a)
        out.encode_special_tokens = True
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # number of a chunk, or -1 where its tokens' bytes are not its own
        self.of_a, self.of_b = _Table(), _Table()

    def _ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of space + text; None if the tokens' bytes are not its bytes."""
        if self.ranked is not None and not _RARE.search(text):
            a = self.ranked.encode_ordinary(" " + text)
        else:
            a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        whole = b" " + text.encode()
        same = b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
        return (a, b) if same else None

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks: those with a character at either end as one text, which is cut again, the others each for itself."""
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = self._ids(" ".join(part))
            if ids is None:
                for c in part:
                    self._learn_one(c)
                continue
            ends = np.cumsum([1 + len(c.encode()) for c in part])
            for table, x, sizes in ((self.of_a, ids[0], self.sizes_a), (self.of_b, ids[1], self.sizes_b)):
                x = np.array(x, dtype=np.int64)
                table.extend(x, np.diff(np.searchsorted(np.cumsum(sizes[x]), ends) + 1, prepend=0))
            first = self.of_a.chunks - len(part)
            self.known.update(zip(part, range(first, first + len(part)), strict=True))
        for c in set(chunks).difference(plain):
            self._learn_one(c)

    def _learn_one(self, chunk: str) -> None:
        ids = self._ids(chunk)
        if ids is None:
            self.known[chunk] = -1
            return
        self.known[chunk] = self.of_a.chunks
        for table, x in ((self.of_a, ids[0]), (self.of_b, ids[1])):
            table.extend(np.array(x, dtype=np.int64), np.array([len(x)]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, of all texts one after the other; how many of A and of B each text has)."""
        flat, sizes = [], []
        for t in texts:
            c = t.split(" ") if t else []
            if t and (t[0] == " " or any(x in t for x in _DOUBLE)):  # a space that follows white space is no cut
                c = [x[1:] for x in _CUT.split(" " + t)]
            flat += c
            sizes.append(len(c))
        if len(self.known) > REMEMBERED or self.of_a.used > 8 * REMEMBERED:
            self.forget()
        self._learn(list({c for c in flat if c not in self.known}))
        number = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        ends = np.cumsum(sizes)
        wrong = np.flatnonzero(number < 0)
        for k in np.unique(np.searchsorted(ends, wrong, side="right")).tolist():  # texts to be encoded whole
            at = slice(int(ends[k]) - sizes[k], int(ends[k]))
            ids = self._ids(texts[k])
            number[at] = -1
            if ids is not None:
                for table, x in ((self.of_a, ids[0]), (self.of_b, ids[1])):
                    table.extend(np.array(x, dtype=np.int64), np.array([len(x)]))
                number[at.start] = self.of_a.chunks - 1
        of = np.repeat(np.arange(len(texts)), sizes)[number >= 0]
        number = number[number >= 0]
        out = []
        for table in (self.of_a, self.of_b):
            ids, many = table.gathered(number)
            out.append((ids, np.bincount(of, weights=many, minlength=len(texts)).astype(np.int64)))
        return out[0][0], out[1][0], out[0][1], out[1][1]


@cache
def _pair(path_a: str, path_b: str) -> _Pair:
    return _Pair(path_a, path_b)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A and of those of B that end the groups, in order.

    ends_*: byte offsets at which tokens end, of all texts one after the other; counts_*: tokens
    of each text. Tokens are not empty, and both tokenizers' tokens of a text end together.
    """
    last_a, last_b = np.cumsum(counts_a), np.cumsum(counts_b)
    some = counts_a > 0
    # intervals of tokens [lo, hi) of A and of B
    a0, a1, b0, b1 = (last_a - counts_a)[some], last_a[some], (last_b - counts_b)[some], last_b[some]
    leaves = []
    while len(a0):
        middle = (a0 + a1 - 1) // 2
        cut, place = np.full(len(a0), -1), np.zeros(len(a0), dtype=np.int64)
        todo = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        step = 0
        while len(todo):
            # tokens step places from the middle, first before it, then behind; the last one's end is no cut
            for at in (middle[todo] - step, middle[todo] + step) if step else (middle[todo],):
                inside = (at >= a0[todo]) & (at < a1[todo] - 1) & (cut[todo] < 0)
                k, at = todo[inside], at[inside]
                near = np.searchsorted(ends_b, ends_a[at])
                hit = ends_b[near] == ends_a[at]
                cut[k[hit]], place[k[hit]] = at[hit], near[hit]
            step += 1
            todo = todo[(cut[todo] < 0) & ((middle[todo] - step >= a0[todo]) | (middle[todo] + step < a1[todo] - 1))]
        whole = cut < 0
        leaves.append((a1[whole] - 1, b1[whole] - 1))
        a0, a1, b0, b1, cut, place = (x[~whole] for x in (a0, a1, b0, b1, cut, place))
        a0, a1 = np.concatenate((a0, cut + 1)), np.concatenate((cut + 1, a1))
        b0, b1 = np.concatenate((b0, place + 1)), np.concatenate((place + 1, b1))
    if not leaves:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return tuple(np.sort(np.concatenate(x)) for x in zip(*leaves, strict=True))


@cache
def _numerals(size: int) -> list[str]:
    """Decimal numbers with what may follow: a comma, a bar or a semicolon."""
    return [f"{i}{end}" for end in ",|;" for i in range(size)]


def _aligned(pair: _Pair, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes, bytes]]:
    """(n_a, n_b, n_groups, groups, linked ids of A, linked ids of B) of each text."""
    a, b, counts_a, counts_b = pair.encode(texts)
    ends_a, ends_b = np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b])
    cuts, places = shared_cuts(ends_a, ends_b, counts_a, counts_b)
    # every token's place in the listing: groups in order, A before B in each
    group_a, group_b = (np.bincount(x + 1, minlength=n + 1)[:n].cumsum() for x, n in ((cuts, len(a)), (places, len(b))))
    size = max(len(pair.bytes_a), len(pair.bytes_b))
    listed = np.empty(len(a) + len(b), dtype=np.int32)
    ending_a, ending_b = a.copy(), b.copy()
    ending_a[cuts] += size
    ending_b[places] += 2 * size
    listed[np.arange(len(a)) + np.concatenate(([0], places + 1))[group_a]] = ending_a
    listed[np.arange(len(b)) + (cuts + 1)[group_b]] = ending_b
    last_a, last_b = np.cumsum(counts_a), np.cumsum(counts_b)
    first = np.searchsorted(cuts, last_a - counts_a)
    after = np.searchsorted(cuts, last_a)
    linked_a, linked_b = a[cuts].astype("<u4"), b[places].astype("<u4")
    names = _numerals(size)
    for k, (x, y, g0, g1) in enumerate(zip(last_a.tolist(), last_b.tolist(), first.tolist(), after.tolist(), strict=True)):
        n_a, n_b = int(counts_a[k]), int(counts_b[k])
        text = "".join([names[c] for c in listed[x - n_a + y - n_b : x + y].tolist()])[:-1]
        yield n_a, n_b, g1 - g0, text, linked_a[g0:g1].tobytes(), linked_b[g0:g1].tobytes()


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    part, total = [], 0
    for t in texts:
        part.append(t.as_py())
        total += len(part[-1] or "")
        if total >= TOGETHER:
            yield part
            part, total = [], 0
    if part:
        yield part


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, linked_a, linked_b of each row of docs (doc_id long, text).

    groups lists ids as a1,a2|b1;a3|b2,b3; linked_* are the ids of each link, as little-endian
    32-bit numbers. Without `texts` groups is the sha256 of the listing instead ('' without
    tokens). Null and empty texts, and those whose tokens' bytes are not space + text, have no
    tokens. Repeated rows are each answered. Other columns are ignored. An empty table gives none.
    """
    import public_tokenizers

    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "linked_a", "linked_b"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pair = _pair(path_a, path_b)
        for b in batches:
            at = 0
            for part in _portions(b.column(1)):  # a small batch for each portion
                rows = [(*r[:3], r[3] if texts or not r[3] else sha256(r[3].encode()).hexdigest(), *r[4:]) for r in _aligned(pair, part)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), *columns], names=names)
                at += len(part)

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups string, linked_a binary, linked_b binary"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def _keys(x: pa.Array, y: pa.Array) -> np.ndarray:
    """One number for each link: A's id in the upper half, B's in the lower."""
    a, b = (np.frombuffer(b"".join(c.to_pylist()), dtype="<u4").astype(np.int64) for c in (x, y))
    return (a << 32) | b


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _pair.cache_clear()  # this Python worker may have encoded
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best) over all rows: how often each id pair is linked, and whether no other A id is more often linked with this B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            pair, links = np.unique(_keys(b.column(0), b.column(1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(links)], names=["pair", "links"])

    counts = aligned.select("linked_a", "linked_b").mapInArrow(run, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "alignment-counts")
    most = F.broadcast(counts.groupBy("b").agg(F.max("links").alias("most")))  # as many rows as B has ids
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame) -> DataFrame:
    """aligned with n_links, n_best and count_sum in place of the links.

    n_best: links whose count is their B id's highest, ties included; count_sum: the sum of the
    counts of the id pairs over the links.
    """
    spark = aligned.sparkSession
    rows = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    counts = materialize(pair_counts(rows), "alignment-best")
    top = counts.orderBy(F.desc("links"), "pair").limit(PAIRS).collect()
    frequent = np.array(sorted((r.pair, r.links, r.best) for r in top), dtype=np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast(frequent)

    def split(batches: Iterator[pa.RecordBatch], rare: bool) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in _slices(batches):
            key = _keys(b.column(1), b.column(2))
            of = np.repeat(np.arange(b.num_rows), [len(x) // 4 for x in b.column(1).to_pylist()])
            at = np.minimum(np.searchsorted(known[:, 0], key), len(known) - 1) if len(known) else np.zeros(len(key), dtype=np.int64)
            hit = known[at, 0] == key if len(known) else np.zeros(len(key), dtype=bool)
            row = b.column(0).to_numpy(zero_copy_only=False)
            if rare:
                yield pa.RecordBatch.from_arrays([pa.array(row[of[~hit]]), pa.array(key[~hit])], names=["row", "pair"])
                continue
            total, best = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            np.add.at(total, of[hit], known[at[hit], 1])
            np.add.at(best, of[hit], known[at[hit], 2])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(total)], names=["row", "n_best", "count_sum"])

    links = rows.select("row", "linked_a", "linked_b")
    of_frequent = links.mapInArrow(lambda x: split(x, False), "row long, n_best long, count_sum long")
    of_rare = links.mapInArrow(lambda x: split(x, True), "row long, pair long").groupBy("row", "pair").agg(F.count("*").alias("times"))
    of_rare = of_rare.join(counts, "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("links")).alias("count_sum"))
    sums = of_frequent.unionByName(of_rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    n_links = (F.octet_length("linked_a") / 4).cast("long").alias("n_links")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups", n_links).join(sums, "row").drop("row")
