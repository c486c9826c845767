"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every document becomes a set of hashed word shingles and a signature of SCREEN minima.
   Documents with equal sets are one class.
2. Screen: coordinates are taken two by two; a class that shares too few of these pairs with
   others can match none and is skipped. The others get signatures of COORDINATES minima.
3. These are posted under each coordinate and value, without the postings that no other has,
   and kept under their rarest only: two signatures that agree in `matches` coordinates agree
   in one of these.
4. In each posting list, the class with the most collisions (the hub) is compared with the
   others by counting equal coordinates. Pairs of `matches` and more are verified on full sets.
5. Lists whose classes the links so far leave in different components go on. Their classes are
   merged exactly: shingles that other components have too are ordered by rarity, and a class
   is posted under its rarest ones, as far as a partner may have no rarer one in common. The
   places of the shingles in both orders and both sizes bound what a pair can have in common;
   long lists are skipped by nearly all, as their shingles come late in the order. Within a
   list, rows of its commonest component meet the others only. What is left is verified.

Steps 2 to 4 miss a pair at the threshold with a probability of some 1e-5, one above it with
much less; that is the only way in which a link can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hinted, materialize, release
from .components import connected_components
from .tokens import forget

SCREEN = 64
COORDINATES = 256
#: Standard deviations below the expected matches at the threshold; the chance of fewer is some 5e-6.
SLACK = 4.5
SCREEN_SLACK = 4.2

_DRAW = np.random.default_rng(20)
_A = (_DRAW.integers(0, 2**63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _DRAW.integers(0, 2**63, COORDINATES, dtype=np.uint64)
#: A random number for each byte, the same for A-Z and a-z; words are polynomials in _BASE of these.
_BYTES = _DRAW.integers(0, 2**63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of _BASE and of its inverse, modulo 2**64, for as long a text as was met so far."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            steps = [np.full(size, x, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64))]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=np.uint64) for s in steps)
        return self.up[:n], self.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, powers: _Powers, space: np.ndarray = _SPACE) -> np.ndarray:
    """64-bit hashes of the words of the text with A-Z lower-cased, in order; `space` has the bytes between words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", dtype=np.uint8)
    edge = np.diff(space[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    up, down = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], dtype=np.uint64, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, width: int, powers: _Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; fewer words are one run."""
    ids = word_hashes(text, powers)
    if not len(ids):
        return ids
    take = min(width, len(ids))
    n = len(ids) - take + 1
    acc = np.full(n, take, dtype=np.uint64)
    for k in range(take):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """The first so many 32-bit minima of a set of hashes."""
    a, b = _A[:coordinates, None], _B[:coordinates, None]
    out = np.full(coordinates, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1024):
        np.minimum(out, (hashes[None, at : at + 1024] * a + b).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, n, fp1, fp2, sig): set size, two fingerprints of the set, signature; from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        powers = _Powers()
        for b in batches:
            n, f1, f2, sig = [], [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), width, powers)
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sig.append(signature(s, SCREEN).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "h", "n", "fp1", "fp2", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, h long, n long, fp1 long, fp2 long, sig binary")


def _postings(classes: DataFrame, coordinates: int, together: int = 1) -> DataFrame:
    """(key, node): each class under each of its coordinates, or of so many together; key tells places and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = coordinates // together
        place = np.arange(groups, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, groups, together).astype(np.uint64)
                keys = sig[:, :, 0] + place
                for k in range(1, together):
                    keys = _mix(keys) + sig[:, :, k]
                keys = keys.ravel().view(np.int64)
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), groups)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def bounds(percent: int) -> tuple[int, int]:
    """(pairs of coordinates to share with others, coordinates to agree in) for a threshold of so many percent."""
    if not 60 <= percent <= 100:
        raise ValueError("percent must be from 60 to 100: signatures tell lower similarities too badly")
    p = percent / 100
    least = lambda n, q, slack: max(1, math.floor(n * q - slack * math.sqrt(n * q * (1 - q))))
    return least(SCREEN // 2, p * p, SCREEN_SLACK), least(COORDINATES, p, SLACK)


def _screened(classes: DataFrame, matches: int) -> DataFrame:
    """(node) of the classes that share so many pairs of coordinates with others.

    Postings are sorted over all partitions; a posting is shared if a neighbour has its key. A
    partition's first and last postings may have theirs in the next one and count as shared.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, first = None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            k, d = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            # the last posting so far waits for its right neighbour
            k, d = (k, d) if key is None else (np.concatenate((key, k)), np.concatenate((ids, d)))
            same = k[1:] == k[:-1]
            left = np.concatenate(([first if key is None else before], same))
            keep = left[:-1] | same
            first, before, key, ids = False, left[-1], k[-1:], d[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(d[:-1][keep])], names=["node"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids)], names=["node"])

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _postings(classes, SCREEN, 2).repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(shared, "node long").groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") >= matches).select("node")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles, sig, mini) of the chosen (node, doc_id, h): full sets, signatures, and their lowest bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            out = [shingle_set(t.as_py(), width, powers) for t in b.column(1)]
            sig = [signature(s, COORDINATES) for s in out]
            ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
            values = np.concatenate(out) if out else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in out], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64))),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.array([x.astype(np.uint8).tobytes() for x in sig], pa.binary()),
                ],
                names=["node", "n", "shingles", "sig", "mini"],
            )

    texts = docs.join(hinted(chosen), ["doc_id", "h"]).select("node", "text")
    return texts.mapInArrow(run, "node long, n long, shingles array<long>, sig binary, mini binary")


def _colliding(pairs: DataFrame, full: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in so many coordinates, as far as their lowest bytes tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_bytes(b.column(2), COORDINATES) == _bytes(b.column(3), COORDINATES)).sum(axis=1) >= matches
                yield b.select([0, 1]).filter(pa.array(same))

    x, y = (full.select(F.col("node").alias(k), F.col("mini").alias(f"m{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    x, y = (full.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(x, "a")
        .join(y, "b")
        .select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        .where(100 * F.col("i").cast("long") >= percent * (F.col("t") - F.col("i")).cast("long"))
        .select("a", "b")
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (node, ...) with the component of the node as label; a node without links is its own."""
    return rows.join(labels.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of the rows of lists whose nodes are in different components."""
    rows = _labelled(posted.select("key", "node"), labels)
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return rows.join(keys, "key").select("node", "label").distinct()


def _crossing(full: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of the nodes (node, label) in different components that may have the wanted similarity.

    A node's shingles are ordered by how many nodes have them, those that no other component
    has first, as these cannot be in common. A pair's first common shingle is at place r of n
    and q of m, so it has n - r and m - q in common at most.
    """
    sets = full.select("node", "n", "shingles").join(nodes, "node")
    each = sets.select("node", "n", "label", F.explode("shingles").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "size")
    enough = lambda n, have: 100 * have >= percent * n
    ranked = (
        each.join(shared, "key")
        .groupBy("node")
        .agg(F.first("n").alias("n"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("size", "key"))).alias("keys"))
        .where(enough(F.col("n"), F.size("keys")))
    )
    lone = F.col("n") - F.size("keys")
    prefix = (F.floor((100 - percent) * F.col("n") / 100) + 1 - lone).cast("int")
    posted = materialize(
        ranked.select("node", "n", "label", lone.alias("lone"), F.posexplode(F.slice("keys.key", 1, prefix)).alias("at", "key")).select(
            "key", "node", "n", "label", (F.col("n") - F.col("lone") - F.col("at")).alias("rest")
        ),
        "minhash-prefixes",
    )
    by_label = posted.groupBy("key", "label").agg(F.count("*").alias("many"))
    main = by_label.groupBy("key").agg(F.max(F.struct("many", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("main"))
    rows = materialize(posted.join(main, "key").withColumn("apart", F.col("label") != F.col("main")).drop("main"), "minhash-mixed")
    x = rows.where("apart").select("key", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "label", "rest")))
    y = rows.select("key", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "label", "rest", "apart")))
    reach = (100 + percent) * F.least("x_rest", "y_rest") >= percent * (F.col("x_n") + F.col("y_n"))
    once = ~F.col("y_apart") | (F.col("x_node") < F.col("y_node"))
    met = x.join(y, "key").where((F.col("x_label") != F.col("y_label")) & reach & once)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _classified(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(features with a node for each distinct document, (node, component) of the linked nodes).

    A node is a doc_id, or a hash of doc_id and set where rows repeat a doc_id; components are
    nodes.
    """
    screen_matches, matches = bounds(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    features = materialize(_features(docs, width), "minhash-features")
    linkable = features.where("n > 0 and doc_id is not null")
    repeats = materialize(linkable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "minhash-repeats")
    repeated = bool(repeats.take(1))
    node = F.col("doc_id")
    if repeated:
        features = features.join(repeats.withColumn("again", F.lit(True)), "doc_id", "left")
        node = F.when(F.col("again"), F.xxhash64("doc_id", "n", "fp1", "fp2")).otherwise(F.col("doc_id"))
    features = features.withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), node)).drop("again")
    linkable = features.where("node is not null")
    copies = materialize(
        linkable.groupBy("n", "fp1", "fp2").agg(F.min("node").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "minhash-copies"
    )
    members = materialize(
        linkable.select("node", "n", "fp1", "fp2").join(copies, ["n", "fp1", "fp2"]).where("rep <> node").select("node", "rep").distinct(), "minhash-members"
    )
    classes = linkable.join(members, "node", "left_anti")
    screened = classes.join(_screened(classes, screen_matches), "node", "left_semi").select("node", "doc_id", "h")
    if repeated:  # the same set under other texts, or the same row again
        screened = screened.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("of")).select("node", "of.doc_id", "of.h")
        docs = docs.dropDuplicates(["doc_id", "h"])
    full = materialize(_sets(docs, materialize(screened, "minhash-screened"), width), "minhash-sets")

    postings = _postings(full, COORDINATES)
    shared = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rare = (
        postings.join(shared, "key")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("keys"), F.sum("size").alias("weight"))
        .where(F.size("keys") >= matches)
        .select("node", "weight", F.slice("keys", 1, F.size("keys") - (matches - 1)).alias("keys"))
    )
    posted = materialize(rare.join(full.select("node", "n"), "node").select("node", "n", "weight", F.explode("keys.key").alias("key")), "minhash-posted")
    hubs = (
        posted.groupBy("key")
        .agg(F.max(F.struct("weight", F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"), F.count("*").alias("size"))
        .where("size > 1")
        .select("key", "h.hub", "h.hub_n")
    )
    near_size = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    star = posted.join(hubs, "key").where(near_size & (F.col("node") != F.col("hub"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = materialize(_verified(materialize(_colliding(star, full, matches), "minhash-star"), full, percent), "minhash-links")
    labels = materialize(connected_components(links), "minhash-labels")
    crossing = materialize(_crossing(full, materialize(_open(posted, labels), "minhash-open"), percent), "minhash-crossing")
    more = materialize(_verified(crossing, full, percent), "minhash-links")
    if more.take(1):
        labels = materialize(connected_components(links.union(more)), "minhash-labels")
    release(full)
    renamed = labels.withColumnRenamed("node", "rep")
    moved = members.join(renamed, "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    heads = members.select(F.col("rep").alias("node"), F.col("rep").alias("component")).join(labels, "node", "left_anti").distinct()
    linked = materialize(moved.unionByName(labels.select("node", "component")).unionByName(heads), "minhash-components")
    if repeated:  # nodes are no doc_ids there: the smallest doc_id names the component
        ids = features.select("node", "doc_id").join(linked, "node")
        names = ids.groupBy("component").agg(F.min("doc_id").alias("smallest"))
        linked = materialize(linked.join(names, "component").select("node", "component", "smallest"), "minhash-components")
    else:
        linked = linked.withColumn("smallest", F.col("component"))
    return features, linked


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id long, text).

    Two documents are linked if the Jaccard similarity of their sets of `width`-word shingles
    is at least percent / 100 (60 to 100); component_id is the smallest doc_id that links reach.
    Null texts and texts without words have an empty set and are their own component. Rows
    stay as they are, repeated ones too; rows that share a doc_id but not the set of shingles
    are documents of their own, in a component each unless links join them. Rows with a null
    doc_id are not linked and have a null component. Other columns are ignored. An empty
    table gives none.
    """
    features, linked = _classified(docs, width, percent)
    return features.join(linked.select("node", "smallest"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates: that with the group's smallest doc_id.

    Of rows of a group that share this doc_id, that with the least hash of its text stays; of
    rows that share doc_id and text, one, with or without words. Rows with a null doc_id stay.
    All columns are kept, whatever their names.
    """
    features, linked = _classified(docs, width, percent)
    rows = features.select("node", "doc_id", "h").join(linked.select("node", "component"), "node")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    i, h = fresh(docs, "id"), fresh(docs, "hash")
    gone = rows.join(first, "component").where(F.struct("doc_id", "h") != F.col("first")).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    same_id = F.col("doc_id").cast("long") == F.col(i)
    kept = docs.join(hinted(materialize(gone, "minhash-gone")), same_id & (F.xxhash64("text") == F.col(h)), "left_anti")
    again = materialize(
        features.where("doc_id is not null").groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias(i)).distinct(), "minhash-again"
    )
    if not again.take(1):
        return kept
    twice = kept.join(again, same_id, "left_semi").withColumn(h, F.xxhash64("text")).dropDuplicates(["doc_id", h]).drop(h)
    return kept.join(again, same_id, "left_anti").unionByName(twice)
