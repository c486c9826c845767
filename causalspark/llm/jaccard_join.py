"""N-gram Jaccard join by rare-first prefix filtering.

Every text becomes a set of hashed word shingles; texts with equal sets are one class. With
the wanted similarity p, what a class of n shingles shares with a partner is p * n at least.

1. A first prefix filter over all classes, in the order of the hashes: of the first
   (1 - p) * n + l shingles a linked class shares l with its partner, within the partner's
   own prefix. Classes that share fewer of them with whatever other class go. A batch of
   documents sends each shingle once, so a shingle that a third of all texts have is not a
   large group.
2. What stays is counted exactly. Shingles are ordered by rarity, those that no other class
   has first; these need no posting, as nothing can be met in them. A class is posted under
   the rest of its first (1 - p) * n + 1.
3. Two classes that meet in a posting are a candidate pair if their sizes (length filter), the
   places of the posting in both orders (positional filter), and the parities of hashed parts
   of what comes after it (suffix filter: they bound how many shingles differ) allow p.
4. Each candidate pair is verified once, on full sets.

`jaccard_pairs` gives all linked pairs of classes. `jaccard_components` does not list the
pairs of a group of near copies: it first joins each posting list with the class of the list
that has fewest shingles of its own, and then only classes which these links leave in
different components. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, materialize, release
from .components import connected_components
from .minhash import _mix, _Powers, shingle_set
from .tokens import forget

#: Shingles beyond the shortest prefix, in percent of a set, that the first filter looks at and wants to be shared.
EXTRA = 10
#: Words of 64 parities that stand for what comes after a posting.
WORDS = 4
#: Shingles of sets, or numbers of postings, that a Python worker gathers before it sends them on.
TOGETHER = 500_000


def _spare(n, percent: int):
    """How many of n shingles may lack in a partner, with percent of similarity: (1 - p) * n, rounded down."""
    return n * (100 - percent) // 100


def _heads(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, h, n, fp1, fp2, head): set size, two fingerprints of the set, its first hashes; from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        powers = _Powers()
        for b in batches:
            n, f1, f2, head = [], [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), width, powers)
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                head.append(s[: _spare(len(s), percent) + max(len(s) * EXTRA // 100, 1)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(head, pa.binary())],
                names=["doc_id", "h", "n", "fp1", "fp2", "head"],
            )

    return docs.mapInArrow(run, "doc_id long, h long, n long, fp1 long, fp2 long, head binary")


def _head_postings(classes: DataFrame) -> DataFrame:
    """(key, node, known) of (node, head).

    A hash that several classes of a batch have is sent once, without a node; how many such
    hashes a class has comes as `known`, in a row of its own under its node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [np.frombuffer(x, dtype=np.int64) for x in b.column(1).to_pylist()]
            if not heads:
                continue
            owner = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
            key = np.concatenate(heads)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            same = key[1:] == key[:-1]
            left, right = np.concatenate(([False], same)), np.concatenate((same, [False]))
            known = np.bincount(owner[left | right], minlength=len(heads))
            node = b.column(0).to_numpy(zero_copy_only=False)
            some = known > 0
            first = ~left
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((key[first], node[some]))),
                    pa.array(np.concatenate((node[owner[first]], node[some])), mask=np.concatenate((right[first], np.zeros(some.sum(), dtype=bool)))),
                    pa.array(np.concatenate((np.zeros(first.sum(), dtype=np.int64), known[some]))),
                ],
                names=["key", "node", "known"],
            )

    return classes.select("node", "head").mapInArrow(run, "key long, node long, known long")


def _shared_heads(classes: DataFrame) -> DataFrame:
    """(node, m): how many of a class's first hashes other classes have among their first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by key; the last one of a batch waits for the next
        key, node, blank = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
        before = False
        for b in batches:
            known = b.column(2).to_numpy(zero_copy_only=False)
            posted = known == 0
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(~posted)), pa.array(known[~posted])], names=["node", "m"])
            if not posted.any():
                continue
            key = np.concatenate((key, b.column(0).to_numpy(zero_copy_only=False)[posted]))
            blank = np.concatenate((blank, b.column(1).is_null().to_numpy(zero_copy_only=False)[posted]))
            node = np.concatenate((node, b.column(1).fill_null(0).to_numpy(zero_copy_only=False)[posted]))
            same = key[1:] == key[:-1]
            left = np.concatenate(([before], same))
            keep = (left[:-1] | same) & ~blank[:-1]
            found, m = np.unique(node[:-1][keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(m)], names=["node", "m"])
            before, key, node, blank = left[-1], key[-1:], node[-1:], blank[-1:]
        if len(key) and before and not blank[0]:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([1])], names=["node", "m"])

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _head_postings(classes).repartition(parts, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "node long, m long").groupBy("node").agg(F.sum("m").alias("m"))


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, n, shingles) of (node, text), in batches of TOGETHER shingles and one text's more at most."""
    powers = _Powers()

    def flush() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).view(np.int64)))
        return pa.RecordBatch.from_arrays([nodes.slice(at, len(out)), pa.array(np.diff(ends).astype(np.int64)), lists], names=["node", "n", "shingles"])

    for b in batches:
        nodes, at, size, out = b.column(0), 0, 0, []
        for t in b.column(1):
            out.append(shingle_set(t.as_py(), width, powers))
            size += len(out[-1])
            if size >= TOGETHER:
                yield flush()
                at, size, out = at + len(out), 0, []
        if out:
            yield flush()


def _sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles) of the chosen (node, doc_id, h)."""

    chosen = hinted(chosen.select("node", F.col("doc_id").alias("of"), F.col("h").alias("oh")))
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh"))).select("node", "text")
    return texts.mapInArrow(lambda batches: _set_batches(batches, width), "node long, n long, shingles array<long>")


_POSTED = ["key", "node", "n", "lone", "rest", *(f"w{k}" for k in range(WORDS))]


def _posted_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """`_posted` of (node, n, keys by rarity), in batches of TOGETHER numbers and one class's more at most."""

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=_POSTED)

    for b in batches:
        out, size = [], 0
        for node, n, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            keys = keys.values.to_numpy(zero_copy_only=False)
            lone = n - len(keys)
            prefix = _spare(n, percent) + 1 - lone
            part = _mix(keys.view(np.uint64)) % np.uint64(64 * WORDS)
            bits = np.zeros((len(keys), WORDS), dtype=np.uint64)
            bits[np.arange(len(keys)), part // np.uint64(64)] = np.uint64(1) << (part % np.uint64(64))
            after = np.bitwise_xor.accumulate(bits[::-1])[::-1] ^ bits
            at = np.arange(prefix)
            # copies: the rest of `after` is as large as the whole set
            out.append((keys[:prefix], np.full(prefix, node), np.full(prefix, n), np.full(prefix, lone), len(keys) - at, *after[:prefix].T.view(np.int64).copy()))
            size += prefix * len(_POSTED)
            if size >= TOGETHER:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()


def _posted(full: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, lone, rest, w0, ...): each class under the shared ones of its rarest shingles.

    rest is how many shingles it has from this one on, in the order by rarity; w0, ... are
    parities of the hashed parts of what comes after. lone: shingles that no other class has.
    """

    each = full.select("node", "n", F.explode("shingles").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    ranked = (
        each.join(shared, "key")
        .groupBy("node")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("size", "key"))).alias("keys"))
        .where(100 * F.size("keys") >= percent * F.col("n"))
        .select("node", "n", F.col("keys.key").alias("keys"))
    )
    return ranked.mapInArrow(lambda batches: _posted_batches(batches, percent), ", ".join(f"{c} long" for c in _POSTED))


def _sides(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of x and y (as `_posted` gives, with x_ and y_ before the names) with one key that the filters let pass."""
    both = F.col("x_n") + F.col("y_n")
    length = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    place = (100 + percent) * F.least("x_rest", "y_rest") >= percent * both
    differ = both - F.col("x_rest") - F.col("y_rest")
    for k in range(WORDS):
        differ = differ + F.bit_count(F.col(f"x_w{k}").bitwiseXOR(F.col(f"y_w{k}")))
    return x.join(y, "key").where(length & place & ((100 + percent) * differ <= (100 - percent) * both))


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "key"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, total) of the pairs with 100 * common >= percent * union, where total is the sum of both sizes."""
    x, y = (full.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    found = pairs.join(x, "a").join(y, "b").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return found.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))


def _prepared(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (doc_id, n, node), sets of the classes that may be linked, their postings)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    node = F.when(F.col("n") > 0, F.xxhash64("n", "fp1", "fp2"))
    features = materialize(_heads(docs, width, percent).withColumn("node", node), "jaccard-heads")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    classes = features.where("n > 0").groupBy("node").agg(one.alias("one"), F.first("n").alias("n")).select("node", "n", "one.doc_id", "one.h")
    classes = materialize(classes, "jaccard-classes")
    chosen = classes.select(F.col("doc_id").alias("of"), F.col("h").alias("oh"))
    posting = features.join(chosen, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh"))).select("node", "head")
    rows = features.select("doc_id", "n", "node")
    again = features.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count() > 0
    if again:  # the same row several times
        posting = posting.dropDuplicates(["node"])
    # a partner may be shorter, down to percent of this size, and shares as many as its own prefix asks for
    wanted = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * EXTRA / 100))
    screened = classes.join(_shared_heads(posting), "node").where(F.col("m") >= wanted).select("node", "doc_id", "h")
    full = _sets(docs, materialize(screened, "jaccard-screened"), width)
    if again:
        full = full.dropDuplicates(["node"])
    full = materialize(full, "jaccard-sets")
    return rows, full, materialize(_posted(full, percent), "jaccard-posted")


def jaccard_pairs(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members (doc_id, node), pairs (a, b, common, total)): classes of equal sets and all links between them.

    docs has doc_id (long) and text. Two classes are linked if 100 * common >= percent *
    (total - common), where total is the sum of both sizes. Texts without words have a null
    node and no links. For groups of near copies the pairs are as many as there are links:
    where components are enough, `jaccard_components` is the way.
    """
    rows, full, posted = _prepared(docs, width, percent)
    met = _sides(_side(posted, "x"), _side(posted, "y"), percent).where("x_node < y_node")
    return rows.select("doc_id", "node"), _verified(materialize(_pairs(met), "jaccard-pairs"), full, percent)


def _crossing(posted: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate pairs of classes in different components. In a list, rows of its commonest component meet the others only."""
    rows = posted.join(labels.select("node", "component"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("many"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("many", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    mixed = mixed.select("key", F.col("top.label").alias("main"))
    rows = materialize(rows.join(mixed, "key").withColumn("apart", F.col("label") != F.col("main")).drop("main"), "jaccard-mixed")
    met = _sides(_side(rows.where("apart"), "x"), _side(rows, "y"), percent)
    return _pairs(met.where("x_label <> y_label and (not y_apart or x_node < y_node)"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id long, text).

    Two rows are linked if 100 * intersection >= percent * union of their sets of
    `width`-word shingles (A-Z lower-cased, words between white space; fewer words are one
    shingle); component_id is the smallest doc_id that links reach. Null texts and texts
    without words have an empty set, are linked with nothing and keep their own doc_id. Rows
    stay as they are, repeated ones too; rows that share a doc_id but not the text are each
    linked for themselves. A null doc_id names no component: such rows get the smallest
    doc_id of the others, or null. Other columns are ignored. An empty table gives none.
    """
    rows, full, posted = _prepared(docs, width, percent)
    hub = F.max(F.struct(-F.col("lone"), *(c for c in posted.columns if c != "key")))
    hubs = posted.groupBy("key").agg(hub.alias("x"), F.count("*").alias("size")).where("size > 1")
    hubs = hubs.select("key", *(F.col(f"x.{c}").alias(f"x_{c}") for c in posted.columns if c != "key"))
    star = materialize(_pairs(_sides(hubs, _side(posted, "y"), percent).where("x_node <> y_node")), "jaccard-star")
    links = materialize(_verified(star, full, percent).select("a", "b"), "jaccard-links")
    labels = materialize(connected_components(links), "jaccard-labels")
    crossing = materialize(_crossing(posted, labels, percent).join(star, ["a", "b"], "left_anti"), "jaccard-crossing")
    more = materialize(_verified(crossing, full, percent).select("a", "b"), "jaccard-links")
    if more.take(1):
        labels = materialize(connected_components(links.union(more)), "jaccard-labels")
    for t in (full, posted, star, crossing):
        release(t)
    named = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).join(labels, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")), "jaccard-named")
    groups = named.groupBy("component").agg(F.min("least").alias("smallest"), F.sum("many").alias("many")).where("many > 1").select("component", "smallest")
    names = hinted(materialize(named.join(groups, "component").select("node", "smallest"), "jaccard-names"))
    return rows.join(names, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))
