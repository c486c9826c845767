"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents are tokenised and cut into sequences of LENGTH ids. A keyed Feistel network with
cycle-walking permutes the numbers 0..N-1 of all sequences, so that each gets its slot in
training order without a shuffle table. Shard k holds the slots from k * per_shard on, one
record of STRIDE bytes each: slot s is at byte (s % per_shard) * STRIDE of its shard, so a
reader can begin at any slot and go on from there.

Each input partition's sequences are written once to a table of compressed blobs, numbered
within the partition; the driver gets each partition's total only. Then blobs are numbered
over all partitions, permuted, and sent to their shards compressed again; by then the Python
workers have freed what they remembered for tokenising.

Defined results: a null or empty text is one sequence with the end-of-text id. Repeated rows
are sequences of their own. A null doc_id is written as the smallest long. An empty table
writes no shard. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_root
from .tokens import default_tokenizer, encoder, forget

LENGTH = 256
#: Bytes of a shard, about; a shard is one task's sorted output.
SHARD_BYTES = 16_000_000
#: Documents in a blob.
BLOB_ROWS = 500
#: Record: doc_id, start, length, ids (16 bits each). The text writer ends it with a line end.
_RECORD = np.dtype([("doc_id", "<i8"), ("start", "<u4"), ("length", "<u2"), ("ids", "<u2", (LENGTH,))])
_ENDED = np.dtype([("record", _RECORD), ("end", "u1")])
STRIDE = _ENDED.itemsize
ROUNDS = 6


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of numbers in 0..n-1 under a keyed permutation of 0..n-1."""
    half = max((max(n - 1, 1).bit_length() + 1) // 2, 1)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, ROUNDS, dtype=np.uint64)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]  # walk on until the cycle is back in the range
    return out.astype(np.int64)


@dataclass
class Manifest:
    """Where the shards are: slot s is in the shard numbered s // per_shard."""

    path: str
    sequences: int
    per_shard: int
    shards: int
    length: int = LENGTH
    stride: int = STRIDE

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def _records(docs: list, texts: list, enc) -> np.ndarray:
    """Records of documents that are encoded one by one."""
    ids = [np.frombuffer(enc.encode(t), dtype="<u4") for t in texts]
    return _cut(np.array(docs, dtype=np.int64), np.array([len(x) for x in ids], dtype=np.int64), np.concatenate([np.empty(0, dtype="<u4"), *ids]))


def _cut(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Records of documents that have so many ids each, which follow one another."""
    if int(ids.max(initial=0)) > 0xFFFF:
        raise ValueError(f"records hold 16-bit ids, the tokenizer gives {int(ids.max())}")
    n = -(-sizes // LENGTH)
    r = np.zeros(int(n.sum()), dtype=_RECORD)
    start = (np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)) * LENGTH
    r["doc_id"], r["start"] = np.repeat(docs, n), start
    r["length"] = np.minimum(np.repeat(sizes, n) - start, LENGTH)
    r["ids"][np.arange(LENGTH) < r["length"][:, None]] = ids
    return r


def _pack(records: np.ndarray, level: int) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(records.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=_RECORD)


def write_shards(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, key: int = 1) -> Manifest:
    """Write all documents' sequences in permuted order under path (default: the shared folder)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    path = path or f"{shared_root(spark)}/shards-{uuid.uuid4().hex[:8]}"
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            docs, done = b.column(0).to_numpy(), 0
            for sizes, ids in enc.encode_all(b.column(1)):
                ends = np.cumsum([0, *sizes])
                for lo in range(0, len(sizes), BLOB_ROWS):
                    hi = min(lo + BLOB_ROWS, len(sizes))
                    r = _cut(docs[done + lo : done + hi], sizes[lo:hi], ids[ends[lo] : ends[hi]])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(r)], pa.int64()), pa.array([_pack(r, 6)], pa.binary())], names=["part", "at", "n", "blob"])
                    at += len(r)
                done += len(sizes)

    blobs = materialize(texts.mapInArrow(tokenise, "part int, at long, n long, blob binary"), "sequences")
    first, total = {}, 0
    for part, n in sorted(tuple(r) for r in blobs.groupBy("part").agg(F.sum("n")).collect()):
        first[part] = total
        total += n
    per_shard = max(SHARD_BYTES // STRIDE, 1)
    manifest = Manifest(path, total, per_shard, -(-total // per_shard))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's records of some blobs as one blob, with their slots before them."""
        forget()

        def flush(held: list):
            slots, records = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(slots, kind="stable")
            slots, records = slots[order], records[order]
            cut = np.searchsorted(slots, np.arange(manifest.shards + 1) * per_shard)
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                places = (slots[s] - k * per_shard).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([places], pa.binary()), pa.array([_pack(records[s], 3)], pa.binary())], names=["shard", "places", "blob"])

        held, size = [], 0
        for b in batches:
            for part, at, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                r = _unpack(blob)
                held.append((permute(np.arange(len(r)) + first[part] + at, total, key), r))
                size += len(r)
                if size >= 60_000:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        places, records = [], []
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                places.append(np.frombuffer(p, dtype="<u4"))
                records.append(_unpack(blob))
        if not places:
            return
        place, every = np.concatenate(places), np.concatenate(records)
        out = np.empty(len(every), dtype=_RECORD)
        out[place] = every
        for at in range(0, len(out), 10_000):
            part = out[at : at + 10_000]
            offsets = pa.py_buffer((np.arange(len(part) + 1) * _RECORD.itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, pa.py_buffer(part.tobytes())])], names=["record"])

    if total:
        (
            blobs.select("part", "at", "blob")
            .mapInArrow(send, "shard int, places binary, blob binary")
            .repartitionById(manifest.shards, F.col("shard"))
            .select("places", "blob")
            .mapInArrow(settle, "record binary")
            .select(F.col("record").cast("string").alias("value"))
            .write.option("compression", "none")
            .text(path)
        )
    return manifest


def read_shards(spark: SparkSession, manifest: Manifest, first: int = 0, last: int | None = None) -> DataFrame:
    """(slot, shard, offset, doc_id, start, length, ids_crc32, ids) of the slots first..last-1, from the files.

    ids are little-endian unsigned 16-bit numbers. A shard is read whole by one task and
    decoded in slices; shards without a slot that is asked for are not read.
    """
    last = manifest.sequences if last is None else min(last, manifest.sequences)
    per, stride = manifest.per_shard, manifest.stride
    schema = "slot long, shard int, offset long, doc_id long, start long, length long, ids_crc32 long, ids binary"
    if first >= last:
        return spark.createDataFrame([], schema)
    names = [f"part-{k:05d}*" for k in range(first // per, (last - 1) // per + 1)]
    everything = first == 0 and last == manifest.sequences

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = int(re.search(r"part-(\d+)[^/]*$", name)[1])
                data = content.as_buffer()
                if len(data) != stride * min(per, manifest.sequences - shard * per):
                    raise ValueError(f"shard {shard} has {len(data)} bytes")
                records = np.frombuffer(data, dtype=_ENDED)["record"]
                for at in range(0, len(records), 5000):
                    slot = shard * per + at + np.arange(len(records[at : at + 5000]))
                    wanted = (slot >= first) & (slot < last)
                    r, slot = records[at : at + 5000][wanted], slot[wanted]
                    ids = [x["ids"][: x["length"]].tobytes() for x in r]
                    columns = [slot, np.full(len(r), shard, dtype=np.int32), slot % per * stride, *(r[c].astype(np.int64) for c in ("doc_id", "start", "length"))]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, columns), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        names=["slot", "shard", "offset", "doc_id", "start", "length", "ids_crc32", "ids"],
                    )

    files = spark.read.format("binaryFile").load(manifest.path if everything else [f"{manifest.path}/{n}" for n in names])
    return files.select("path", "content").mapInArrow(decode, schema)
