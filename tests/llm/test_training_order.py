import glob
import struct

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from causalspark.llm import tokens
from causalspark.llm import training_order as T
from causalspark.llm.tokens import WordEncoder, default_tokenizer, encoder


def test_permutation_is_keyed_and_onto():
    for n in (1, 2, 3, 100, 1000, 4097):
        for key in (1, 2):
            assert sorted(T.permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert (T.permute(np.arange(1000), 1000, 1) != T.permute(np.arange(1000), 1000, 2)).any()


def test_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "SHARD_BYTES", 100 * T.STRIDE)
    rows = [(i, f"text number {i} " * (i % 400)) for i in range(300)] + [(1000, None), (1001, "ends\nwith\x00\r\n"), (7, "repeated"), (None, "no id"), (1002, "long " * 30000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(5)
    m = T.write_shards(df, str(tmp_path / "out"))
    got = T.read_shards(spark, m).toPandas().sort_values("slot")
    assert got.slot.tolist() == list(range(m.sequences)) and m.shards > 3
    assert (got.offset == got.slot % m.per_shard * m.stride).all()
    enc = encoder(default_tokenizer())
    for i, t in rows:
        if i is not None and i != 7:
            mine = got[got.doc_id == i].sort_values("start")
            assert np.frombuffer(b"".join(mine.ids), "<u2").tolist() == np.frombuffer(enc.encode(t), "<u4").tolist()
    assert len(got) == sum(-(-len(enc.encode(t)) // (4 * T.LENGTH)) for _, t in rows)
    resumed = T.read_shards(spark, m, 150, 333).toPandas()
    assert sorted(resumed.slot) == list(range(150, 333))
    empty = T.write_shards(df.limit(0), str(tmp_path / "none"))
    assert empty.sequences == 0 and T.read_shards(spark, empty).count() == 0


def plain_slot(i: int, n: int, key: int) -> int:
    """The keyed Feistel network with cycle-walking, number by number."""
    full = 2**64 - 1
    half = max((max(n - 1, 1).bit_length() + 1) // 2, 1)
    mask = (1 << half) - 1
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 2**63, 6, dtype=np.uint64)]
    while True:
        left, right = i >> half, i & mask
        for k in keys:
            m = (right + k) * 0x9E3779B97F4A7C15 & full
            m = (m ^ (m >> 29)) * 0xBF58476D1CE4E5B9 & full
            left, right = right, left ^ ((m ^ (m >> 32)) & mask)
        i = left << half | right
        if i < n:
            return i


def test_permutation_matches_plain_integers():
    for n, key in ((1, 1), (5, 3), (1000, 1), (70_001, 9)):
        some = np.arange(0, n, max(n // 200, 1))
        assert T.permute(some, n, key).tolist() == [plain_slot(int(i), n, key) for i in some]


def test_files_hold_the_sequences_in_their_slots(spark, monkeypatch, tmp_path):
    """Files read byte by byte, without the library's reader, against the permutation of plain integers."""
    monkeypatch.setattr(T, "SHARD_BYTES", 40 * T.STRIDE)
    rows = [(i, f"sequence {i} " * (30 * (i % 9))) for i in range(60)]
    m = T.write_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "out"), key=5)
    enc, want = encoder(default_tokenizer()), []
    for i, t in rows:  # one partition: sequences are numbered in the order of its rows
        ids = np.frombuffer(enc.encode(t), "<u4").tolist()
        want += [(i, k, ids[k : k + T.LENGTH]) for k in range(0, len(ids), T.LENGTH)]
    data = [open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*"))]
    assert m.sequences == len(want) and len(data) == m.shards > 1
    for number, (doc, start, ids) in enumerate(want):
        slot = plain_slot(number, m.sequences, 5)
        at = slot % m.per_shard * m.stride
        record = data[slot // m.per_shard][at : at + m.stride]
        got_doc, got_start, n = struct.unpack_from("<qIH", record)
        assert (got_doc, got_start, list(struct.unpack_from(f"<{n}H", record, 14))) == (doc, start, ids)
        assert record[-1:] == b"\n"


def test_ids_beyond_16_bits_are_refused():
    class Wide:
        def encode(self, t):
            return np.array([70_000, 2], dtype="<u4").tobytes()

    with pytest.raises(ValueError):
        T._records([1], ["x"], Wide())


def test_texts_together_have_the_ids_of_each(monkeypatch):
    plain = "".join(map(chr, [*range(9, 14), *range(32, 127), 0xA1, 0xAB, 0xBB, *range(0xBF, 0x250)]))
    around = "".join(f"{c}{c}a{c}'{c} '{c}S 5{c}'s{c}!'S 's'T{c}'LL " for c in plain)
    texts = [None, "", "It's 12 o'clock, they'll SAY!! ___ x_y", plain, around, None, "漢字 и кириллица", " \t\r\n ", "<|endoftext|> a<|b", "İ!!İx '0İ's", "a\x00b", "a\x1cb\x85c d", "word " * 9000, "x" * 30000, "", "½ — ¼"]
    tk, enc = Tokenizer.from_file(default_tokenizer()), WordEncoder(default_tokenizer())
    want = [[*tk.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    docs = np.arange(len(texts))
    for block in (1, 100, 10**9):  # a text by itself, some, all
        monkeypatch.setattr(tokens, "BLOCK", block)
        for skip in (0, 3):  # a slice of a column as well
            blocks = list(enc.encode_all(pa.array(texts, pa.string())[skip:]))
            sizes, ids = (np.concatenate(x) for x in zip(*blocks, strict=True))
            assert sizes.tolist() == [len(x) for x in want[skip:]] and ids.tolist() == sum(want[skip:], [])
            assert (T._cut(docs[skip:], sizes, ids) == T._records(docs[skip:].tolist(), texts[skip:], enc)).all()
    assert list(enc.encode_all(pa.array([], pa.string()))) == []


def test_a_block_looks_its_parts_up_once():
    asked = []

    class Counted(WordEncoder):
        def __getitem__(self, part):
            asked.append(part)
            return super().__getitem__(part)

        def encode(self, text):
            raise AssertionError("a text by itself")

    enc = Counted(default_tokenizer())
    [(sizes, ids)] = enc.encode_all(pa.array(["Alpha beta, gamma. " * 500, "alpha ALPHA beta!"] * 20))
    assert sorted(asked) == sorted({"", "alpha", "beta", ",", "gamma", ".", "!"}) and len(ids) == sizes.sum()
