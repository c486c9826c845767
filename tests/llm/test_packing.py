import zlib

import numpy as np
from tokenizers import Tokenizer

from causalspark.llm.packing import CAPACITY, cutting_stock, pack, packed_sequences
from causalspark.llm.tokens import WordEncoder, default_tokenizer, encoder

TEXTS = [None, "", "It's 12 o'clock, they'll SAY!! ___ x_y", "naïve Ünïcode — ½ ² İstanbul   é", "<|endoftext|> a<|b", "word " * 9000, "x" * 30000, "a\x1cb\x85c d", "漢字 и кириллица"]


def test_encoding_is_the_tokenizers(spark):
    tk, enc = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    for t in TEXTS:
        want = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want, t


def test_new_parts_go_to_the_model_alone():
    tk, enc = Tokenizer.from_file(default_tokenizer()), WordEncoder(default_tokenizer())

    def whole(text):
        raise AssertionError(f"all of the tokenizer's steps for {text!r}")

    enc.whole = whole
    plain = "".join(map(chr, [*range(9, 14), *range(32, 127), 0xA1, 0xAB, 0xBB, *range(0xBF, 0x250)]))
    for t in (plain, " ".join(plain), "".join(f"{c}{c}a{c}'{c} '{c}S " for c in plain), TEXTS[2], "naïve Ünïcode İstanbul Therstea. ERED's"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == [*tk.encode(t, add_special_tokens=False).ids, 2], t


def test_other_steps_are_not_left_out(tmp_path):
    tk = Tokenizer.from_file(default_tokenizer())
    tk.normalizer = None  # A-Z stay
    tk.save(str(tmp_path / "other.json"))
    enc = WordEncoder(str(tmp_path / "other.json"))
    assert enc.model is None and enc.compute("ABC") == enc.whole("ABC") != enc.whole("abc")


def test_every_id_in_one_piece_and_little_padding(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i < 9 else "alpha beta gamma " * (i % 97 + 1)) for i in range(600)] + [(5, TEXTS[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df, with_ids=True).toPandas()
    enc = encoder(default_tokenizer())
    for i, t in rows[:120]:
        mine = got[got.doc_id == i].sort_values("start")
        if i != 5:
            assert b"".join(mine.ids) == enc.encode(t)
        assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(mine.ids, mine.ids_crc32, mine.length))
    assert got.length.sum() == sum(len(enc.encode(t)) // 4 for _, t in rows)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= CAPACITY
    assert got.sequence_id.nunique() <= np.ceil(got.length.sum() / CAPACITY) + 2
    assert pack(df.limit(0)).count() == 0
    seqs = packed_sequences(df).toPandas()
    assert len(seqs) == got.sequence_id.nunique() and all(len(x) == 4 * CAPACITY or (len(x) // 4).bit_count() == 1 for x in seqs.ids)


def test_patterns_hold_the_demand():
    demand = {45: 97, 36: 610, 31: 395, 14: 211}
    plan = cutting_stock(demand, 100)
    held = {s: sum(p.get(s, 0) * n for p, n in plan) for s in demand}
    assert held == demand and all(sum(s * a for s, a in p.items()) <= 100 for p, _ in plan)
    assert sum(n for _, n in plan) <= 454  # the optimum of this well-known instance is 453
