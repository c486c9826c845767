import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from causalspark.llm import alignment
from causalspark.llm.alignment import align, link_sums, shared_cuts

TEXTS = [
    None, "", " ", "  ", "a", "Plain words, and some more; it's 12,345 of them!", " leading", "trailing ", "two  spaces   three", "line\nend\r\n tab\t x \x0b\x0c y",
    "<|endoftext|> <s> </s> <unk> <0x41> [PAD]", "ünïcödé — dash “quotes” … 漢字かな交じり文 без слов", "▁ lower one eighth", "a▁b c", "emoji 👩‍👩‍👧 and ﬁ ligature", "nul\x00byte \x1c\x1d sep\x85x",
    "x" * 3000, "no-break space em 　 ideographic", "ab " * 500, "word", "word", "é combining", "​zero width", "don't can't we'll I'M",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(tokenizers, text):
    """(ids, byte strings) of both tokenizers over the whole text at once, or none."""
    a, b = tokenizers
    if not text:
        return None
    chars = alignment._byte_level()
    x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    of_a = [bytes(chars[c] for c in t) for t in x.tokens]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, [b.id_to_piece(i) for i in y], strict=True)]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return None
    return x.ids, of_a, y, of_b


def plain(tokenizers, rows):
    """The query's rows by walking through both sequences."""
    parts, counts = [], Counter()
    for i, t in rows:
        found = tokens(tokenizers, t)
        groups, links = [], []
        if found:
            a, bytes_a, b, bytes_b = found
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            common = sorted(set(ends_a) & set(ends_b))
            at = 0
            for c in common:
                inside = [",".join(str(k) for k, e in zip(ids, ends, strict=True) if at < e <= c) for ids, ends in ((a, ends_a), (b, ends_b))]
                groups.append("|".join(inside))
                at = c
            links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y, f in zip(b, ends_b, strict=True) if e == f]
        counts.update(links)
        parts.append((i, len(found[0]) if found else 0, len(found[2]) if found else 0, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (i, n_a, n_b, len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, k in parts
    )


def corpus(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 900").select("text").collect()]
    return list(enumerate(TEXTS + docs))


@pytest.mark.parametrize("pairs", [1 << 16, 5, 0])
def test_query_matches_plain_walk(spark, tokenizers, monkeypatch, pairs):
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    rows = corpus(spark)[: None if pairs == 1 << 16 else 60]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, row int").repartition(3)
    got = link_sums(align(df, texts=False)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert sorted(tuple(r) for r in got.collect()) == plain(tokenizers, rows)


def test_chunks_give_the_ids_of_whole_texts(tokenizers):
    a, b = tokenizers
    pair = alignment._pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    letters = ["a", "the", " ", "  ", "\n", "\t", "'s", "9", ".", "é", "漢", " ", "▁", "\x1c", "\r", "<s>", "👩"]
    texts = ["".join(r.choices(letters, k=r.randint(1, 25))) for _ in range(3000)]
    for part in (texts[:1500], texts[1500:], TEXTS):
        x, y, n_x, n_y = pair.encode(part)
        got = zip(np.split(x, np.cumsum(n_x)[:-1]), np.split(y, np.cumsum(n_y)[:-1]), strict=True)
        for t, (p, q) in zip(part, got, strict=True):
            want = tokens(tokenizers, t) or ([], [], [], [])
            assert (p.tolist(), q.tolist()) == (want[0], want[2]), t


def test_cuts_of_any_token_sizes():
    r = random.Random(2)
    for _ in range(500):
        texts = []
        for _ in range(r.randint(0, 5)):
            n = r.randint(0, 30)
            sides = []
            for _ in range(2):
                inner = sorted(r.sample(range(1, n), r.randint(0, n - 1))) if n > 1 else []
                sides.append([*inner, n] if n else [])
            texts.append(sides)
        ends, base = [[], []], 0
        for sides in texts:
            for k in (0, 1):
                ends[k] += [base + e for e in sides[k]]
            base += sides[0][-1] if sides[0] else 0
        counts = [np.array([len(s[k]) for s in texts], dtype=np.int64) for k in (0, 1)]
        got, other = shared_cuts(np.array(ends[0], dtype=np.int64), np.array(ends[1], dtype=np.int64), *counts)
        common = sorted(set(ends[0]) & set(ends[1]))
        assert [ends[0][k] for k in got.tolist()] == [ends[1][k] for k in other.tolist()] == common


def test_general_output_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world")], "doc_id int, text string")
    rows = align(df).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    groups = [g.split("|") for g in rows[0].groups.split(";")]
    assert sum(len(g[0].split(",")) for g in groups) == rows[0].n_a and len(rows[0].linked_a) == 4 * rows[0].n_groups
    assert link_sums(align(df.where(F.lit(False)))).collect() == []
