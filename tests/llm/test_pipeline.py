"""The pipeline and each of its stages against plain loops, on awkward rows."""

import json

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from causalspark.llm.tokens import default_tokenizer

from test_language_decontamination import brute as contaminated
from test_minhash import brute as near
from test_pii import brute as base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"question{k}" for k in range(20))


def prose(seed: int, n: int) -> str:
    return " ".join(f"{'abcdefgh'[(seed * 7 + k * k) % 8]}word{(seed * 31 + k * 17) % 211}" for k in range(n))


def corpus() -> list[tuple]:
    texts = {
        1: prose(1, 60), 2: prose(1, 60), 3: prose(1, 59) + " changed", 4: prose(4, 80), 5: None, 6: "", 7: "123 456 !!", 8: "a", 9: prose(9, 20) + " " + ITEM, 10: prose(10, 6000),
        11: f"{prose(11, 30)} write to some.one@mail.example or 10.1.2.3 now", 12: prose(12, 40), 13: ITEM.upper(), 14: "é" * 50,
    }
    rows = [(i, t, None if i % 3 == 0 else "en", "hot" if i % 2 else None, len(t or "")) for i, t in texts.items()]
    return [*rows, rows[11], (12, prose(77, 40), "en", "again", 40), (None, prose(15, 30), "en", None, 30)]


def key(r) -> str:
    return json.dumps(list(r))


def by_hand(rows: list[tuple]) -> dict[str, list[tuple]]:
    """What each stage keeps of rows, doc_id and text, stage after stage."""
    out = {}
    kept = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    out["language_id"] = kept
    # rows of one id and text are one document; a node is its place among the different ones
    named = sorted({r for r in kept if r[0] is not None})
    group = {n: c for n, _, c in near([(n, t) for n, (_, t) in enumerate(named)], 5)}
    kept = [r for n, r in enumerate(named) if group[n] == n] + [r for r in kept if r[0] is None]
    out["minhash_near_dedup"] = kept
    bad = contaminated([(n, t) for n, (_, t) in enumerate(kept)], [(1, ITEM)])
    out["benchmark_decontamination"] = [kept[n] for n, *_, c in bad if not c]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages_match_plain_loops(spark, tables):
    want, docs = by_hand(corpus()), spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, tables)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert sorted(key((r.doc_id, r.text)) for r in rows) == sorted(map(key, want[name])), name
        if name == "language_id":
            assert all(r.lang == "en" for r in rows)
        docs = spark.createDataFrame(rows, SCHEMA)
    redacted = corpus_pipeline.redaction_stage(spark, docs, tables)
    assert redacted.columns == docs.columns
    for r in redacted.collect():
        assert r.n_chars == len(r.text) and not base_spans(r.text)
        if r.doc_id == 11:
            assert r.text == f"{prose(11, 30)} write to <email> or <ip> now"
    tokenizer = Tokenizer.from_file(default_tokenizer())
    sizes = {}
    for r in redacted.collect():
        sizes.setdefault(r.doc_id, []).append(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1)
    placed, filled = {}, {}
    for p in corpus_pipeline.packing_stage(spark, redacted, tables).collect():
        placed[p.doc_id] = placed.get(p.doc_id, 0) + p.length
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert placed == {i: sum(n) for i, n in sizes.items()}
    for s in filled.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_gives_the_documents_that_the_stages_keep(spark, tables):
    want = by_hand(corpus())["benchmark_decontamination"]
    got = {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()}
    assert got == {i for i, _ in want}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_stages_on_an_empty_table_and_clashing_names(spark, tables):
    more = ["doc", "hash", "id", "h", "node", "span", "base", "row", "_doc", "key", "keep"]
    rows = [(*r, *range(len(more))) for r in corpus()]
    wide = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} int" for c in more))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, tables)
        assert name == "packing" or got.columns == wide.columns, name
        assert got.count() > 0, name
        assert stage(spark, wide.limit(0), tables).count() == 0, name
