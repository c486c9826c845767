"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align, link_sums
from .common import table
from .decontaminate import contamination
from .html_text import main_text
from .jaccard_join import jaccard_components
from .language_id import language_id
from .minhash import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs
from .pii import BASE, count_kind, rendered, train, with_spans
from .spans import remove_repeated_spans
from .topk import integer_vectors, top_k
from .toxicity import toxicity
from .training_order import read_shards, write_shards


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return parts.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(table(spark, sf_dir, "documents"))).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, train(docs))
    counts = [count_kind(F.col("base"), k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(rendered(F.col("base")).cast("binary"), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_sums(align(table(spark, sf_dir, "documents"), texts=False)).withColumnRenamed("groups", "groups_sha256")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=80)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), shortest=6, least=4, plant=True)
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("runs", "collapsed")]
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_html_text": op2_html_text,
        "op3_sentence_spans": op3_sentence_spans,
        "op4_training_order": op4_training_order,
        "op5_toxicity": op5_toxicity,
        "op6_language_id": op6_language_id,
        "op7_pii": op7_pii,
        "op8_topk": op8_topk,
        "op9_packing": op9_packing,
        "op10_decontamination": op10_decontamination,
        "op11_token_alignment": op11_token_alignment,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": pipeline,
    }
