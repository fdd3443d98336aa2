"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, cws, editcount, importance, jaccard, knn, licenses, packing, pieces, secrets, spelling, sql, suffix, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.scaled(table(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, models).drop("text").withColumn("rejected", F.col("p_toxic") >= models.reject)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=4096, end_id=2)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), width=5, percent=80).drop("class_id")


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return editcount.report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_pairs(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_report(table(spark, sf_dir, "documents"), size=400, words=51)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = bestfit.Capacity(tokens=4096, documents=4096, attention=4096**2)
    return bestfit.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity, end_id=1)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_cover_tree_top_k, op2_license_scan, op3_toxicity_chain, op4_packing, op5_ngram_jaccard_join,
        op6_edit_aware_counts, op7_secret_scan, op8_document_fingerprints, op9_suffix_dedup, op10_sentencepiece,
        op11_vector_best_fit, op12_spelling_variants, op13_importance_resampling,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cover_tree_top_k": sql.TOP_K,
        "op2_license_scan": sql.license_scan(),
        "op5_ngram_jaccard_join": sql.JACCARD,
        "op7_secret_scan": sql.secret_scan(),
        "op9_suffix_dedup": sql.SUFFIX,
        "op12_spelling_variants": sql.VARIANTS,
        "op13_importance_resampling": sql.RESAMPLE,
    }
