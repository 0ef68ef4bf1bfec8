"""Registered queries of the numbered operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import (embed_dedup, langid, line_dedup, merkle, minhash, mixing, packing, quality, quality_fm, suffix_dedup, token_counts,
                            token_files, whitening)
from trendspark.llm.common import new_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.quality(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each run, so that a run's answer and cost don't depend on earlier ones
    d = token_counts.token_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_BPE, new_path(spark, "token-cache"))
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_files.token_output(_read(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, end_id=0)
    return d.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_copies")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("text_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = langid.fit(docs.where(fold != 0))
    d = langid.predict(docs.select("doc_id", "text"), model)
    return d.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.cut_pieces(_read(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, capacity=1024, end_id=2)
    p = p.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return packing.place(p, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learn = ~F.coalesce(held, F.lit(True))  # null ids match no label
    model = quality_fm.fit(docs.where(learn), labels.where(learn), meta=("n_chars",))
    d = quality_fm.predict(docs, model, meta=("n_chars",))
    return d.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)
    pairs = F.posexplode(F.arrays_zip(F.col("whitened"), F.col("explained"))).alias("at", "one")
    d = d.select("vec_id", "n", "deviation", "identity_error", pairs)
    return d.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "one.whitened", "one.explained", "identity_error")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_embedding_near_dedup, op3_quality_rules, op4_token_counts, op5_token_output, op6_minhash_near_dedup,
    op7_source_mixing, op8_line_dedup, op9_language_id, op10_best_fit_packing, op11_quality_classifier, op12_embedding_whitening,
    op13_merkle_manifest)}
