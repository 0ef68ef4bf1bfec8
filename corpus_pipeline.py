"""Corpus pipeline: documents in, packed token sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``; rows with a null id stay
where a stage needs no id. A table without rows gives a table without rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import langid, line_dedup, minhash, mixing, packing
from trendspark.llm.common import small, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A worker's unit table in the last stage, smaller than packing's own: earlier stages have taken memory of the executor.
PACK_UNITS = 300_000
#: A text that no language's classifier comes near (0.5 is the decision border) is rejected.
LEAST_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Drops texts without a letter (null and empty ones too) and texts of no known language: too few
    of their n-grams are known from labelled texts, or every classifier is against them; a null ``lang`` becomes
    the predicted one."""
    seen = langid.predict(docs, langid.fit(docs), out_lang="_pred", out_score="_score", out_match="_match")
    seen = seen.where((F.col("_pred") != "und") & F.col("_match") & (F.col("_score") >= LEAST_LANGUAGE_SCORE))
    return seen.withColumn("lang", F.coalesce("lang", "_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Drops lines that equal or nearly equal an earlier one, and texts with no line left;
    ``n_chars`` follows the text."""
    d = line_dedup.line_dedup(docs)
    d = d.where((F.col("n_lines") == 0) | (F.col("n_exact") + F.col("n_near") < F.col("n_lines")))
    return d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Of each group of near duplicates the document with the smallest id stays (of equal ids the
    smallest text hash, null ids last); of rows with equal id (null ids too) and text one stays."""
    d, key = docs, "doc_id"
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        d, key = table(_row_keys(docs), "row-keys"), "_row"
    gone = table(minhash.near_documents(d, key=key).where(~F.col("kept")).select(key), "near-duplicates")
    return d.join(small(gone, gone.count()), key, "left_anti").select(docs.columns)


def _row_keys(docs: DataFrame) -> DataFrame:
    """One row for each id and text, numbered (``_row``) in the order of ids and text hashes."""
    rest = [c for c in docs.columns if c != "doc_id"]
    d = docs.groupBy("doc_id", F.md5("text").alias("_hash")).agg(F.min(F.struct(*rest)).alias("_rest"))
    d = d.orderBy(F.col("doc_id").asc_nulls_last(), "_hash")
    return d.select("doc_id", "_rest.*", F.monotonically_increasing_id().alias("_row")).select(*docs.columns, "_row")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, one epoch at most, nine tenths of the tokens."""
    return mixing.mix(docs, fraction=0.9, max_epochs=1).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Pieces of at most 1024 ids with their ids, sequence and offset."""
    return packing.pack(docs, TOKENIZER, capacity=1024, end_id=2, most_units=PACK_UNITS)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("source_mixing", source_mix),
          ("best_fit_packing", pack)]

#: Kernel classification, tokenizer ids and seeded hashes have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
