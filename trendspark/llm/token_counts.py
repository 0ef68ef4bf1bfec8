"""Token counts (operator 4): a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, token count) in a folder of the
caller. A run joins the digests of its texts to the cache, encodes only distinct misses, appends
them, and joins the counts back. Normalisation: a null text counts as the empty one (the model of
these queries keeps all other characters, so no further normalisation would keep the counts).

Copies: each scan task sends a distinct text once, a second filter after the exchange encodes it
once; the join back is on narrow rows. Ties and repeated rows get equal counts; an empty table gives an empty
table; other columns are kept by name, those named like an added or internal one (``_tc_digest``) are replaced.
Two runs that append the same digest leave equal rows; reading takes one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import lean, shared_dir, table
from trendspark.llm.units import PieceCounter

CACHE = "_tc_version string, _tc_digest binary, _tc_tokens long"
_COUNTERS: dict[str, PieceCounter] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of the model file and of the way it is called: a changed tokenizer misses the cache."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|sentencepiece {sentencepiece.__version__}|plain".encode()).hexdigest()


def _first_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()  # digests of one task's rows
    for pdf in batches:
        new = []
        for d in pdf["_tc_digest"]:
            new.append(d not in seen)
            seen.add(d)
        yield pdf[new]


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def token_counts(docs: DataFrame, model_path: str, cache_path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``n_bytes`` and ``n_tokens`` of the whole text."""
    spark = docs.sparkSession
    version = tokenizer_digest(model_path)
    cache_path = cache_path or f"{shared_dir(spark)}/llm-token-cache"
    keep = [c for c in docs.columns if c != text and c.lower() not in ("n_bytes", "n_tokens", "_tc_digest")]
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(*keep, F.unhex(F.sha2(content, 256)).alias("_tc_digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    misses = docs.select(F.unhex(F.sha2(content, 256)).alias("_tc_digest"), content.alias("_tc_text"))
    misses = misses.mapInPandas(lean(_first_seen), misses.schema)
    if _exists(spark, cache_path):
        cache = spark.read.schema(CACHE).parquet(cache_path).where(F.col("_tc_version") == version)
        misses = misses.join(cache.select("_tc_digest"), "_tc_digest", "left_anti")
    misses = misses.repartition("_tc_digest")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _COUNTERS.get(model_path) or _COUNTERS.setdefault(model_path, PieceCounter(model_path))
        for pdf in _first_seen(batches):
            n = counter.count([bytes(t).decode("utf-8", "replace") for t in pdf["_tc_text"]])
            yield pd.DataFrame({"_tc_version": version, "_tc_digest": pdf["_tc_digest"].tolist(), "_tc_tokens": n})

    misses.mapInPandas(lean(encode), CACHE).write.mode("append").option("compression", "zstd").parquet(cache_path)
    cache = spark.read.schema(CACHE).parquet(cache_path).where(F.col("_tc_version") == version)
    counts = cache.groupBy("_tc_digest").agg(F.max("_tc_tokens").alias("n_tokens"))
    return rows.join(counts, "_tc_digest").select(*keep, "n_bytes", "n_tokens")
