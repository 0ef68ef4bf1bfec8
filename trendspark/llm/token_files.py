"""Token-ID output (operator 5): directly addressable codes.

A shard file holds the ids of consecutive documents. Ids are split into 8-bit chunks, least first:
level 0 has one chunk for each id, level k+1 one chunk for each id of level k that goes on. A level
has its chunks, a bitmap that says which of them go on, and a rank directory (ones before every 512
bits), so the place of an id in the next level is a rank, and any id or range is read without
decoding what stands before it. The header lists the documents and where their ids start.

Layout, little-endian: ``DAC1``, u32 number of levels, u64 documents, u64 ids, i64 partition, i64
shard; u8 null flags and i64 doc ids; u64 starts (documents + 1); for each level u64 chunks, the
chunks, the bitmap, and u64 ranks.

Files are written by the task that holds the documents, under a name of their own and then moved in
place, so a task that runs again only replaces its files. Documents are ordered by id (nulls first,
equal ids by text). Null text: no ids but the end id. Empty table: no files, no rows. Extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import lean, new_path, running_total, small, table, text_batches
from trendspark.llm.units import ByteBpe

_MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sIQQqq")
_STEP = 512
_BPE: dict[str, ByteBpe] = {}


def bpe(path: str, most_units: int | None = None) -> ByteBpe:
    enc = _BPE.get(path) or _BPE.setdefault(path, ByteBpe(path))
    enc.most_units = most_units
    return enc


class Level:
    """Chunks of one level, the bitmap of those that go on, and its rank directory."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    def rank(self, i: int) -> int:
        """Number of chunks before ``i`` that go on."""
        at = i // _STEP
        lo, hi = at * (_STEP // 8), i // 8
        n = int(self.ranks[at]) + int(np.bitwise_count(self.bits[lo:hi]).sum())
        return n + (int(self.bits[hi] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def flags(self, lo: int, hi: int) -> np.ndarray:
        return np.unpackbits(self.bits[lo // 8: (hi + 7) // 8], bitorder="little")[lo % 8: lo % 8 + hi - lo].astype(bool)


def build_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-(-(len(bits) + 1) // (_STEP // 8)) * (_STEP // 8), np.uint8)
        pad[: len(bits)] = bits
        ones = np.bitwise_count(pad.reshape(-1, _STEP // 8)).sum(1, dtype=np.uint64)
        ranks = np.zeros(len(ones), np.uint64)
        np.cumsum(ones[:-1], out=ranks[1:])
        levels.append(Level((rest & 255).astype(np.uint8), bits, ranks))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


class Reader:
    """One shard: documents in order, and the ids of any range."""

    def __init__(self, data: bytes):
        magic, n_levels, self.n_docs, self.n_ids, self.part, self.shard = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.nulls, self.doc_ids = take("u1", self.n_docs), take("<i8", self.n_docs)
        self.starts = take("<u8", self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks, bits = take("u1", n), take("u1", (n + 7) // 8)
            self.levels.append(Level(chunks, bits, take("<u8", -(-(len(bits) + 1) // (_STEP // 8)))))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo .. hi-1`` of the shard; a chain of ranks, no decoding of others."""
        out = np.zeros(hi - lo, np.uint32)
        at = np.arange(hi - lo)
        for k, level in enumerate(self.levels):
            out[at] |= level.chunks[lo:hi].astype(np.uint32) << (8 * k)
            at = at[level.flags(lo, hi)]
            if not len(at):
                break
            lo = level.rank(lo)
            hi = lo + len(at)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])


def shard_bytes(part: int, shard: int, doc_ids: list, chunks: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(chunks), "<u4")
    starts = np.zeros(len(chunks) + 1, "<u8")
    np.cumsum([len(c) // 4 for c in chunks], out=starts[1:])
    nulls = np.array([d is None for d in doc_ids], "u1")
    levels = build_levels(ids)
    out = [_HEAD.pack(_MAGIC, len(levels), len(doc_ids), len(ids), part, shard), nulls.tobytes(),
           np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), starts.tobytes()]
    for x in levels:
        out += [np.array([len(x.chunks)], "<u8").tobytes(), x.chunks.tobytes(), x.bits.tobytes(), x.ranks.astype("<u8").tobytes()]
    return b"".join(out)


#: characters of a text by which rows of one key are dealt; the order of prefixes is that of the texts, and samples of them are small
DEALT = 64


def _put(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then move in place."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
    tmp = f"{base}/_attempt-{uuid.uuid4().hex}"
    system.create_dir(base, recursive=True)
    with system.open_output_stream(tmp) as f:
        f.write(data)
    system.move(tmp, f"{base}/{name}")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, text: str = "text", key: str = "doc_id",
                      shard_ids: int = 2_000_000) -> DataFrame:
    """Write the shards in ascending order of ``key`` and text; return the manifest (one row per file). Rows are dealt by
    key and the first ``DEALT`` characters of the text, so the rows of one key (null keys too) are spread over tasks."""
    text_batches(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.repartitionByRange(F.col("k").asc_nulls_first(), F.substring("t", 1, DEALT)).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, n = TaskContext.get().partitionId(), 0, 0
        keys, chunks, done = [], [], []

        def flush():
            nonlocal shard, n, keys, chunks
            _put(folder, f"tokens-{part:06d}-{shard:06d}.dac", shard_bytes(part, shard, keys, chunks))
            done.append((part, shard, len(keys), n))
            shard, n, keys, chunks = shard + 1, 0, [], []

        enc = bpe(tokenizer)
        for pdf in batches:
            ks = [None if pd.isna(x) else int(x) for x in pdf["k"]]
            texts = pdf["t"].tolist()
            for lo in range(0, len(texts), 256):
                for k, ids in zip(ks[lo: lo + 256], enc.encode(texts[lo: lo + 256])):
                    keys.append(k)
                    chunks.append(ids + end)
                    n += len(ids) // 4 + 1
                    if n >= shard_ids:
                        flush()
        if keys:
            flush()
        yield pd.DataFrame(done, columns=["part", "shard", "n_docs", "n_ids"])

    return table(d.mapInPandas(lean(run), "part long, shard long, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                r = Reader(data)
                for lo in range(0, r.n_docs, 512):
                    hi = min(r.n_docs, lo + 512)
                    a, b = int(r.starts[lo]), int(r.starts[hi])
                    raw = r.ids(a, b).astype("<u4").tobytes()
                    s = (r.starts[lo: hi + 1].astype(np.int64) - a) * 4
                    yield pd.DataFrame({
                        "file": (r.part << 24) + r.shard,
                        "doc_id": pd.array([None if x else int(i) for x, i in zip(r.nulls[lo:hi], r.doc_ids[lo:hi])], "Int64"),
                        "local": r.starts[lo:hi].astype(np.int64), "n_tokens": np.diff(s) // 4,
                        "tokens": [raw[i:j] for i, j in zip(s, s[1:])]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.dac").load(folder).select("content")
    rows = files.mapInPandas(lean(run), "file long, doc_id long, local long, n_tokens long, tokens binary")
    base = running_total(manifest.select(F.expr("shiftleft(part, 24) + shard").alias("file"), "n_ids"), "file", "n_ids", "base", 1 << 30)
    return rows.join(small(base.select("file", "base"), manifest.count()), "file").select(
        "doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "tokens")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the files to ``folder`` (a new one in the shared folder by default) and read them back."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    manifest = write_token_files(docs, tokenizer, folder, end_id)
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, tokens binary")
    return read_token_files(spark, folder, manifest)
