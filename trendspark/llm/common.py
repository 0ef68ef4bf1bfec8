"""Helpers shared by the operators of this folder: written tables in the shared
folder, prefix sums over partitions, connected components, byte hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: rows up to which a table whose rows are small (a few dozen bytes) may be broadcast
BROADCAST_ROWS = 250_000
#: bytes of rows with arrays up to which they may be broadcast
BROADCAST_BYTES = 48 << 20
#: rows of texts, and their bytes, that Spark hands to a Python worker at once
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset (tests, one machine) a scratch folder is set; on any other
    master a missing setting is an error, as executors would not see the files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def table(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, keeps what
    was decided, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes (smaller settings stay): at Spark's
    defaults whole texts of some kilobytes take hundreds of megabytes of a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def lean(run):
    """A task function that gives its memory back at its end: Spark keeps Python workers for later stages, and what a worker
    has once taken is otherwise held through all of them."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    if len(_POW["p"]) > 1 << 16:
        _POW.update(p=_POW["p"][:1].copy(), i=_POW["i"][:1].copy())
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few, else as it is (shuffle join)."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def small_lists(df: DataFrame, lists: str, item_bytes: int) -> DataFrame:
    """As :func:`small`, for rows of a few dozen bytes and an array ``lists`` whose items take ``item_bytes``:
    the summed lengths of the arrays count."""
    n = df.agg(F.count("*").alias("rows"), F.sum(F.size(lists)).alias("items")).first()
    return F.broadcast(df) if n["rows"] * 64 + (n["items"] or 0) * item_bytes <= BROADCAST_BYTES else df


def running_total(df: DataFrame, key: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows with a smaller integer ``key`` (keys unique).

    Two levels: totals of blocks of ``block`` keys, then inside each block, so no
    task sees more than ``block`` rows plus one row per block.
    """
    d = df.withColumn("_blk", F.floor(F.col(key) / block))
    tot = d.groupBy("_blk").agg(F.sum(value).alias("_t"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("_blk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_blk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return d.join(tot, "_blk").withColumn(out, F.col("_base") + F.col("_in")).drop("_blk", "_base", "_in")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges``: rows ``(id, component)`` for every id
    on an edge, ``component`` the smallest id reachable. Alternating large-star and
    small-star; each round is a written table. Partial minima come before every shuffle;
    joins on a hub are plain equi-joins, which adaptive execution can split."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    cur = table(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "cc")
    for _ in range(rounds):
        sym = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (large.join(low2, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
               .union(low2.select("u", F.col("m").alias("v"))).distinct())
        cur = table(nxt, "cc")
        per = cur.groupBy("u").agg(F.count("*").alias("n"))
        bad = per.where("n > 1").select("u").union(cur.join(per.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        if bad.limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    ids = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# ---- 64-bit polynomial hashes over bytes, all positions at once --------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_POW["p"]) < n:
        size = max(n, 1 << 16)
        for k, base in (("p", _BASE), ("i", _INV)):
            x = np.full(size, np.uint64(base), np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW["p"][:n], _POW["i"][:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Running sums; the hash of ``b[s:e]`` is ``(h[e] - h[s]) * inverse_power[s]``."""
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(len(b) + 1)[0][:len(b)], out=h[1:])
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without the six ASCII white-space bytes)."""
    sp = np.ones(len(b) + 2, bool)
    sp[1:-1] = _SPACE[b]
    edge = np.flatnonzero(sp[1:] != sp[:-1])
    return edge[::2], edge[1::2]
