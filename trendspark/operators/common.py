"""Shared building blocks: literal dimensions, distributed dense index, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T  # noqa: F401
from pyspark.sql.window import Window

from trendspark.session import ensure_checkpoint_dir

# A literal dimension built from job parameters has a size fixed by the
# configuration, so broadcasting it is safe at any data scale. Dimensions read
# from data are left to AQE, which broadcasts only when the runtime size is
# under spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
MAX_LITERAL_ROWS = 10_000


def literal_dim(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    if len(rows) > MAX_LITERAL_ROWS:
        raise ValueError(f"literal dimension has {len(rows)} rows; load it as a table instead")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once under spark.checkpoint.dir and read back: like a reliable checkpoint, for wide rows. Parquet is a
    fraction of their size, and readers take only their columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/kept/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_index(df: DataFrame, order_cols: Sequence[str], name: str = "idx", wide: bool = False) -> DataFrame:
    """Dense 0-based index in ``order_cols`` order without a single-partition window.

    Range-partition on the order and sort inside each partition; the position in
    a partition is ``monotonically_increasing_id() - (partition_id << 33)`` (the id
    is partition-major and consecutive), stable on a task retry because the
    partition is sorted on a unique key. Each partition's offset is a prefix sum
    over one count per partition (tiny, broadcast). ``order_cols`` must be unique; where they
    are not, equal rows are numbered in any order. ``wide``: the rows are kept as Parquet."""
    cols = list(order_cols)
    part = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    )
    # fixed by a reliable checkpoint: sampled range bounds may differ between two evaluations
    ensure_checkpoint_dir(df.sparkSession)
    part = kept(part) if wide else part.checkpoint(eager=True)
    counts = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    )
    return (
        part.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local"))
        .drop("_pid", "_local", "_off")
    )
