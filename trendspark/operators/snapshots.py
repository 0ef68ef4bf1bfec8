"""Table snapshots (O-SNK4/5/9) and run gates (O-F16).

Parquet has no in-place update, so an update writes a new snapshot folder
``<base>/v=<n>`` and readers take the highest complete version. Writing a new
folder and never touching the old one makes a failed or retried job harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.params import Params


def _fs(spark: SparkSession, base: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, base: str) -> list[int]:
    fs, path = _fs(spark, base)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def write_snapshot(df: DataFrame, base: str) -> int:
    """Write ``df`` as the next version; returns the version number."""
    spark = df.sparkSession
    v = (versions(spark, base) or [0])[-1] + 1
    df.write.mode("error").parquet(f"{base}/v={v}")
    return v


def read_latest(spark: SparkSession, base: str, schema=None) -> DataFrame | None:
    vs = versions(spark, base)
    if not vs:
        return None
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(f"{base}/v={vs[-1]}")


def clear_all(spark: SparkSession, bases: dict[str, object]) -> dict[str, int]:
    """O-SNK9: empty snapshots with the same schema (children first, as the reference)."""
    out = {}
    for base, schema in bases.items():
        out[base] = write_snapshot(spark.createDataFrame([], schema), base)
    return out


def enabled_gate(df: DataFrame, params: Params, scheduled: bool = False) -> DataFrame:
    """O-F16: no rows unless importing is enabled (and cron, for scheduled runs)."""
    on = params.import_enabled and (params.cron_enabled or not scheduled)
    return df if on else df.limit(0)
