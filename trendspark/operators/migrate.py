"""O-P8 migrate_legacy: string traffic -> thousands, add processing_cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions import migrate_traffic


def migrate_legacy(trends: DataFrame) -> DataFrame:
    """Legacy rows with a text ``traffic`` -> typed rows; ``processing_cost`` is
    added as NULL DECIMAL(10,6) when missing. Already-typed tables pass through."""
    out = trends
    if dict(trends.dtypes).get("traffic") == "string":
        out = out.withColumn("traffic", migrate_traffic(F.col("traffic")))
    if "processing_cost" not in out.columns:
        out = out.withColumn("processing_cost", F.lit(None).cast("decimal(10,6)"))
    return out
