"""Trend state as an append-only update log (O-SNK4/SNK5 at scale).

Parquet cannot update rows in place, and rewriting the whole trends table on
every run does not scale. Finished trends are therefore appended to a small
``trend_updates`` log; the current table is the stored rows with the newest
update per id applied (a partial max_by aggregate, then a join on id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.operators.publish import finish_trends

UPDATES = "id bigint, processed int, node_id bigint, processing_cost decimal(10,6), updated_at bigint"


def trend_updates(done: DataFrame, as_of_epoch: int) -> DataFrame:
    """Update rows for finished ids: ``done`` = (id, node_id, processing_cost)."""
    return done.select(
        F.col("id").cast("bigint"), F.lit(1).alias("processed"), F.col("node_id").cast("bigint"),
        F.col("processing_cost").cast("decimal(10,6)"), F.lit(as_of_epoch).cast("bigint").alias("updated_at"),
    )


def current_trends(trends: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored trends with the newest update per id applied."""
    latest = updates.groupBy("id").agg(
        F.max_by(F.struct("node_id", "processing_cost"), F.struct("updated_at", "node_id")).alias("_u")
    ).select("id", F.col("_u.node_id").alias("node_id"), F.col("_u.processing_cost").alias("processing_cost"))
    return finish_trends(trends, latest)
