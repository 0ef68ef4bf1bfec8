"""O-A15 cost projection: per-article cost ranges x articles per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.sources.dimensions import ARTICLES_PER_DAY


def published_projection(ranges: DataFrame) -> DataFrame:
    """The published ranges x 120 and 240 articles a day."""
    per_day = F.explode(F.array(*[F.lit(n) for n in ARTICLES_PER_DAY])).alias("per_day")
    r = ranges.select("model", "min_cost", "max_cost", per_day)
    return r.select("model", "per_day", (F.col("min_cost") * F.col("per_day")).alias("min_day"),
                    (F.col("max_cost") * F.col("per_day")).alias("max_day"))


def observed_projection(costs: DataFrame) -> DataFrame:
    """Observed cost per article by model (min, max, mean) x articles per day."""
    agg = costs.groupBy("provider", "model").agg(
        F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"),
        F.sum("cost").cast("decimal(20,6)").alias("sum_cost"), F.count(F.lit(1)).cast("bigint").alias("n"),
    )
    per_day = F.explode(F.array(*[F.lit(n) for n in ARTICLES_PER_DAY])).alias("per_day")
    a = agg.select("*", per_day)
    return a.select(
        "provider", "model", "per_day", "n",
        (F.col("min_cost") * F.col("per_day")).cast("decimal(20,6)").alias("min_day"),
        (F.col("max_cost") * F.col("per_day")).cast("decimal(20,6)").alias("max_day"),
        (F.col("sum_cost").cast("double") / F.col("n") * F.col("per_day")).alias("avg_day"),
    )
