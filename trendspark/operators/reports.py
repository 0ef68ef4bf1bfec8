"""O-P6 dashboard and O-P7 listing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions import date_text, money_text, month_start_epoch, traffic_text, yes_no
from trendspark.params import DASHBOARD_TOP_N, LISTING_PAGE_SIZE, Params

SUM_TYPE = "decimal(20,6)"


def kpis(trends: DataFrame, params: Params) -> DataFrame:
    """O-A1..A9 in ONE aggregate pass (the reference runs five scans).

    avg_cost is total cost / processed count (processed rows without a cost are
    in the divisor), not AVG."""
    start = month_start_epoch(params.as_of)
    day_ago = params.as_of_epoch - 86400
    cost = F.col("processing_cost")
    has_cost = cost.isNotNull()
    agg = trends.agg(
        F.count(F.lit(1)).alias("total_trends"),
        F.count_if(F.col("processed") == 1).alias("processed_trends"),
        F.coalesce(F.sum(cost), F.lit(0)).cast(SUM_TYPE).alias("total_cost"),
        F.coalesce(F.sum(F.when((F.col("imported_at") >= start) & has_cost, cost)), F.lit(0)).cast(SUM_TYPE).alias("cost_this_month"),
        F.count_if(F.col("imported_at") >= start).alias("trends_this_month"),
        F.coalesce(F.sum(F.when(F.col("processed") == 1, cost)), F.lit(0)).cast(SUM_TYPE).alias("cost_processed"),
        F.coalesce(F.sum(F.when(F.col("imported_at") > day_ago, cost)), F.lit(0)).cast(SUM_TYPE).alias("cost_last_24h"),
    )
    return agg.select(
        F.col("total_trends").cast("bigint").alias("total_trends"),
        F.col("processed_trends").cast("bigint").alias("processed_trends"),
        (F.col("total_trends") - F.col("processed_trends")).cast("bigint").alias("pending_trends"),
        "total_cost",
        F.when(F.col("processed_trends") > 0, F.col("total_cost").cast("double") / F.col("processed_trends"))
        .otherwise(F.lit(0.0)).alias("avg_cost"),
        "cost_this_month",
        F.col("trends_this_month").cast("bigint").alias("trends_this_month"),
        "cost_processed",
        "cost_last_24h",
    )


def recent_trends(trends: DataFrame, n: int = DASHBOARD_TOP_N) -> DataFrame:
    """O-S2: last n by id (TakeOrderedAndProject: per-partition top-n, then merge)."""
    cols = ["id", "title", "traffic", "imported_at", "processed", "processing_cost", "node_id"]
    return trends.select(*cols).orderBy(F.col("id").desc()).limit(n)


def top_traffic(trends: DataFrame, n: int = DASHBOARD_TOP_N) -> DataFrame:
    """O-S3: top n by traffic; ties by id so the answer is deterministic."""
    cols = ["id", "title", "traffic", "imported_at", "processed", "node_id"]
    return trends.select(*cols).orderBy(F.col("traffic").desc(), F.col("id").asc()).limit(n)


# ---- listing (the YAML view as a DataFrame chain) --------------------------

# Columns the listing can sort on, and their default direction.
SORTABLE = {"id": "desc", "title": "asc", "traffic": "desc", "pub_date": "desc", "imported_at": "desc", "processing_cost": "desc"}
NUMERIC_FILTERABLE = {"id", "traffic", "node_id", "processing_cost", "news_id", "trend_id"}
STRING_FILTERABLE = {"title", "news_title", "source"}
DATE_FILTERABLE = {"pub_date", "imported_at"}
ARGUMENTS = {"id", "title", "news_id", "trend_id"}


def numeric_filter(col: str, op: str, value=None, value2=None) -> Column:
    """O-F12: =, <>, <, <=, >, >=, between, is null, is not null."""
    if col not in NUMERIC_FILTERABLE:
        raise ValueError(f"{col} has no numeric filter")
    c = F.col(col)
    ops = {
        "=": lambda: c == value, "<>": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value,
        ">": lambda: c > value, ">=": lambda: c >= value, "between": lambda: c.between(value, value2),
        "is null": lambda: c.isNull(), "is not null": lambda: c.isNotNull(),
    }
    return ops[op]()


def string_filter(col: str, op: str, value: str) -> Column:
    """O-F13: =, <>, contains, startswith, endswith, rlike."""
    if col not in STRING_FILTERABLE:
        raise ValueError(f"{col} has no string filter")
    c = F.col(col)
    ops = {
        "=": lambda: c == value, "<>": lambda: c != value, "contains": lambda: c.contains(value),
        "startswith": lambda: c.startswith(value), "endswith": lambda: c.endswith(value), "rlike": lambda: c.rlike(value),
    }
    return ops[op]()


def date_filter(col: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> Column:
    """O-F14: half-open range on a TIMESTAMP, or on an epoch column read as a date."""
    if col not in DATE_FILTERABLE:
        raise ValueError(f"{col} has no date filter")
    c = F.timestamp_seconds(F.col(col)) if col == "imported_at" else F.col(col)
    # bounds are UTC wall times: a string cast in the (UTC) session, not a Python
    # datetime that PySpark would read in the driver process's local zone
    ts = lambda d: F.lit(d.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= ts(start))
    if end is not None:
        cond = cond & (c < ts(end))
    return cond


def processed_filter(flag: bool) -> Column:
    return F.col("processed") == (1 if flag else 0)


def argument(col: str, value) -> Column:
    """O-F15: equality by path value."""
    if col not in ARGUMENTS:
        raise ValueError(f"{col} is not a contextual argument")
    return F.col(col) == value


def listing_rows(trends: DataFrame, articles: DataFrame, filters: Sequence[Column] = ()) -> DataFrame:
    """O-P7 rows: processed trends (O-F6) left-joined to their article (O-J2), then filters."""
    art = articles.select(F.col("node_id"), F.col("title").alias("article_title"))
    done = trends.filter(F.col("processed") == 1)
    # trends without a node (finished without an article) match nothing: they skip the join, as NULL keys meet in one task
    with_node = done.filter(F.col("node_id").isNotNull()).join(art, "node_id", "left")
    df = with_node.unionByName(done.filter(F.col("node_id").isNull()), allowMissingColumns=True)
    for f in filters:
        df = df.filter(f)
    return df


def listing_sort(df: DataFrame, sort: str = "imported_at", order: str | None = None) -> DataFrame:
    """O-S4: whitelist sort, id desc as the final tie-break."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort on {sort}")
    d = order or SORTABLE[sort]
    key = F.col(sort).asc() if d == "asc" else F.col(sort).desc()
    return df.orderBy(key, F.col("id").desc()) if sort != "id" else df.orderBy(key)


def listing_format(df: DataFrame) -> DataFrame:
    """O-X23 display columns of the listing."""
    return df.select(
        "id", "title", traffic_text(F.col("traffic")).alias("traffic_text"),
        date_text(F.col("pub_date")).alias("pub_date_text"),
        date_text(F.timestamp_seconds(F.col("imported_at"))).alias("imported_text"),
        yes_no(F.col("processed")).alias("processed_text"),
        money_text(F.col("processing_cost"), zero_is_na=True).alias("cost_text"),
        "node_id", "article_title",
    )


def listing_page(df: DataFrame, page: int, sort: str = "imported_at", order: str | None = None,
                 size: int = LISTING_PAGE_SIZE) -> DataFrame:
    """O-S5: one page of ``size`` rows (top-k with offset; for deep pages prefer a
    keyset filter ``id < last_id`` over a large offset)."""
    return listing_sort(df, sort, order).offset(page * size).limit(size)


def keyset_page(df: DataFrame, last_id: int | None, size: int = LISTING_PAGE_SIZE) -> DataFrame:
    """Deep paging on the default id-desc order: no offset, one pushed-down filter."""
    if last_id is not None:
        df = df.filter(F.col("id") < last_id)
    return df.orderBy(F.col("id").desc()).limit(size)


def listing(trends: DataFrame, articles: DataFrame, filters: Sequence[Column] = (), sort: str = "imported_at",
            order: str | None = None, page: int = 0) -> DataFrame:
    """O-P7 composite: processed trends + article title, filters, sort, one formatted page."""
    return listing_format(listing_page(listing_rows(trends, articles, filters), page, sort, order))


# ---- report over news items (base table of its own, related to its trend) ----

# Columns the news report can sort on, and their default direction.
NEWS_SORTABLE = {"news_id": "desc"}


def news_rows(news: DataFrame, trends: DataFrame, filters: Sequence[Column] = ()) -> DataFrame:
    """O-J3 rows of the news report: every news item with its trend, if there is one. Filters and arguments of the report
    (O-F12, O-F13, O-F15) are on ``news_id``, ``trend_id``, ``news_title`` and ``source``; those on the trend's columns work too."""
    n = news.select(F.col("id").alias("news_id"), "trend_id", F.col("title").alias("news_title"), F.col("snippet").alias("news_snippet"),
                    F.col("url").alias("news_url"), "source")
    t = trends.select(F.col("id").alias("trend_id"), "title", "traffic", "pub_date", "processed", "node_id")
    df = n.join(t, "trend_id", "left")
    for f in filters:  # Catalyst applies those on the news below the join
        df = df.filter(f)
    return df


def news_page(df: DataFrame, page: int = 0, sort: str = "news_id", order: str | None = None, size: int = LISTING_PAGE_SIZE) -> DataFrame:
    """One page of the news report."""
    if sort not in NEWS_SORTABLE:
        raise ValueError(f"cannot sort on {sort}")
    key = F.col(sort).asc() if (order or NEWS_SORTABLE[sort]) == "asc" else F.col(sort).desc()
    return df.orderBy(key).offset(page * size).limit(size)


def news_keyset_page(df: DataFrame, last_id: int | None, size: int = LISTING_PAGE_SIZE) -> DataFrame:
    """Deep paging of the news report: one pushed-down filter instead of an offset."""
    df = df if last_id is None else df.filter(F.col("news_id") < last_id)
    return df.orderBy(F.col("news_id").desc()).limit(size)


def recent_trends_display(trends: DataFrame, n: int = DASHBOARD_TOP_N) -> DataFrame:
    """O-X23 (dashboard): the recent list as shown — traffic ``1,234K+``, import time
    ``Y-m-d H:i``, Yes/No, cost ``$`` + 4 decimals with only NULL shown as ``N/A``."""
    r = recent_trends(trends, n)
    return r.select(
        "id", "title", traffic_text(F.col("traffic")).alias("traffic_text"),
        date_text(F.timestamp_seconds(F.col("imported_at"))).alias("imported_text"),
        yes_no(F.col("processed")).alias("processed_text"),
        money_text(F.col("processing_cost"), zero_is_na=False).alias("cost_text"), "node_id",
    )
