"""O-P6 dashboard and O-P7 listing on fx_trends (as of 2001-07-15 12:00 UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trendspark.fixtures import fixture
from trendspark.operators import reports as R
from trendspark.params import Params
from trendspark.plans.registry import query

P = Params()  # as_of = 2001-07-15 12:00:00 UTC
MONTH_START = 993945600  # 2001-07-01 00:00:00 UTC
DAY_AGO = 995112000  # as_of - 24 h
FX = ("fx_trends",)

SQL_KPIS = f"""
SELECT cast(count(*) AS bigint) AS total_trends,
  cast(count(*) FILTER (WHERE processed = 1) AS bigint) AS processed_trends,
  cast(count(*) - count(*) FILTER (WHERE processed = 1) AS bigint) AS pending_trends,
  cast(coalesce(sum(processing_cost), 0) AS decimal(20,6)) AS total_cost,
  CASE WHEN count(*) FILTER (WHERE processed = 1) > 0
    THEN cast(cast(coalesce(sum(processing_cost), 0) AS decimal(20,6)) AS double) / count(*) FILTER (WHERE processed = 1)
    ELSE 0.0 END AS avg_cost,
  cast(coalesce(sum(processing_cost) FILTER (WHERE imported_at >= {MONTH_START} AND processing_cost IS NOT NULL), 0) AS decimal(20,6)) AS cost_this_month,
  cast(count(*) FILTER (WHERE imported_at >= {MONTH_START}) AS bigint) AS trends_this_month,
  cast(coalesce(sum(processing_cost) FILTER (WHERE processed = 1), 0) AS decimal(20,6)) AS cost_processed,
  cast(coalesce(sum(processing_cost) FILTER (WHERE imported_at > {DAY_AGO}), 0) AS decimal(20,6)) AS cost_last_24h
FROM fx_trends"""


def _kpis(spark, sf):
    return R.kpis(fixture(spark, sf, "fx_trends"), P)


@query("dashboard", SQL_KPIS, fx=FX)
def q_dashboard(spark, sf):
    return _kpis(spark, sf)


def _kpi(name, col):
    @query(name, f"SELECT {col} FROM ({SQL_KPIS.strip()})", fx=FX)
    def q(spark, sf):
        return _kpis(spark, sf).select(col)

    return q


for _name, _col in [
    ("kpi_total", "total_trends"), ("kpi_processed", "processed_trends"), ("kpi_pending", "pending_trends"),
    ("kpi_total_cost", "total_cost"), ("kpi_avg_cost", "avg_cost"), ("kpi_cost_month", "cost_this_month"),
    ("kpi_trends_month", "trends_this_month"), ("cost_processed", "cost_processed"), ("cost_last_24h", "cost_last_24h"),
]:
    _kpi(_name, _col)


@query("recent_trends", """
SELECT id, title, traffic, imported_at, processed, processing_cost, node_id FROM fx_trends ORDER BY id DESC LIMIT 5""", fx=FX)
def q_recent(spark, sf):
    return R.recent_trends(fixture(spark, sf, "fx_trends"))


@query("top_traffic", """
SELECT id, title, traffic, imported_at, processed, node_id FROM fx_trends ORDER BY traffic DESC, id ASC LIMIT 5""", fx=FX)
def q_top(spark, sf):
    return R.top_traffic(fixture(spark, sf, "fx_trends"))


SQL_LISTING_ROWS = """
SELECT t.*, a.title AS article_title FROM fx_trends t LEFT JOIN fx_articles a ON a.node_id = t.node_id WHERE t.processed = 1"""
SQL_FORMAT = """id, title, concat(format('{:,}', traffic), 'K+') AS traffic_text,
  strftime(pub_date, '%Y-%m-%d %H:%M') AS pub_date_text,
  strftime(make_timestamp(imported_at * 1000000), '%Y-%m-%d %H:%M') AS imported_text,
  CASE WHEN processed = 1 THEN 'Yes' ELSE 'No' END AS processed_text,
  CASE WHEN processing_cost IS NULL OR processing_cost = 0 THEN 'N/A'
       ELSE concat('$', cast(cast(processing_cost AS decimal(10,4)) AS varchar)) END AS cost_text,
  node_id, article_title"""
FXL = ("fx_trends", "fx_articles")


def _rows(spark, sf, filters=()):
    return R.listing_rows(fixture(spark, sf, "fx_trends"), fixture(spark, sf, "fx_articles"), filters)


@query("processed_only", "SELECT id FROM fx_trends WHERE processed = 1", fx=FX)
def q_processed_only(spark, sf):
    return fixture(spark, sf, "fx_trends").filter(F.col("processed") == 1).select("id")


@query("trend_article_listing", f"SELECT id, node_id, article_title FROM ({SQL_LISTING_ROWS})", fx=FXL)
def q_trend_article_listing(spark, sf):
    return _rows(spark, sf).select("id", "node_id", "article_title")


@query("listing_sort", f"SELECT {SQL_FORMAT} FROM ({SQL_LISTING_ROWS}) ORDER BY traffic DESC, id DESC", fx=FXL)
def q_listing_sort(spark, sf):
    return R.listing_format(R.listing_sort(_rows(spark, sf), "traffic"))


@query("listing_page", f"SELECT {SQL_FORMAT} FROM ({SQL_LISTING_ROWS}) ORDER BY imported_at DESC, id DESC LIMIT 25 OFFSET 75",
       fx=FXL)
def q_listing_page(spark, sf):
    return R.listing_format(R.listing_page(_rows(spark, sf), page=3))


@query("listing_keyset_page", f"SELECT {SQL_FORMAT} FROM ({SQL_LISTING_ROWS}) WHERE id < 30000 ORDER BY id DESC LIMIT 25",
       fx=FXL)
def q_listing_keyset(spark, sf):
    return R.listing_format(R.keyset_page(_rows(spark, sf), last_id=30000))


@query("numeric_filter", "SELECT id, traffic FROM fx_trends WHERE traffic BETWEEN 100 AND 200 AND node_id IS NOT NULL", fx=FX)
def q_numeric_filter(spark, sf):
    t = fixture(spark, sf, "fx_trends")
    return t.filter(R.numeric_filter("traffic", "between", 100, 200) & R.numeric_filter("node_id", "is not null")).select("id", "traffic")


@query("string_filter", "SELECT id, title FROM fx_trends WHERE contains(title, 'URGENT') AND NOT starts_with(title, 'trend 1')",
       fx=FX)
def q_string_filter(spark, sf):
    t = fixture(spark, sf, "fx_trends")
    return t.filter(R.string_filter("title", "contains", "URGENT") & ~R.string_filter("title", "startswith", "trend 1")).select("id", "title")


@query("date_boolean_filter", """
SELECT id, pub_date, imported_at FROM fx_trends
WHERE pub_date >= timestamp '1996-01-01' AND pub_date < timestamp '1997-01-01'
  AND make_timestamp(imported_at * 1000000) >= timestamp '1996-06-01' AND processed = 0""", fx=FX)
def q_date_filter(spark, sf):
    t = fixture(spark, sf, "fx_trends")
    cond = (R.date_filter("pub_date", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1))
            & R.date_filter("imported_at", dt.datetime(1996, 6, 1)) & R.processed_filter(False))
    return t.filter(cond).select("id", "pub_date", "imported_at")


@query("contextual_argument", "SELECT id, title, traffic FROM fx_trends WHERE title = 'trend 7 1-URGENT'", fx=FX)
def q_argument(spark, sf):
    return fixture(spark, sf, "fx_trends").filter(R.argument("title", "trend 7 1-URGENT")).select("id", "title", "traffic")


@query("report_format", f"SELECT {SQL_FORMAT} FROM ({SQL_LISTING_ROWS})", fx=FXL)
def q_report_format(spark, sf):
    return R.listing_format(_rows(spark, sf))


@query("dashboard_format", """
SELECT id, title, concat(format('{:,}', traffic), 'K+') AS traffic_text,
  strftime(make_timestamp(imported_at * 1000000), '%Y-%m-%d %H:%M') AS imported_text,
  CASE WHEN processed = 1 THEN 'Yes' ELSE 'No' END AS processed_text,
  CASE WHEN processing_cost IS NULL THEN 'N/A' ELSE concat('$', cast(cast(processing_cost AS decimal(10,4)) AS varchar)) END AS cost_text,
  node_id
FROM (SELECT * FROM fx_trends ORDER BY id DESC LIMIT 5)""", fx=FX)
def q_dashboard_format(spark, sf):
    return R.recent_trends_display(fixture(spark, sf, "fx_trends"))


_NEWS = """(SELECT n.trend_id * 10000000000 + n.news_pos AS news_id, n.trend_id, n.title AS news_title, n.url AS news_url, n.source,
  t.title, t.traffic, t.processed FROM fx_news_items n LEFT JOIN fx_trends t ON t.id = n.trend_id)"""
_NEWS_COLS = "news_id, trend_id, news_title, news_url, source, title, traffic, processed"
FXN = ("fx_trends", "fx_news_items")


def _news(spark, sf, filters=()):
    n = fixture(spark, sf, "fx_news_items").withColumn("id", F.col("trend_id") * 10000000000 + F.col("news_pos"))
    return R.news_rows(n, fixture(spark, sf, "fx_trends"), filters).select(*_NEWS_COLS.split(", "))


@query("news_listing_page", f"SELECT {_NEWS_COLS} FROM {_NEWS} WHERE traffic >= 100 AND starts_with(source, 'Source 1') ORDER BY news_id DESC LIMIT 25 OFFSET 50",
       fx=FXN)
def q_news_listing(spark, sf):
    """The report over news items: filters on the item and its trend, newest first, third page."""
    return R.news_page(_news(spark, sf, [F.col("traffic") >= 100, R.string_filter("source", "startswith", "Source 1")]), page=2)


@query("news_filters", f"""SELECT {_NEWS_COLS} FROM {_NEWS} WHERE news_id BETWEEN 1000000000000 AND 90000000000000 AND trend_id <> 700
  AND (contains(news_title, '7') OR source = 'Source 3')""", fx=FXN)
def q_news_filters(spark, sf):
    return _news(spark, sf, [R.numeric_filter("news_id", "between", 1000000000000, 90000000000000), R.numeric_filter("trend_id", "<>", 700),
                             R.string_filter("news_title", "contains", "7") | R.string_filter("source", "=", "Source 3")])


@query("news_argument", f"SELECT {_NEWS_COLS} FROM {_NEWS} WHERE trend_id = (SELECT min(trend_id) FROM fx_news_items)", fx=FXN)
def q_news_argument(spark, sf):
    first = fixture(spark, sf, "fx_news_items").agg(F.min("trend_id")).first()[0]
    return _news(spark, sf, [R.argument("trend_id", first)])


@query("news_keyset_page", f"SELECT {_NEWS_COLS} FROM {_NEWS} WHERE news_id < 50000000000000 ORDER BY news_id DESC LIMIT 25", fx=FXN)
def q_news_keyset(spark, sf):
    return R.news_keyset_page(_news(spark, sf), 50000000000000)
