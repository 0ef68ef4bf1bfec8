"""O-P1 ingest: typed feed items -> status per item -> accepted rows, news, audit, summary.

The reference walks the feed in order and, per item, checks traffic, date, TLD,
stored key and an in-run duplicate, stopping at ``max_trends`` accepted items.
Here the same decisions are one ``status`` column computed set-at-a-time; the
order only matters for the keep-first rule and the cap, both of which are
expressed with feed positions instead of a loop.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendspark.functions import parse_pub_date, parse_tld_list, parse_traffic, url_host
from trendspark.functions.text import let
from trendspark.operators.common import global_index
from trendspark.params import Params

# The item outcomes, in the order the reference checks them.
ACCEPTED = "accepted"
SKIPPED_TRAFFIC = "skipped_traffic"
BAD_DATE = "bad_date"
FILTERED_TLD = "filtered_tld"
DUPLICATE_STORED = "duplicate_stored"
DUPLICATE_IN_FEED = "duplicate_in_feed"
AFTER_CAP = "after_cap"
TOO_LONG = "too_long"
STATUSES = [ACCEPTED, SKIPPED_TRAFFIC, BAD_DATE, FILTERED_TLD, DUPLICATE_STORED, TOO_LONG, DUPLICATE_IN_FEED, AFTER_CAP]
# Column bounds of the stored trends table.
MAX_TITLE = 255
MAX_LINK = 2048

KEY = ["title", "pub_date"]


def typed_items(raw: DataFrame) -> DataFrame:
    """Feed rows (feed_pos, title, approx_traffic, pub_date_raw, link, snippet, picture)
    -> + traffic BIGINT (O-X1), pub_date TIMESTAMP (O-X3)."""
    return raw.withColumn("traffic", parse_traffic(F.col("approx_traffic"))).withColumn(
        "pub_date", parse_pub_date(F.col("pub_date_raw"))
    )


def min_traffic_pass(items: DataFrame, params: Params) -> DataFrame:
    """O-F1: keep traffic >= min; NULL or 0 disables the check."""
    m = params.min_traffic_effective
    return items if m is None else items.filter(F.col("traffic") >= F.lit(m))


def valid_pub_date(items: DataFrame) -> DataFrame:
    """O-F2: drop items whose date does not parse."""
    return items.filter(F.col("pub_date").isNotNull())


def tld_flagged(news: DataFrame, params: Params, key: str = "feed_pos") -> DataFrame:
    """O-F3 / O-J11: keys of items with at least one child URL whose host is a listed
    suffix or ends in ``.suffix`` (:func:`host_suffixes`): the host, found once a URL, with a dot before it
    is tested against each of the (parameter-sized) list; blank URLs and URLs
    without a host never match. One row per flagged key."""
    tlds = parse_tld_list(params.filtered_tlds)
    if not tlds:
        return news.select(key).limit(0)
    host = F.concat(F.lit("."), url_host(F.col("url")))
    listed = let(host, lambda h: reduce(or_, [F.endswith(h, F.lit(f".{t}")) for t in tlds]))
    hit = news.filter(F.coalesce(F.col("url"), F.lit("")) != "").filter(listed)
    return hit.select(key).distinct()


def _too_long(df: DataFrame):
    cond = F.char_length("title") > MAX_TITLE
    if "link" in df.columns:
        cond = cond | (F.char_length("link") > MAX_LINK)
    return cond


def precheck(items: DataFrame, news: DataFrame, stored_keys: DataFrame, params: Params) -> DataFrame:
    """``_pre``: the outcome of the checks that look at one item alone (traffic, date, TLD, stored key, column bounds), in
    check order; NULL for a candidate."""
    m = params.min_traffic_effective
    flagged = tld_flagged(news, params).withColumn("_tld", F.lit(True))
    stored = stored_keys.select(*KEY).distinct().withColumn("_stored", F.lit(True))
    x = items.join(flagged, "feed_pos", "left").join(stored, KEY, "left")
    pre = (
        F.when(F.lit(m).isNotNull() & (F.col("traffic") < F.lit(m)), F.lit(SKIPPED_TRAFFIC))
        .when(F.col("pub_date").isNull(), F.lit(BAD_DATE))
        .when(F.col("_tld").isNotNull(), F.lit(FILTERED_TLD))
        .when(F.col("_stored").isNotNull(), F.lit(DUPLICATE_STORED))
        # the stored columns are bounded (title 255, link 2048): such rows would fail the insert
        .when(_too_long(x), F.lit(TOO_LONG))
    )
    return x.withColumn("_pre", pre).drop("_tld", "_stored")


def item_status(items: DataFrame, news: DataFrame, stored_keys: DataFrame, params: Params) -> DataFrame:
    """Status per feed item in check order (traffic, date, TLD, stored, in-feed duplicate).

    The in-feed rule keeps the first item per (title, pub_date) among those passing
    the earlier checks. It is a min(feed_pos) aggregate (partial, so a hot key is
    reduced map-side) joined back on (title, pub_date, feed_pos), a key that stays
    evenly spread however skewed the title is."""
    x = precheck(items, news, stored_keys, params)
    # conditional aggregate over the unfiltered frame: both branches share one
    # subtree, so its shuffles are computed once and reused
    firsts = (
        x.groupBy(*KEY)
        .agg(F.min(F.when(F.col("_pre").isNull(), F.col("feed_pos"))).alias("feed_pos"))
        .filter(F.col("feed_pos").isNotNull())
        .withColumn("_first", F.lit(True))
    )
    # null-safe keys: no inferred IS NOT NULL filter is pushed into one branch only,
    # so both sides keep the same subtree and Spark reuses its exchanges
    xa, fa = x.alias("x"), firsts.alias("f")
    cond = None
    for c in KEY + ["feed_pos"]:
        e = F.col(f"x.{c}").eqNullSafe(F.col(f"f.{c}"))
        cond = e if cond is None else cond & e
    x = xa.join(fa, cond, "left").select("x.*", F.col("f._first").alias("_first"))
    status = F.coalesce(
        F.col("_pre"), F.when(F.col("_first").isNotNull(), F.lit(ACCEPTED)).otherwise(F.lit(DUPLICATE_IN_FEED))
    )
    return x.withColumn("status", status).drop("_pre", "_first")


def not_yet_stored(items: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """O-F4: drop items whose (title, pub_date) is already stored."""
    return items.join(stored_keys.select(*KEY), KEY, "left_anti")


def dedupe_in_feed(items: DataFrame) -> DataFrame:
    """O-F5: first item per (title, pub_date) by feed position."""
    firsts = items.groupBy(*KEY).agg(F.min("feed_pos").alias("_first"))
    i, f = items.alias("i"), firsts.alias("f")
    # null-safe on the key so a NULL date groups like GROUP BY does
    cond = (F.col("i.title").eqNullSafe(F.col("f.title")) & F.col("i.pub_date").eqNullSafe(F.col("f.pub_date"))
            & (F.col("i.feed_pos") == F.col("f._first")))
    return i.join(f, cond, "left_semi")


def ingest_cap(status: DataFrame, params: Params) -> DataFrame:
    """O-S1: the first ``max_trends`` accepted items in feed order (top-k, no global sort)."""
    return status.filter(F.col("status") == ACCEPTED).orderBy("feed_pos").limit(params.cap)


def cutoff_pos(status: DataFrame, params: Params):
    """Scalar: feed_pos of the cap-th accepted item, NULL when the cap was not reached."""
    capped = ingest_cap(status, params).select("feed_pos")
    one = capped.agg(F.when(F.count(F.lit(1)) >= params.cap, F.max("feed_pos")).alias("c"))
    return one.scalar()


def with_run_status(status: DataFrame, params: Params) -> DataFrame:
    """Status as the reference's loop would see it: items after the cap-th
    accepted one were never looked at (``after_cap``)."""
    c = cutoff_pos(status, params)
    return status.withColumn(
        "status", F.when(c.isNull() | (F.col("feed_pos") <= c), F.col("status")).otherwise(F.lit(AFTER_CAP))
    )


def ingest_summary(status: DataFrame, params: Params) -> DataFrame:
    """O-A12: counts per outcome for the items the run looked at, plus ``after_cap``."""
    return (
        with_run_status(status, params)
        .groupBy("status")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_items"))
    )


def assign_ids(accepted: DataFrame, trends: DataFrame | None) -> DataFrame:
    """Serial ids for the <= cap accepted rows: max stored id + position in feed order.
    The window runs over at most ``max_trends`` rows."""
    base = F.lit(0).cast("bigint") if trends is None else F.coalesce(trends.agg(F.max("id")).scalar(), F.lit(0)).cast("bigint")
    return accepted.withColumn("id", base + F.row_number().over(Window.orderBy("feed_pos")).cast("bigint"))


def append_trends(accepted_with_ids: DataFrame, params: Params) -> DataFrame:
    """O-SNK1: rows to append with the reference defaults."""
    return accepted_with_ids.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("title"),
        F.col("traffic").cast("bigint").alias("traffic"),
        F.col("pub_date"),
        F.col("link"),
        F.col("snippet"),
        F.col("picture").alias("image_url"),
        F.lit(0).alias("processed"),
        F.lit(None).cast("bigint").alias("node_id"),
        F.lit(params.as_of_epoch).cast("bigint").alias("imported_at"),
        F.lit(None).cast("decimal(10,6)").alias("processing_cost"),
    )


def append_news(news: DataFrame, accepted_with_ids: DataFrame, last_id: int = 0) -> DataFrame:
    """O-SNK2: children of accepted items only, carrying the new trend id and a serial id of their own, from ``last_id`` on in the
    order of trends and positions; numbered in parallel."""
    acc = accepted_with_ids.select("feed_pos", F.col("id").alias("trend_id"))
    rows = news.join(acc, "feed_pos").select("trend_id", "news_pos", "title", "snippet", "url", "source")
    return global_index(rows, ["trend_id", "news_pos"], "_i").select(
        (F.lit(last_id + 1) + F.col("_i")).cast("bigint").alias("id"), "trend_id", "news_pos", "title", "snippet", "url", "source")


def pending_set(trends: DataFrame) -> DataFrame:
    """O-SNK3: the work queue is derived, never lost: ids with processed = 0."""
    return trends.filter(F.col("processed") == 0).select("id")


def audit_rows(status: DataFrame) -> DataFrame:
    """O-SNK10 (ingest part): one audit row per item that was not accepted."""
    return status.filter(F.col("status") != ACCEPTED).select(
        F.lit("ingest").alias("stage"),
        F.col("feed_pos").cast("string").alias("key"),
        F.col("status").alias("reason"),
        F.col("title").alias("detail"),
    )


def ingest_trends(items_raw: DataFrame, news: DataFrame, stored_trends: DataFrame, params: Params,
                  materialize: bool = False) -> dict[str, DataFrame]:
    """O-P1 composite: returns accepted trends, news, summary and audit frames.

    With ``materialize`` the item statuses and the accepted rows (with their new
    ids) are checkpointed (reliable checkpoint in spark.checkpoint.dir) before
    anything is written: the outputs are then fixed values, not plans that would
    see the run's own appends when evaluated later or recomputed after an
    executor loss."""
    items = typed_items(items_raw)
    if not params.import_enabled:  # O-F16 gate
        items = items.limit(0)
    status = item_status(items, news, stored_trends, params)
    if materialize:
        status = status.checkpoint(eager=True)
    accepted = assign_ids(ingest_cap(status, params), stored_trends if "id" in stored_trends.columns else None)
    if materialize:
        accepted = accepted.checkpoint(eager=True)
    return {
        "status": status,
        "trends": append_trends(accepted, params),
        "news": append_news(news, accepted),
        "summary": ingest_summary(status, params),
        "audit": audit_rows(with_run_status(status, params)),
    }
