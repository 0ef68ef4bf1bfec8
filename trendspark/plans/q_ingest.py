"""O-P1 ingest operators on the fixture feed (fx_feed_items + fx_news_items)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.fixtures import fixture
from trendspark.functions import migrate_traffic, parse_pub_date, parse_traffic, url_host
from trendspark.operators import history as H
from trendspark.operators import ingest as I
from trendspark.params import Params
from trendspark.plans.registry import query

# Fixed test parameters for the registered ingest queries.
P = Params(min_traffic=100, max_trends=5, filtered_tlds=" tionsh.example.NET, cheap-pills.example.com ,, 0, org.zz")
FEED = ("fx_feed_items", "fx_news_items", "fx_stored_keys")

# ---- DuckDB side: the same decisions written as plain SQL -----------------
_TRIM = "trim(approx_traffic, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11))"
SQL_TRAFFIC = f"""CASE WHEN regexp_matches({_TRIM}, '^[0-9.]+') AND NOT contains({_TRIM}, chr(10))
 THEN cast(floor(coalesce(try_cast(regexp_extract(regexp_extract({_TRIM}, '^([0-9.]+)', 1), '^[0-9]*(\\.[0-9]*)?', 0) AS double), 0)
   * CASE upper(regexp_extract({_TRIM}, '^[0-9.]+([KMBkmb])', 1)) WHEN 'M' THEN 1000.0 WHEN 'B' THEN 1000000.0 ELSE 1.0 END) AS bigint)
 ELSE cast(0 AS bigint) END"""
# RFC-822 with numeric offset, parsed without time-zone types: local time minus offset
SQL_PUBDATE = """(try_strptime(regexp_extract(pub_date_raw, '^(?:[A-Za-z]+, *)?(.*) [+-][0-9]{4}$', 1), '%d %b %Y %H:%M:%S')
  - to_minutes(cast(CASE WHEN substr(pub_date_raw, -5, 1) = '-' THEN -1 ELSE 1 END
     * (try_cast(substr(pub_date_raw, -4, 2) AS int) * 60 + try_cast(substr(pub_date_raw, -2, 2) AS int)) AS bigint)))"""
SQL_HOST = "lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:\\[\\]]+)', 1))"

# every host is computed once and cut into its suffixes, so that the list match is an equi-join
CTE_ITEMS = f"""WITH
items AS MATERIALIZED (
  SELECT feed_pos, title, approx_traffic, pub_date_raw, link, snippet, picture,
    {SQL_TRAFFIC} AS traffic, {SQL_PUBDATE} AS pub_date
  FROM fx_feed_items),
hosts AS MATERIALIZED (SELECT trend_id, string_split({SQL_HOST.format(u='url')}, '.') AS parts FROM fx_news_items),
suffixes AS (SELECT trend_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.'))) AS suffix
  FROM hosts WHERE parts[1] <> ''),
flagged AS MATERIALIZED (
  SELECT DISTINCT trend_id AS feed_pos FROM suffixes
  WHERE suffix IN ('tionsh.example.net', 'cheap-pills.example.com', 'org.zz'))"""
_PRE = """CASE
    WHEN i.traffic < 100 THEN 'skipped_traffic'
    WHEN i.pub_date IS NULL THEN 'bad_date'
    WHEN f.feed_pos IS NOT NULL THEN 'filtered_tld'
    {stored}
    WHEN length(i.title) > 255 OR length(i.link) > 2048 THEN 'too_long'
  END"""
CTE_STATUS = CTE_ITEMS + f""",
pre AS MATERIALIZED (
  SELECT i.*, {_PRE.format(stored="WHEN s.title IS NOT NULL THEN 'duplicate_stored'")} AS pre
  FROM items i LEFT JOIN flagged f ON f.feed_pos = i.feed_pos LEFT JOIN fx_stored_keys s ON s.title = i.title AND s.pub_date = i.pub_date),
st AS MATERIALIZED (
  SELECT p.*, coalesce(pre, CASE WHEN feed_pos = min(feed_pos) FILTER (WHERE pre IS NULL) OVER (PARTITION BY title, pub_date)
    THEN 'accepted' ELSE 'duplicate_in_feed' END) AS status FROM pre p),
capped AS (SELECT * FROM st WHERE status = 'accepted' ORDER BY feed_pos LIMIT 5),
cut AS (SELECT CASE WHEN count(*) >= 5 THEN max(feed_pos) END AS c FROM capped),
run AS (SELECT st.*, CASE WHEN cut.c IS NULL OR st.feed_pos <= cut.c THEN status ELSE 'after_cap' END AS run_status
        FROM st, cut)
"""
# documents of 100 positions, one run after the other: what the earlier ones took is carried along
CTE_RUNS = CTE_ITEMS.replace("WITH", "WITH RECURSIVE", 1) + f""",
cand AS MATERIALIZED (
  SELECT dense_rank() OVER (ORDER BY d) AS n, min(feed_pos) AS pos, title, pub_date, title || '|' || pub_date AS k
  FROM (SELECT i.*, floor(i.feed_pos / 100) AS d, {_PRE.format(stored='')} AS pre FROM items i LEFT JOIN flagged f ON f.feed_pos = i.feed_pos)
  WHERE pre IS NULL GROUP BY d, title, pub_date),
runs(n, took, places) AS (
  SELECT cast(0 AS bigint), cast([] AS varchar[]), cast([] AS bigint[])
  UNION ALL
  SELECT r.n + 1, list_concat(any_value(r.took), coalesce(list_slice(list(c.k ORDER BY c.pos) FILTER (WHERE NOT list_contains(r.took, c.k)), 1, 5), [])),
    list_concat(any_value(r.places), coalesce(list_slice(list(c.pos ORDER BY c.pos) FILTER (WHERE NOT list_contains(r.took, c.k)), 1, 5), []))
  FROM runs r JOIN cand c ON c.n = r.n + 1 GROUP BY r.n),
taken AS (SELECT unnest(places) AS feed_pos FROM (SELECT places FROM runs ORDER BY n DESC LIMIT 1))
"""


def _feed(spark, sf):
    return I.typed_items(fixture(spark, sf, "fx_feed_items"))


def _news(spark, sf):
    return fixture(spark, sf, "fx_news_items").withColumnRenamed("trend_id", "feed_pos")


def _status(spark, sf):
    return I.item_status(_feed(spark, sf), _news(spark, sf), fixture(spark, sf, "fx_stored_keys"), P)


@query("parse_traffic", f"SELECT feed_pos, approx_traffic, {SQL_TRAFFIC} AS traffic FROM fx_feed_items", fx=("fx_feed_items",))
def q_parse_traffic(spark, sf):
    f = fixture(spark, sf, "fx_feed_items")
    return f.select("feed_pos", "approx_traffic", parse_traffic(F.col("approx_traffic")).alias("traffic"))


@query("parse_pub_date", f"SELECT feed_pos, pub_date_raw, {SQL_PUBDATE} AS parsed, pub_date AS expected FROM fx_feed_items",
       fx=("fx_feed_items",))
def q_parse_pub_date(spark, sf):
    f = fixture(spark, sf, "fx_feed_items")
    return f.select("feed_pos", "pub_date_raw", parse_pub_date(F.col("pub_date_raw")).alias("parsed"),
                    F.col("pub_date").alias("expected"))


@query("url_host", f"SELECT news_pos, trend_id, {SQL_HOST.format(u='url')} AS host FROM fx_news_items", fx=("fx_news_items",))
def q_url_host(spark, sf):
    n = fixture(spark, sf, "fx_news_items")
    return n.select("news_pos", "trend_id", url_host(F.col("url")).alias("host"))


@query("min_traffic", CTE_STATUS + "SELECT feed_pos, title, traffic FROM items WHERE traffic >= 100", fx=FEED)
def q_min_traffic(spark, sf):
    return I.min_traffic_pass(_feed(spark, sf), P).select("feed_pos", "title", "traffic")


@query("valid_pub_date", CTE_STATUS + "SELECT feed_pos, pub_date FROM items WHERE pub_date IS NOT NULL", fx=FEED)
def q_valid_pub_date(spark, sf):
    return I.valid_pub_date(_feed(spark, sf)).select("feed_pos", "pub_date")


@query("tld_filter", CTE_STATUS + "SELECT feed_pos FROM items WHERE feed_pos NOT IN (SELECT feed_pos FROM flagged)", fx=FEED)
def q_tld_filter(spark, sf):
    return _feed(spark, sf).join(I.tld_flagged(_news(spark, sf), P), "feed_pos", "left_anti").select("feed_pos")


@query("host_suffix_match", CTE_STATUS + "SELECT feed_pos FROM flagged", fx=FEED)
def q_host_suffix_match(spark, sf):
    return I.tld_flagged(_news(spark, sf), P)


@query("not_yet_stored", CTE_STATUS + """SELECT feed_pos, title, pub_date FROM items i
WHERE NOT EXISTS (SELECT 1 FROM fx_stored_keys s WHERE s.title = i.title AND s.pub_date = i.pub_date)""", fx=FEED)
def q_not_yet_stored(spark, sf):
    items = _feed(spark, sf)
    stored = H.stored_keys(fixture(spark, sf, "fx_stored_keys"), items)
    return I.not_yet_stored(items, stored).select("feed_pos", "title", "pub_date")


@query("dedupe_in_feed", CTE_STATUS + """SELECT feed_pos, title, pub_date FROM items
QUALIFY row_number() OVER (PARTITION BY title, pub_date ORDER BY feed_pos) = 1""", fx=FEED)
def q_dedupe_in_feed(spark, sf):
    return I.dedupe_in_feed(_feed(spark, sf)).select("feed_pos", "title", "pub_date")


@query("feed_status", CTE_STATUS + "SELECT feed_pos, title, traffic, pub_date, status FROM st", fx=FEED)
def q_feed_status(spark, sf):
    return _status(spark, sf).select("feed_pos", "title", "traffic", "pub_date", "status")


@query("ingest_cap", CTE_STATUS + "SELECT feed_pos, title, traffic FROM capped", fx=FEED)
def q_ingest_cap(spark, sf):
    return I.ingest_cap(_status(spark, sf), P).select("feed_pos", "title", "traffic")


@query("ingest_summary", CTE_STATUS + "SELECT run_status AS status, cast(count(*) AS bigint) AS n_items FROM run GROUP BY run_status",
       fx=FEED)
def q_ingest_summary(spark, sf):
    return I.ingest_summary(_status(spark, sf), P)


@query("append_trends", CTE_STATUS + """
SELECT cast((SELECT max(id) FROM fx_trends) + row_number() OVER (ORDER BY feed_pos) AS bigint) AS id, title, traffic, pub_date,
  link, snippet, picture AS image_url, 0 AS processed, cast(NULL AS bigint) AS node_id, cast(995198400 AS bigint) AS imported_at,
  cast(NULL AS decimal(10,6)) AS processing_cost
FROM capped""", fx=FEED + ("fx_trends",))
def q_append_trends(spark, sf):
    acc = I.assign_ids(I.ingest_cap(_status(spark, sf), P), fixture(spark, sf, "fx_trends"))
    return I.append_trends(acc, P)


@query("append_news", CTE_STATUS + """
SELECT cast(row_number() OVER (ORDER BY a.id, n.news_pos) AS bigint) AS id, a.id AS trend_id, n.news_pos, n.title, n.snippet, n.url, n.source
FROM (SELECT feed_pos, cast((SELECT max(id) FROM fx_trends) + row_number() OVER (ORDER BY feed_pos) AS bigint) AS id FROM capped) a
JOIN fx_news_items n ON n.trend_id = a.feed_pos""", fx=FEED + ("fx_trends",))
def q_append_news(spark, sf):
    acc = I.assign_ids(I.ingest_cap(_status(spark, sf), P), fixture(spark, sf, "fx_trends"))
    return I.append_news(_news(spark, sf), acc)


@query("pending_set", "SELECT id FROM fx_trends WHERE processed = 0", fx=("fx_trends",))
def q_pending_set(spark, sf):
    return I.pending_set(fixture(spark, sf, "fx_trends"))


@query("audit_ingest", CTE_STATUS + """
SELECT 'ingest' AS stage, cast(feed_pos AS varchar) AS key, run_status AS reason, title AS detail FROM run WHERE run_status <> 'accepted'""",
       fx=FEED)
def q_audit_ingest(spark, sf):
    return I.audit_rows(I.with_run_status(_status(spark, sf), P))


_KEPT = "regexp_replace(approx_traffic, '[^0-9.]', '', 'g')"
_DEC = f"try_cast(CASE WHEN regexp_extract({_KEPT}, '^[0-9]*(\\.[0-9]*)?', 0) IN ('', '.') THEN '0' ELSE regexp_extract({_KEPT}, '^[0-9]*(\\.[0-9]*)?', 0) END AS decimal(10,2))"
_WHOLE = f"try_cast(CASE WHEN regexp_extract({_KEPT}, '^[0-9]*', 0) = '' THEN '0' ELSE regexp_extract({_KEPT}, '^[0-9]*', 0) END AS bigint)"


@query("migrate_traffic", f"""
SELECT feed_pos, approx_traffic,
  CASE WHEN coalesce(approx_traffic, '') = '' THEN cast(0 AS bigint)
    WHEN upper(approx_traffic) LIKE '%M%' THEN cast(round({_DEC} * 1000) AS bigint)
    WHEN upper(approx_traffic) LIKE '%B%' THEN cast(round({_DEC} * 1000000) AS bigint)
    ELSE {_WHOLE} END AS traffic
FROM fx_feed_items""", fx=("fx_feed_items",))
def q_migrate_traffic(spark, sf):
    f = fixture(spark, sf, "fx_feed_items")
    return f.select("feed_pos", "approx_traffic", migrate_traffic(F.col("approx_traffic")).alias("traffic"))

