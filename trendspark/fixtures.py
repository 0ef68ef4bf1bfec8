"""Fixture views over the driver's tables (FIXTURES.md).

Each view is written once as SQL with ``{table}`` placeholders and ``$snippet``
dialect holes. Spark runs it through ``spark.sql(text, **dataframes)`` so the
view is a lazy plan over the parquet scans (no temp-view name collisions);
DuckDB runs the same text as a CTE in the oracle queries. Both engines
therefore read the same input for an operator and its oracle.
"""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_DIALECT = {
    "spark": {
        "epoch_days": "cast(datediff(cast(o_orderdate AS date), date '1970-01-01') AS bigint)",
        "response_json": "substr(to_json(named_struct('t', response)), 6, length(to_json(named_struct('t', response))) - 6)",
    },
    "duckdb": {
        "epoch_days": "cast(date_diff('day', date '1970-01-01', cast(o_orderdate AS date)) AS bigint)",
        "response_json": "cast(to_json(response) AS varchar)",
        "n_pages": "(SELECT count(*) FROM pages)",
    },
}

FX_SQL: dict[str, str] = {
    # parsed feed rows before ingest; repeated (title, pub_date) on purpose
    "fx_feed_items": """
SELECT o_orderkey AS feed_pos,
  concat('trend ', cast(o_custkey % 50 AS varchar(20))) AS title,
  CASE o_orderkey % 5
    WHEN 0 THEN concat(cast(o_custkey % 500 AS varchar(20)), 'K+')
    WHEN 1 THEN concat(cast(o_custkey % 9 AS varchar(20)), '.', cast(o_custkey % 10 AS varchar(20)), 'm+')
    WHEN 2 THEN '1,000+'
    WHEN 3 THEN concat(' ', cast(o_custkey AS varchar(20)), '+')
    ELSE 'n/a' END AS approx_traffic,
  CASE WHEN o_orderkey % 97 = 0 THEN 'not a date'
    ELSE concat('1 ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * month(o_orderdate) - 2 AS int), 3), ' ',
                cast(year(o_orderdate) AS varchar(20)), ' 00:00:00 +0000') END AS pub_date_raw,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE cast(date_trunc('month', o_orderdate) AS timestamp) END AS pub_date,
  concat('https://trends.example.org/t/', cast(o_orderkey AS varchar(20))) AS link,
  concat('snippet ', o_orderpriority) AS snippet,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('https://img.example.org/main/', cast(o_orderkey AS varchar(20)), '.png') END AS picture
FROM {orders}""",
    # child rows of a trend; news_pos is the document order inside a trend
    "fx_news_items": """
SELECT cast(l_linenumber AS bigint) * 1000000000 + l_partkey * 1000 + l_suppkey AS news_pos,
  l_orderkey AS trend_id,
  concat('news ', cast(l_partkey AS varchar(20))) AS title,
  concat('about ', l_returnflag, l_linestatus) AS snippet,
  p.url AS url,
  concat('Source ', cast(l_suppkey % 20 AS varchar(20))) AS source
FROM {lineitem} JOIN {pages} p ON p.page_id = l_partkey % $n_pages""",
    # stored trends, the 11 reference columns
    "fx_trends": """
SELECT o_orderkey AS id,
  concat('trend ', cast(o_custkey % 50 AS varchar(20)), ' ', o_orderpriority) AS title,
  cast(floor(o_totalprice / 1000) AS bigint) AS traffic,
  cast(o_orderdate AS timestamp) AS pub_date,
  concat('https://trends.example.org/t/', cast(o_orderkey AS varchar(20))) AS link,
  concat('snippet ', o_orderpriority) AS snippet,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('https://img.example.org/main/', cast(o_orderkey AS varchar(20)), '.png') END AS image_url,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS processed,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN o_orderkey + 100000 END AS node_id,
  $epoch_days * 86400 AS imported_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN cast(o_totalprice / 1000000 AS decimal(10,6)) END AS processing_cost
FROM {orders}""",
    # keys already stored before an ingest run (urgent orders' trend keys)
    "fx_stored_keys": """
SELECT DISTINCT concat('trend ', cast(o_custkey % 50 AS varchar(20))) AS title,
  cast(date_trunc('month', o_orderdate) AS timestamp) AS pub_date
FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    # scraped HTML with iframes (four URL styles, one with no match) and images
    "fx_pages": """
SELECT page_id, url, concat(html,
  CASE page_id % 6
    WHEN 0 THEN concat('<iframe src="//www.youtube.com/embed/yt', cast(page_id AS varchar(20)), '?rel=0"></iframe>')
    WHEN 1 THEN concat('<iframe width="5" src="https://youtu.be/sh', cast(page_id AS varchar(20)), '"></iframe>')
    WHEN 2 THEN concat('<iframe src="https://player.vimeo.com/video/', cast(page_id + 1000 AS varchar(20)), '"></iframe>')
    WHEN 3 THEN '<iframe src="https://www.youtube.com/watch?v=abc"></iframe>'
    WHEN 4 THEN '<iframe src="https://maps.example.org/x"></iframe>'
    ELSE '' END,
  '<img src="https://img.example.org/p', cast(page_id % 40 AS varchar(20)), '.jpeg">',
  '<img src="https://img.example.org/p', cast(page_id % 7 AS varchar(20)), '.PNG">') AS html
FROM {pages}""",
    # image candidates with dimensions; URLs repeat inside a trend
    "fx_images": """
SELECT l_orderkey AS trend_id,
  cast(l_linenumber AS bigint) * 1000000000 + l_partkey * 1000 + l_suppkey AS news_pos,
  concat('https://img.example.org/', cast(l_partkey % 400 AS varchar(20)), CASE l_partkey % 4 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.webp' ELSE '?w=1' END) AS url,
  CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE cast(l_partkey % 400 AS int) END AS width,
  CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE cast(l_partkey % 300 + 1 AS int) END AS height,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'alt' END AS alt
FROM {lineitem}""",
    # landed image sizes by URL (what a probe of each image would return)
    "fx_image_meta": """
SELECT concat('https://img.example.org/p', cast(p_partkey AS varchar(20)), CASE WHEN p_partkey % 2 = 0 THEN '.jpeg' ELSE '.PNG' END) AS url,
  cast(p_size * 10 AS int) AS width, cast((p_partkey % 5) * p_size AS int) AS height
FROM {part}""",
    # landed probe results: HEAD status of youtube maxres thumbnails, vimeo JSON bodies
    "fx_url_status": """
SELECT concat('https://img.youtube.com/vi/yt', cast(page_id AS varchar(20)), '/maxresdefault.jpg') AS url,
  CASE WHEN page_id % 12 = 0 THEN 200 ELSE 404 END AS status, '' AS body
FROM {pages} WHERE page_id % 6 = 0
UNION ALL
SELECT concat('https://vimeo.com/api/v2/video/', cast(page_id + 1000 AS varchar(20)), '.json') AS url, 200 AS status,
  CASE WHEN page_id % 4 = 0 THEN '[]' ELSE concat('[{{"id": ', cast(page_id + 1000 AS varchar(20)), ', "thumbnail_large": "https://i.vimeocdn.com/video/', cast(page_id + 1000 AS varchar(20)), '_640.jpg"}}]') END AS body
FROM {pages} WHERE page_id % 6 = 2""",
    # model answers with usage
    "fx_ai_calls": """
SELECT conv_id * 100 + turn AS call_id, conv_id * 3 AS trend_id,
  concat('trend ', cast(conv_id AS varchar(20))) AS trend_title,
  CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'claude' END AS provider,
  CASE conv_id % 6 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'claude-3-haiku-20240307' WHEN 2 THEN 'gpt-4o'
    WHEN 3 THEN 'claude-3-5-sonnet-20241022' WHEN 4 THEN 'no-such-model' ELSE 'claude-3-opus-20240229' END AS model,
  concat(CASE WHEN turn % 3 = 0 THEN '' ELSE concat('Title ', cast(conv_id AS varchar(20)), ' ---TITLE_SEPARATOR---') END,
    text, CASE WHEN conv_id % 2 = 0 THEN '' ELSE '---TAGS_SEPARATOR--- NATION_1, NATION_99, , 0, NATION_3,NATION_1' END) AS response,
  CASE WHEN conv_id % 11 = 0 THEN NULL ELSE cast(length(text) AS bigint) * 3 END AS input_tokens,
  cast(length(text) AS bigint) AS output_tokens
FROM {conversations} WHERE role = 'assistant'""",
    "fx_vocab": """
SELECT cast(n_nationkey AS bigint) AS tid, 'tags' AS vid, n_name AS name FROM {nation}
UNION ALL SELECT cast(900 AS bigint), 'tags', 'NATION_1' UNION ALL SELECT cast(901 AS bigint), 'other', 'NATION_99'""",
    "fx_users": """
SELECT c_custkey AS uid, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS status FROM {customer}""",
    "fx_languages": """
SELECT 'en' AS langcode, 'English' AS name, 1 AS is_default UNION ALL SELECT 'fr', 'French', 0
UNION ALL SELECT 'de', 'German', 0 UNION ALL SELECT 'es', 'Spanish', 0""",
    "fx_articles": """
SELECT doc_id AS node_id, substr(text, 1, 80) AS title, text AS body, 'en' AS langcode FROM {documents} WHERE lang = 'en'""",
    "fx_translations": """
SELECT doc_id AS node_id, CASE doc_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'es' END AS langcode
FROM {documents} WHERE lang = 'en' AND doc_id % 5 = 0""",
    # landed translation answers, one per (article, language); a third lack the separator
    "fx_translation_calls": """
SELECT doc_id AS node_id, 'fr' AS langcode,
  CASE WHEN doc_id % 3 = 0 THEN concat(' ', substr(text, 1, 40), ' ')
    ELSE concat(' T-fr ', cast(doc_id AS varchar(20)), ' ---TITLE_SEPARATOR--- ', substr(text, 1, 200), ' ') END AS response
FROM {documents} WHERE lang = 'en'
UNION ALL
SELECT doc_id AS node_id, 'de' AS langcode,
  CASE WHEN doc_id % 3 = 0 THEN concat(' ', substr(text, 1, 40), ' ')
    ELSE concat(' T-de ', cast(doc_id AS varchar(20)), ' ---TITLE_SEPARATOR--- ', substr(text, 1, 200), ' ') END AS response
FROM {documents} WHERE lang = 'en'
UNION ALL
SELECT doc_id AS node_id, 'es' AS langcode,
  CASE WHEN doc_id % 3 = 0 THEN concat(' ', substr(text, 1, 40), ' ')
    ELSE concat(' T-es ', cast(doc_id AS varchar(20)), ' ---TITLE_SEPARATOR--- ', substr(text, 1, 200), ' ') END AS response
FROM {documents} WHERE lang = 'en' AND doc_id % 2 = 0""",
}

# rows a foreign key would refuse, pages that never landed, and pages without text
FX_SQL["fx_late_news"] = """
SELECT cast(l_linenumber AS bigint) * 1000000000 + l_partkey * 1000 + l_suppkey AS news_pos, CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS trend_id,
  concat('news ', cast(l_partkey AS varchar(20))) AS title, 'about' AS snippet,
  CASE l_partkey % 9 WHEN 0 THEN concat('https://gone.example.org/', cast(l_partkey AS varchar(20))) WHEN 1 THEN NULL ELSE p.url END AS url,
  concat('Source ', cast(l_suppkey % 20 AS varchar(20))) AS source
FROM {lineitem} JOIN {pages} p ON p.page_id = l_partkey % $n_pages WHERE l_linenumber <= 2"""
FX_SQL["fx_thin_pages"] = """
SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<html><head><title>t</title></head><body><nav>menu</nav></body></html>'
  WHEN 2 THEN NULL ELSE html END AS html FROM {pages}"""
# files that landed, with their lengths; a third of the images have none or an empty one
FX_SQL["fx_landed"] = """
SELECT DISTINCT concat('https://img.example.org/', cast(l_partkey % 400 AS varchar(20)),
    CASE l_partkey % 4 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.webp' ELSE '?w=1' END) AS url,
  cast(CASE WHEN l_partkey % 400 % 7 = 0 THEN 0 ELSE 1000 END AS bigint) AS length
FROM {lineitem} WHERE l_partkey % 400 % 5 <> 0"""
# the same answers as the providers send them: both layouts, both spellings of the usage counters, counts written as text, no
# usage at all, cut-off and other broken bodies, answers without text
FX_SQL["fx_raw_answers"] = """
SELECT call_id, trend_id, trend_title, provider, model, CASE call_id % 23
  WHEN 3 THEN substr(body, 1, cast(floor(length(body) / 2) AS int)) WHEN 5 THEN 'Bad gateway' WHEN 7 THEN NULL
  WHEN 11 THEN '{{"choices": [], "content": [], "usage": {{}}}}' ELSE body END AS json
FROM (SELECT c.*, CASE WHEN provider = 'claude'
    THEN concat('{{"id": "m", "content": [{{"type": "text", "text": ', text_json, '}}], "usage": {{"input_tokens": ', tokens_in,
                ', "output_tokens": ', tokens_out, '}}}}')
    WHEN call_id % 23 = 13 THEN concat('{{"choices": [{{"message": {{"role": "assistant", "content": ', text_json, '}}}}]}}')
    WHEN call_id % 2 = 0 THEN concat('{{"choices": [{{"message": {{"content": ', text_json, '}}}}], "usage": {{"promptTokens": ', tokens_in,
                ', "completionTokens": "', tokens_out, '"}}}}')
    ELSE concat('{{"choices": [{{"message": {{"content": ', text_json, '}}}}], "usage": {{"prompt_tokens": ', tokens_in,
                ', "completion_tokens": ', tokens_out, '}}}}') END AS body
  FROM (SELECT *, $response_json AS text_json, coalesce(cast(input_tokens AS varchar(20)), 'null') AS tokens_in,
          cast(output_tokens AS varchar(20)) AS tokens_out FROM (""" + FX_SQL["fx_ai_calls"] + """) a) c) b"""

_TABLE_RE = re.compile(r"\{([a-z_]+)\}")


def _render(name: str, dialect: str, extra: dict | None = None) -> str:
    return Template(FX_SQL[name]).substitute({**_DIALECT[dialect], **(extra or {})})


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy parquet scans of the driver tables."""
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in BASE_TABLES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark plan over the parquet tables."""
    extra = {}
    if "$n_pages" in FX_SQL[name]:
        # Spark 4.1 can fail a scalar subquery under some later plans ("Subquery ...
        # has not finished"), so the fixture's page count is taken once as a literal.
        extra["n_pages"] = str(table(spark, sf_dir, "pages").count())
    text = _render(name, "spark", extra)
    used = sorted(set(_TABLE_RE.findall(text)))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def duck_with(*names: str) -> str:
    """``WITH fx_a AS (...), ...`` prefix for a DuckDB oracle query."""
    parts = []
    for n in names:
        text = _TABLE_RE.sub(lambda m: m.group(1), _render(n, "duckdb")).replace("{{", "{").replace("}}", "}")
        parts.append(f"{n} AS ({text}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
