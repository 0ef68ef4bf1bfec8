"""O-P2 prompt building on fx_trends (pending) + fx_news_items + fx_pages + fx_vocab.

Long texts are checked through md5 + length so the check reads whole texts but
compares small values."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.fixtures import fixture
from trendspark.functions import html_to_text, main_content, page_title, scraped_piece
from trendspark.functions.text import meaningful
from trendspark.operators import prompts as PR
from trendspark.params import Params
from trendspark.plans import duck_text as D
from trendspark.plans.registry import query

P = Params(tag_vocabulary="tags")
FX = ("fx_trends", "fx_news_items", "fx_pages", "fx_vocab")


def _digest(c, name):
    return [F.md5(c).alias(f"{name}_md5"), F.char_length(c).cast("bigint").alias(f"{name}_len")]


def _sql_digest(x, name):
    return f"md5({x}) AS {name}_md5, cast(length({x}) AS bigint) AS {name}_len"


SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
CTE = f"""WITH
pg AS (SELECT url, arg_min(html, page_id) AS html FROM fx_pages GROUP BY url),
pgc AS (SELECT url, html, {D.main_content('html')} AS content FROM pg),
pieces AS (SELECT url, {D.scraped_piece('html', 'content')} AS piece FROM pgc),
pend AS (SELECT id, title FROM fx_trends WHERE processed = 0),
np AS (SELECT n.trend_id, n.news_pos, coalesce(p.piece, '') AS piece
       FROM fx_news_items n JOIN pend ON pend.id = n.trend_id LEFT JOIN pieces p ON p.url = n.url),
tt AS (SELECT trend_id, string_agg(piece || {SEP}, '' ORDER BY news_pos) AS text,
         max(CASE WHEN {D.php_trim('piece')} <> '' THEN 1 ELSE 0 END) AS has_text FROM np GROUP BY trend_id),
tags AS (SELECT coalesce(string_agg(name, ', ' ORDER BY name, tid), 'No tags available') AS tags_list FROM fx_vocab WHERE vid = 'tags')
"""


def _t(spark, sf, name):
    return fixture(spark, sf, name)


@query("trends_scan", "SELECT id, title FROM fx_trends WHERE processed = 0", fx=("fx_trends",))
def q_trends_scan(spark, sf):
    return PR.pending_trends(_t(spark, sf, "fx_trends")).select("id", "title")


@query("news_scan", "SELECT n.trend_id, n.news_pos, n.url FROM fx_news_items n WHERE n.trend_id IN (SELECT id FROM fx_trends WHERE processed = 0)",
       fx=("fx_trends", "fx_news_items"))
def q_news_scan(spark, sf):
    pend = PR.pending_trends(_t(spark, sf, "fx_trends"))
    return PR.news_of_pending(_t(spark, sf, "fx_news_items"), pend).select("trend_id", "news_pos", "url")


@query("news_of_trend", "SELECT n.news_pos, n.trend_id, t.title AS trend_title, n.url FROM fx_news_items n JOIN fx_trends t ON n.trend_id = t.id",
       fx=("fx_trends", "fx_news_items"))
def q_news_of_trend(spark, sf):
    t = _t(spark, sf, "fx_trends").select(F.col("id").alias("trend_id"), F.col("title").alias("trend_title"))
    return _t(spark, sf, "fx_news_items").join(t, "trend_id").select("news_pos", "trend_id", "trend_title", "url")


@query("news_to_trend_report", """
SELECT n.news_pos, n.trend_id, n.source, t.title AS trend_title, t.traffic FROM fx_news_items n LEFT JOIN fx_trends t ON n.trend_id = t.id""",
       fx=("fx_trends", "fx_news_items"))
def q_news_to_trend(spark, sf):
    t = _t(spark, sf, "fx_trends").select(F.col("id").alias("trend_id"), F.col("title").alias("trend_title"), "traffic")
    return _t(spark, sf, "fx_news_items").join(t, "trend_id", "left").select("news_pos", "trend_id", "source", "trend_title", "traffic")


@query("orphan_news", "SELECT n.news_pos, n.trend_id, n.url FROM fx_late_news n WHERE NOT EXISTS (SELECT 1 FROM fx_trends t WHERE t.id = n.trend_id)",
       fx=("fx_trends", "fx_late_news"))
def q_orphan_news(spark, sf):
    t = _t(spark, sf, "fx_trends").select(F.col("id").alias("trend_id"))
    return _t(spark, sf, "fx_late_news").join(t, "trend_id", "left_anti").select("news_pos", "trend_id", "url")


@query("page_source", f"""
SELECT n.trend_id, n.news_pos, n.url, {_sql_digest("coalesce(pg.html, '')", 'html')}
FROM fx_news_items n LEFT JOIN (SELECT url, arg_min(html, page_id) AS html FROM fx_pages GROUP BY url) pg ON pg.url = n.url""",
       fx=("fx_news_items", "fx_pages"))
def q_page_source(spark, sf):
    df = PR.page_source(_t(spark, sf, "fx_news_items"), _t(spark, sf, "fx_pages"))
    return df.select("trend_id", "news_pos", "url", *_digest(F.col("html"), "html"))


@query("page_lookup", "SELECT n.news_pos, n.trend_id, p.page_id FROM fx_news_items n LEFT JOIN (SELECT url, min(page_id) AS page_id FROM fx_pages GROUP BY url) p "
       "ON p.url = n.url",
       fx=("fx_news_items", "fx_pages"))
def q_page_lookup(spark, sf):
    p = _t(spark, sf, "fx_pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return _t(spark, sf, "fx_news_items").join(p, "url", "left").select("news_pos", "trend_id", "page_id")


@query("html_to_text", f"SELECT page_id, {_sql_digest(D.html_to_text('html'), 'text')} FROM fx_pages", fx=("fx_pages",))
def q_html_to_text(spark, sf):
    return _t(spark, sf, "fx_pages").select("page_id", *_digest(html_to_text(F.col("html")), "text"))


@query("page_title", f"SELECT page_id, {D.page_title('html')} AS title FROM fx_pages", fx=("fx_pages",))
def q_page_title(spark, sf):
    return _t(spark, sf, "fx_pages").select("page_id", page_title(F.col("html")).alias("title"))


@query("main_text", f"SELECT page_id, {_sql_digest(D.main_content('html'), 'content')} FROM fx_pages", fx=("fx_pages",))
def q_main_text(spark, sf):
    return _t(spark, sf, "fx_pages").select("page_id", *_digest(main_content(F.col("html")), "content"))


@query("meaningful_content", f"""
SELECT page_id, CASE WHEN NOT ({D.php_trim(D.strip_tags('content'))} = '' AND octet_length(encode(content)) < 100) THEN 1 ELSE 0 END AS meaningful,
  {_sql_digest(D.scraped_piece('html', 'content'), 'piece')}
FROM (SELECT page_id, html, {D.main_content('html')} AS content FROM fx_pages)""", fx=("fx_pages",))
def q_meaningful(spark, sf):
    p = _t(spark, sf, "fx_pages").withColumn("content", main_content(F.col("html")))
    return p.select("page_id", meaningful(F.col("content")).cast("int").alias("meaningful"),
                    *_digest(scraped_piece(F.col("html"), F.col("content")), "piece"))


@query("trend_text", CTE + f"SELECT trend_id, {_sql_digest('text', 'text')}, has_text FROM tt", fx=FX)
def q_trend_text(spark, sf):
    pend = PR.pending_trends(_t(spark, sf, "fx_trends"))
    news = PR.news_of_pending(_t(spark, sf, "fx_news_items"), pend)
    tt = PR.trend_text(news, PR.page_pieces(news, _t(spark, sf, "fx_pages")))
    return tt.select("trend_id", *_digest(F.col("text"), "text"), "has_text")


@query("has_news", CTE + """
SELECT id, 'no_news' AS reason FROM pend WHERE id NOT IN (SELECT trend_id FROM fx_news_items)
UNION ALL SELECT trend_id AS id, 'no_text' AS reason FROM tt WHERE has_text = 0""", fx=FX)
def q_has_news(spark, sf):
    t, n = _t(spark, sf, "fx_trends"), _t(spark, sf, "fx_news_items")
    mine = PR.news_of_pending(n, PR.pending_trends(t))
    tt = PR.trend_text(mine, PR.page_pieces(mine, _t(spark, sf, "fx_pages")), with_text=False)
    return PR.no_article(t, n, tt, P)


@query("vocab_scan", "SELECT tid, vid, name FROM fx_vocab WHERE vid = 'tags'", fx=("fx_vocab",))
def q_vocab_scan(spark, sf):
    return PR.vocab_scan(_t(spark, sf, "fx_vocab"), P)


@query("tags_prompt_list", CTE + "SELECT tags_list FROM tags", fx=FX)
def q_tags_prompt_list(spark, sf):
    return spark.range(1).select(PR.tags_prompt_list(_t(spark, sf, "fx_vocab"), P).alias("tags_list"))


_PROMPT_SQL = None


def _prompt_sql() -> str:
    parts = PR.DEFAULT_PROMPT.replace("%%", "\x00").split("%s")
    parts = [D.q(x.replace("\x00", "%")) for x in parts]
    return f"{parts[0]} || pend.title || {parts[1]} || tt.text || {parts[2]} || tags.tags_list || {parts[3]}"


@query("build_prompt", CTE + f"""
SELECT tt.trend_id, {_sql_digest(_prompt_sql(), 'prompt')}, tags.tags_list
FROM tt JOIN pend ON pend.id = tt.trend_id, tags WHERE tt.has_text = 1""", fx=FX)
def q_build_prompt(spark, sf):
    t, n, pg, v = (_t(spark, sf, x) for x in ("fx_trends", "fx_news_items", "fx_pages", "fx_vocab"))
    out = PR.build_prompts(t, n, pg, v, P)
    return out.select("trend_id", *_digest(F.col("prompt"), "prompt"), "tags_list")


FXL = ("fx_trends", "fx_late_news", "fx_thin_pages")
_LATE = CTE.replace("fx_pages", "fx_thin_pages").replace("fx_news_items", "fx_late_news").split("tags AS (")[0].rstrip().rstrip(",")


@query("audit_scrape", _LATE + """
SELECT 'prompts' AS stage, cast(n.trend_id AS varchar) || ':' || cast(n.news_pos AS varchar) AS key,
  CASE WHEN p.url IS NULL THEN 'scrape_failed' ELSE 'no_content' END AS reason, n.url AS detail
FROM fx_late_news n LEFT JOIN pieces p ON p.url = n.url WHERE p.url IS NULL OR p.piece = ''""", fx=FXL)
def q_audit_scrape(spark, sf):
    return PR.scrape_audit(_t(spark, sf, "fx_late_news"), _t(spark, sf, "fx_thin_pages"))


@query("has_text", _LATE + """
SELECT trend_id, has_text, md5(text) AS text_md5 FROM tt""", fx=FXL)
def q_has_text(spark, sf):
    """O-F9: whether any page of a pending trend gave text, with missing, empty and textless pages."""
    mine = PR.news_of_pending(_t(spark, sf, "fx_late_news"), PR.pending_trends(_t(spark, sf, "fx_trends")))
    tt = PR.trend_text(mine, PR.page_pieces(mine, _t(spark, sf, "fx_thin_pages")))
    return tt.select("trend_id", "has_text", F.md5("text").alias("text_md5"))
