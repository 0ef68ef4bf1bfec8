"""O-P5 translation fan-out, O-P8 migration, O-A15 cost projection, O-F16 gate, O-X21 embed."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.fixtures import fixture
from trendspark.functions import embed_video
from trendspark.functions.text import TRANSLATION_TEMPLATE
from trendspark.operators import costs as C
from trendspark.operators import media as M
from trendspark.operators import migrate as MG
from trendspark.operators import publish as PB
from trendspark.operators import translate as TR
from trendspark.operators.prompts import news_of_pending, pending_trends
from trendspark.operators.snapshots import enabled_gate
from trendspark.params import Params
from trendspark.plans import q_media, q_publish
from trendspark.plans.duck_text import php_trim, q
from trendspark.plans.registry import query
from trendspark.sources.dimensions import model_prices

P = Params(translation_enabled=True, translation_languages=("fr", "de", "", "es", "it"))
FXT = ("fx_articles", "fx_languages", "fx_translations", "fx_translation_calls")

_parts = [q(x) for x in TRANSLATION_TEMPLATE.split("%s")]
_PROMPT = f"{_parts[0]} || coalesce(l.name, c.langcode) || {_parts[1]} || a.title || {_parts[2]} || a.body || {_parts[3]}"
CTE = f"""WITH
codes AS (SELECT * FROM (VALUES ('fr', 0), ('de', 1), ('es', 2), ('it', 3)) v(langcode, o)),
fan AS (SELECT a.node_id, c.langcode, a.title, a.body, coalesce(l.name, c.langcode) AS language_name, {_PROMPT} AS prompt
        FROM fx_articles a, codes c LEFT JOIN fx_languages l ON l.langcode = c.langcode),
miss AS (SELECT * FROM fan f WHERE NOT EXISTS (SELECT 1 FROM fx_translations t WHERE t.node_id = f.node_id AND t.langcode = f.langcode)),
tr AS (SELECT m.node_id, m.langcode,
  CASE WHEN strpos(coalesce(r.response, ''), '---TITLE_SEPARATOR---') > 0
       THEN {php_trim("substr(r.response, 1, strpos(r.response, '---TITLE_SEPARATOR---') - 1)")} ELSE m.title END AS title,
  CASE WHEN strpos(coalesce(r.response, ''), '---TITLE_SEPARATOR---') > 0
       THEN {php_trim("substr(r.response, strpos(r.response, '---TITLE_SEPARATOR---') + 21)")} ELSE m.body END AS body
  FROM miss m JOIN fx_translation_calls r ON r.node_id = m.node_id AND r.langcode = m.langcode WHERE r.response IS NOT NULL)
"""


def _fan(spark, sf):
    return TR.translation_fanout(fixture(spark, sf, "fx_articles"), fixture(spark, sf, "fx_languages"), P)


@query("non_default_languages", "SELECT langcode, name FROM fx_languages WHERE is_default <> 1 AND langcode IN ('fr', 'de', 'es', 'it')",
       fx=("fx_languages",))
def q_non_default(spark, sf):
    return TR.non_default_languages(fixture(spark, sf, "fx_languages"), P).select("langcode", "name")


@query("translation_fanout", CTE + "SELECT node_id, langcode, language_name FROM fan", fx=FXT)
def q_fanout(spark, sf):
    f = _fan(spark, sf)
    names = fixture(spark, sf, "fx_languages").select("langcode", F.col("name").alias("language_name"))
    return f.join(names, "langcode", "left").select(
        "node_id", "langcode", F.coalesce(F.col("language_name"), F.col("langcode")).alias("language_name"))


@query("translation_prompt", CTE + "SELECT node_id, langcode, md5(prompt) AS prompt_md5, cast(length(prompt) AS bigint) AS prompt_len FROM fan",
       fx=FXT)
def q_translation_prompt(spark, sf):
    return _fan(spark, sf).select("node_id", "langcode", F.md5("prompt").alias("prompt_md5"),
                                  F.char_length("prompt").cast("bigint").alias("prompt_len"))


@query("missing_translation", CTE + "SELECT node_id, langcode FROM miss", fx=FXT)
def q_missing(spark, sf):
    return TR.missing_translation(_fan(spark, sf), fixture(spark, sf, "fx_translations")).select("node_id", "langcode")


@query("parse_translation", CTE + "SELECT node_id, langcode, title, md5(body) AS body_md5 FROM tr", fx=FXT)
def q_parse_translation(spark, sf):
    miss = TR.missing_translation(_fan(spark, sf), fixture(spark, sf, "fx_translations"))
    t = TR.write_translations(miss, fixture(spark, sf, "fx_translation_calls"))
    return t.select("node_id", "langcode", "title", F.md5("body").alias("body_md5"))


@query("write_translations", CTE + """
SELECT node_id, langcode, title, cast(length(body) AS bigint) AS body_len, cast(node_id % 7 AS varchar) || ',' || cast(node_id % 5 AS varchar) AS tag_ids
FROM tr""", fx=FXT)
def q_write_translations(spark, sf):
    """O-SNK7: tags go with every language of the article."""
    articles = fixture(spark, sf, "fx_articles").withColumn("tag_ids", F.array(F.col("node_id") % 7, F.col("node_id") % 5))
    out = TR.translate_articles(articles, fixture(spark, sf, "fx_languages"),
                                fixture(spark, sf, "fx_translations"), fixture(spark, sf, "fx_translation_calls"), P)
    return out["translations"].select("node_id", "langcode", "title", F.char_length("body").cast("bigint").alias("body_len"),
                                      F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ",").alias("tag_ids"))


_KEPT = "regexp_replace(approx_traffic, '[^0-9.]', '', 'g')"
_DEC = f"try_cast(CASE WHEN regexp_extract({_KEPT}, '^[0-9]*(\\.[0-9]*)?', 0) IN ('', '.') THEN '0' ELSE regexp_extract({_KEPT}, '^[0-9]*(\\.[0-9]*)?', 0) END AS decimal(10,2))"
_WHOLE = f"try_cast(CASE WHEN regexp_extract({_KEPT}, '^[0-9]*', 0) = '' THEN '0' ELSE regexp_extract({_KEPT}, '^[0-9]*', 0) END AS bigint)"


@query("migrate_legacy", f"""
SELECT feed_pos AS id, title,
  CASE WHEN coalesce(approx_traffic, '') = '' THEN cast(0 AS bigint)
    WHEN upper(approx_traffic) LIKE '%M%' THEN cast(round({_DEC} * 1000) AS bigint)
    WHEN upper(approx_traffic) LIKE '%B%' THEN cast(round({_DEC} * 1000000) AS bigint)
    ELSE {_WHOLE} END AS traffic, cast(NULL AS decimal(10,6)) AS processing_cost
FROM fx_feed_items""", fx=("fx_feed_items",))
def q_migrate_legacy(spark, sf):
    legacy = fixture(spark, sf, "fx_feed_items").select(F.col("feed_pos").alias("id"), "title", F.col("approx_traffic").alias("traffic"))
    return MG.migrate_legacy(legacy).select("id", "title", "traffic", "processing_cost")


@query("cost_projection", q_publish.CTE + """
SELECT provider, model, per_day, n, cast(min_cost * per_day AS decimal(20,6)) AS min_day, cast(max_cost * per_day AS decimal(20,6)) AS max_day,
  cast(sum_cost AS double) / n * per_day AS avg_day
FROM (SELECT provider, model, min(cost) AS min_cost, max(cost) AS max_cost, cast(sum(cost) AS decimal(20,6)) AS sum_cost,
        cast(count(*) AS bigint) AS n FROM priced GROUP BY provider, model), (VALUES (120), (240)) d(per_day)""", fx=q_publish.FX)
def q_cost_projection(spark, sf):
    p = PB.priced(PB.parsed(fixture(spark, sf, "fx_ai_calls")), model_prices(spark))
    return C.observed_projection(p)


@query("enabled_gate", "SELECT id, title FROM fx_trends WHERE false", fx=("fx_trends",))
def q_enabled_gate(spark, sf):
    return enabled_gate(fixture(spark, sf, "fx_trends"), Params(import_enabled=False)).select("id", "title")


@query("embed_video", q_media.CTE.rstrip() + f"""
SELECT p.id AS trend_id, md5(CASE WHEN v.video_url IS NOT NULL AND v.video_url <> '' AND (contains(v.video_url, 'youtube.com')
  OR contains(v.video_url, 'youtu.be') OR contains(v.video_url, 'vimeo.com')) THEN {q_media.FRAME.replace('video_url', 'v.video_url')} || coalesce(p.snippet, '')
  ELSE p.snippet END) AS body_md5
FROM pend p LEFT JOIN vids v ON v.trend_id = p.id""", fx=q_media.FX)
def q_embed_video(spark, sf):
    t = pending_trends(fixture(spark, sf, "fx_trends"))
    n = news_of_pending(fixture(spark, sf, "fx_news_items"), t)
    v = M.first_video(n, M.page_media(n, fixture(spark, sf, "fx_pages")))
    j = t.select(F.col("id").alias("trend_id"), "snippet").join(v, "trend_id", "left")
    return j.select("trend_id", F.md5(embed_video(F.col("snippet"), F.col("video_url"))).alias("body_md5"))


