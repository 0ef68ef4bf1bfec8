"""O-P3 publish operators on fx_ai_calls, fx_trends, fx_vocab, fx_users."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.fixtures import fixture
from trendspark.functions import created_ts, split_tags
from trendspark.operators import publish as PB
from trendspark.operators.prompts import pending_trends
from trendspark.params import Params
from trendspark.plans import q_media
from trendspark.plans.duck_text import php_trim, q
from trendspark.plans.registry import query
from trendspark.sources.dimensions import MODEL_PRICES, model_prices

P = Params(tag_field="field_tags", tag_vocabulary="tags", assign_random_author=True, author_seed=7)
FX = ("fx_ai_calls", "fx_vocab")

ST, SG = "'---TITLE_SEPARATOR---'", "'---TAGS_SEPARATOR---'"
_PRICES_SQL = "(VALUES " + ", ".join(
    f"({q(p)}, {q(m)}, cast({i} AS decimal(10,4)), cast({o} AS decimal(10,4)), {q(lab)})" for p, m, i, o, lab in MODEL_PRICES
) + ") AS mp(provider, model, input_per_m, output_per_m, label)"

# landed provider bodies read leniently: a body that is no JSON, or has no text, has no response
ANSWERS_CTE = """WITH
raw AS MATERIALIZED (SELECT *, CASE WHEN json_valid(json) THEN json END AS j FROM fx_raw_answers),
ans AS MATERIALIZED (SELECT call_id, trend_id, trend_title, provider, model,
  CASE WHEN provider = 'claude' THEN json_extract_string(j, '$.content[0].text') ELSE json_extract_string(j, '$.choices[0].message.content') END AS response,
  try_cast(CASE WHEN provider = 'claude' THEN json_extract_string(j, '$.usage.input_tokens')
    ELSE coalesce(json_extract_string(j, '$.usage.prompt_tokens'), json_extract_string(j, '$.usage.promptTokens')) END AS bigint) AS input_tokens,
  try_cast(CASE WHEN provider = 'claude' THEN json_extract_string(j, '$.usage.output_tokens')
    ELSE coalesce(json_extract_string(j, '$.usage.completion_tokens'), json_extract_string(j, '$.usage.completionTokens')) END AS bigint) AS output_tokens,
  j IS NULL AS bad FROM raw),
good AS (SELECT * FROM ans WHERE response IS NOT NULL)"""

CTE = f"""WITH
ps AS (SELECT *, strpos(response, {ST}) AS tpos FROM fx_ai_calls),
pr AS (SELECT *, CASE WHEN tpos > 0 THEN substr(response, tpos + 21) END AS rest FROM ps),
pg AS (SELECT *, strpos(rest, {SG}) AS gpos FROM pr),
parsed AS (SELECT call_id, trend_id, trend_title, provider, model, response, input_tokens, output_tokens,
  CASE WHEN tpos > 0 THEN {php_trim('substr(response, 1, tpos - 1)')} ELSE trend_title END AS gen_title,
  CASE WHEN tpos > 0 AND gpos > 0 THEN {php_trim('substr(rest, 1, gpos - 1)')} WHEN tpos > 0 THEN {php_trim('rest')}
       ELSE {php_trim('response')} END AS gen_body,
  CASE WHEN tpos > 0 AND gpos > 0 THEN list_filter(list_transform(string_split({php_trim('substr(rest, gpos + 20)')}, ','),
         lambda x: {php_trim('x')}), lambda x: x NOT IN ('', '0')) ELSE [] END AS tags,
  tpos = 0 AS no_separator
  FROM pg),
terms AS (SELECT name, min(tid) AS tid FROM fx_vocab WHERE vid = 'tags' GROUP BY name),
tr AS (SELECT call_id, unnest(range(len(tags))) AS tag_pos, unnest(tags) AS tag FROM parsed),
tid AS (SELECT p.call_id, coalesce(string_agg(cast(t.tid AS varchar), ',' ORDER BY r.tag_pos), '') AS tag_ids
        FROM parsed p LEFT JOIN tr r ON r.call_id = p.call_id LEFT JOIN terms t ON t.name = r.tag GROUP BY p.call_id),
priced AS (SELECT parsed.*, mp.input_per_m, mp.output_per_m, mp.input_per_m IS NULL AS unknown_model,
  cast((cast(coalesce(input_tokens, 0) AS decimal(12,0)) * coalesce(mp.input_per_m, 0)
      + cast(coalesce(output_tokens, 0) AS decimal(12,0)) * coalesce(mp.output_per_m, 0)) * cast(0.000001 AS decimal(7,6)) AS decimal(10,6)) AS cost
  FROM parsed LEFT JOIN {_PRICES_SQL} ON mp.provider = parsed.provider AND mp.model = parsed.model)
"""


def _calls(spark, sf):
    return fixture(spark, sf, "fx_ai_calls")


def _parsed(spark, sf):
    return PB.parsed(_calls(spark, sf))


def _tags_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("ai_call_source", ANSWERS_CTE + """
SELECT call_id, trend_id, provider, model, md5(response) AS response_md5, input_tokens, output_tokens,
  CASE WHEN bad THEN 'malformed_answer' WHEN response IS NULL THEN 'invalid_response' END AS reject FROM ans""", fx=("fx_raw_answers",))
def q_ai_call_source(spark, sf):
    n = PB.normalize_answers(fixture(spark, sf, "fx_raw_answers"))
    return n.select("call_id", "trend_id", "provider", "model", F.md5("response").alias("response_md5"),
                    "input_tokens", "output_tokens", "reject")


@query("failed_attempts", ANSWERS_CTE + """
SELECT trend_id, call_id, cast(row_number() OVER (PARTITION BY trend_id ORDER BY call_id) AS bigint) AS attempt,
  CASE WHEN bad THEN 'malformed_answer' ELSE 'invalid_response' END AS reason FROM ans WHERE response IS NULL""", fx=("fx_raw_answers",))
def q_failed_attempts(spark, sf):
    """O-T3: answers that can't be used, numbered per trend; the trend is asked again."""
    calls = PB.normalize_answers(fixture(spark, sf, "fx_raw_answers"))
    return PB.failed_attempts(calls, calls.limit(0).select("trend_id", F.lit(0).cast("bigint").alias("attempt")))


@query("parse_response", CTE + """SELECT call_id, gen_title, md5(gen_body) AS body_md5, cast(length(gen_body) AS bigint) AS body_len,
  array_to_string(tags, '|') AS tags FROM parsed""", fx=FX)
def q_parse_response(spark, sf):
    p = _parsed(spark, sf)
    return p.select("call_id", "gen_title", F.md5("gen_body").alias("body_md5"), F.char_length("gen_body").cast("bigint").alias("body_len"),
                    F.array_join("tags", "|").alias("tags"))


@query("split_tags", f"""SELECT call_id, array_to_string(list_filter(list_transform(string_split(response, ','), lambda x: {php_trim('x')}),
  lambda x: x NOT IN ('', '0')), '|') AS tags FROM fx_ai_calls""", fx=("fx_ai_calls",))
def q_split_tags(spark, sf):
    return _calls(spark, sf).select("call_id", F.array_join(split_tags(F.col("response")), "|").alias("tags"))


@query("tags_to_terms", CTE + "SELECT call_id, tag_ids FROM tid", fx=FX)
def q_tags_to_terms(spark, sf):
    t = PB.tags_to_terms(_parsed(spark, sf), fixture(spark, sf, "fx_vocab"), P)
    return t.select("call_id", _tags_str(F.col("tag_ids")).alias("tag_ids"))


@query("unmatched_tags", CTE + "SELECT call_id, cast(tag_pos AS bigint) AS tag_pos, tag FROM tr WHERE tag NOT IN (SELECT name FROM terms)",
       fx=FX)
def q_unmatched_tags(spark, sf):
    u = PB.unmatched_tags(_parsed(spark, sf), fixture(spark, sf, "fx_vocab"), P)
    return u.select("call_id", F.col("tag_pos").cast("bigint").alias("tag_pos"), "tag")


@query("first_match_term", "SELECT name, min(tid) AS tid FROM fx_vocab WHERE vid = 'tags' GROUP BY name", fx=("fx_vocab",))
def q_first_match_term(spark, sf):
    return PB.first_terms(fixture(spark, sf, "fx_vocab"), P)


@query("model_prices", f"SELECT provider, model, input_per_m, output_per_m, label FROM {_PRICES_SQL}")
def q_model_prices(spark, sf):
    # the price list is literal; joined here with the observed models so the query reads the tables
    used = _calls(spark, sf).select("provider", "model").distinct()
    return model_prices(spark).join(used, ["provider", "model"], "left_semi").unionByName(
        model_prices(spark).join(used, ["provider", "model"], "left_anti"))


@query("price_lookup", CTE + "SELECT call_id, provider, model, input_per_m, output_per_m FROM priced", fx=FX)
def q_price_lookup(spark, sf):
    return PB.priced(_parsed(spark, sf), model_prices(spark)).select("call_id", "provider", "model", "input_per_m", "output_per_m")


@query("token_cost", CTE + "SELECT call_id, cost FROM priced", fx=FX)
def q_token_cost(spark, sf):
    return PB.priced(_parsed(spark, sf), model_prices(spark)).select("call_id", "cost")


@query("eligible_users", "SELECT uid FROM fx_users WHERE uid NOT IN (0, 1) AND status = 1", fx=("fx_users",))
def q_eligible_users(spark, sf):
    return PB.eligible_users(fixture(spark, sf, "fx_users"))


_AUTHOR_SQL = """
users_idx AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS idx FROM fx_users WHERE uid NOT IN (0, 1) AND status = 1),
un AS (SELECT greatest(count(*), 1) AS n FROM users_idx),
latest AS (SELECT * FROM fx_ai_calls QUALIFY row_number() OVER (PARTITION BY trend_id ORDER BY call_id DESC) = 1),
authors AS (SELECT l.trend_id, cast(coalesce(u.uid, 1) AS bigint) AS uid FROM latest l CROSS JOIN un
  LEFT JOIN users_idx u ON u.idx = (((l.trend_id + 7) % un.n) * (2654435761 % un.n)) % un.n)
"""


@query("author_assign", "WITH " + _AUTHOR_SQL + "SELECT trend_id, uid FROM authors", fx=("fx_ai_calls", "fx_users"))
def q_author_assign(spark, sf):
    latest = PB.latest_answer(_calls(spark, sf)).select("trend_id")
    return PB.author_assign(latest, fixture(spark, sf, "fx_users"), P).select("trend_id", "uid")


@query("created_ts", "SELECT id, coalesce(cast(epoch(pub_date) AS bigint), 995198400) AS created FROM fx_trends", fx=("fx_trends",))
def q_created_ts(spark, sf):
    return fixture(spark, sf, "fx_trends").select("id", created_ts(F.col("pub_date"), P.as_of_epoch).alias("created"))


_FILES_CTE = q_media.CTE.rstrip()[4:] + f""",
ti AS (SELECT trend_id, gen_title AS title, {q_media.duck_slug('gen_title')} AS slug FROM lp),
named AS (SELECT f.trend_id, f.ord, f.kind, f.url,
  CASE WHEN f.kind = 'image' THEN CASE WHEN f.file_index = 0 THEN ti.slug || '.' || e.ext ELSE ti.slug || '-' || cast(f.file_index AS varchar) || '.' || e.ext END
       WHEN f.kind = 'fallback' THEN ti.slug || '.jpg' ELSE ti.slug || '-video-thumb.jpg' END AS filename,
  CASE WHEN f.kind = 'image' AND f.alt NOT IN ('', '0') THEN f.alt WHEN f.kind = 'video_thumb' THEN ti.title || ' - Video' ELSE ti.title END AS alt
  FROM files f JOIN ti ON ti.trend_id = f.trend_id,
  LATERAL (SELECT CASE WHEN lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) IN ('', 'jpeg') THEN 'jpg'
    ELSE lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) END AS ext) e),
imgs AS (SELECT trend_id, string_agg(filename || '|' || alt, ',' ORDER BY ord) AS images FROM named GROUP BY trend_id)"""
_ART_CTE = CTE.rstrip() + "," + _AUTHOR_SQL.rstrip() + """,
lp AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY trend_id ORDER BY call_id DESC) = 1),
""" + _FILES_CTE + f""",
art AS (SELECT lp.trend_id, 'article' AS type, lp.gen_title AS title, 1 AS status, a.uid,
          CASE WHEN vids.video_url IS NULL THEN lp.gen_body ELSE {q_media.FRAME.replace('video_url', 'vids.video_url')} || coalesce(lp.gen_body, '') END AS body,
          coalesce(cast(epoch(pend.pub_date) AS bigint), 995198400) AS created, tid.tag_ids, coalesce(imgs.images, '') AS images, lp.cost
        FROM lp JOIN pend ON pend.id = lp.trend_id JOIN tid ON tid.call_id = lp.call_id LEFT JOIN authors a ON a.trend_id = lp.trend_id
          LEFT JOIN vids ON vids.trend_id = lp.trend_id LEFT JOIN imgs ON imgs.trend_id = lp.trend_id),
arts AS (SELECT art.*, cast(coalesce((SELECT max(node_id) FROM fx_trends), 0) + trend_id AS bigint) AS node_id FROM art)
"""
_BARE_CTE = CTE.rstrip() + "," + _AUTHOR_SQL.rstrip() + """,
lp AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY trend_id ORDER BY call_id DESC) = 1),
arts AS (SELECT lp.trend_id, a.uid, tid.tag_ids, lp.cost, cast(coalesce((SELECT max(node_id) FROM fx_trends), 0) + lp.trend_id AS bigint) AS node_id
         FROM lp JOIN fx_trends t ON t.id = lp.trend_id AND t.processed = 0 JOIN tid ON tid.call_id = lp.call_id LEFT JOIN authors a ON a.trend_id = lp.trend_id)
"""
FXA = ("fx_ai_calls", "fx_vocab", "fx_users", "fx_trends")
FXM = FXA + ("fx_news_items", "fx_pages", "fx_image_meta", "fx_url_status")


def media_inputs(spark, sf):
    return {"news": fixture(spark, sf, "fx_news_items"), "pages": fixture(spark, sf, "fx_pages"),
            "image_meta": fixture(spark, sf, "fx_image_meta"), "url_status": fixture(spark, sf, "fx_url_status")}


def _articles(spark, sf, media=False):
    out = PB.publish_articles(_calls(spark, sf), fixture(spark, sf, "fx_trends"), fixture(spark, sf, "fx_vocab"),
                              fixture(spark, sf, "fx_users"), model_prices(spark), P, media_inputs(spark, sf) if media else None)
    return out["articles"]


def images_str(c):
    return F.array_join(F.transform(c, lambda f: F.concat(f["filename"], F.lit("|"), f["alt"])), ",")


@query("write_articles", _ART_CTE + """
SELECT trend_id, node_id, type, title, status, uid, md5(body) AS body_md5, created, tag_ids, images, cost FROM arts""", fx=FXM)
def q_write_articles(spark, sf):
    a = _articles(spark, sf, media=True)
    return a.select("trend_id", "node_id", "type", "title", "status", "uid", F.md5("body").alias("body_md5"), "created",
                    _tags_str(F.col("tag_ids")).alias("tag_ids"), images_str(F.col("images")).alias("images"), "cost")


@query("finish_trends", _BARE_CTE + """
SELECT t.id, CASE WHEN a.trend_id IS NOT NULL THEN 1 ELSE t.processed END AS processed,
  CASE WHEN a.trend_id IS NOT NULL THEN a.node_id ELSE t.node_id END AS node_id,
  CASE WHEN a.trend_id IS NOT NULL THEN a.cost ELSE t.processing_cost END AS processing_cost
FROM fx_trends t LEFT JOIN arts a ON a.trend_id = t.id""", fx=FXA)
def q_finish_trends(spark, sf):
    a = _articles(spark, sf).select(F.col("trend_id").alias("id"), "node_id", F.col("cost").alias("processing_cost"))
    return PB.finish_trends(fixture(spark, sf, "fx_trends"), a).select("id", "processed", "node_id", "processing_cost")


@query("at_least_once_guard", """
SELECT trend_id, call_id FROM fx_ai_calls QUALIFY row_number() OVER (PARTITION BY trend_id ORDER BY call_id DESC) = 1
  AND trend_id NOT IN (SELECT id FROM fx_trends WHERE node_id IS NOT NULL)""", fx=("fx_ai_calls", "fx_trends"))
def q_guard(spark, sf):
    existing = fixture(spark, sf, "fx_trends").filter(F.col("node_id").isNotNull()).select(F.col("id").alias("trend_id"))
    return PB.new_only(PB.latest_answer(_calls(spark, sf)), existing).select("trend_id", "call_id")


@query("audit_log", CTE + """
SELECT 'publish' AS stage, cast(call_id AS varchar) AS key, 'unknown_model' AS reason, model AS detail FROM priced WHERE unknown_model
UNION ALL SELECT 'publish', cast(call_id AS varchar), 'separator_missing', NULL FROM parsed WHERE no_separator
UNION ALL SELECT 'publish', cast(call_id AS varchar), 'tag_skipped', tag FROM tr WHERE tag NOT IN (SELECT name FROM terms)""", fx=FX)
def q_audit_log(spark, sf):
    p = PB.priced(_parsed(spark, sf), model_prices(spark))
    u = PB.unmatched_tags(p, fixture(spark, sf, "fx_vocab"), P)
    return PB.audit_publish(p, u)


@query("current_trends", _BARE_CTE + """
SELECT t.id, CASE WHEN a.trend_id IS NOT NULL THEN 1 ELSE t.processed END AS processed,
  CASE WHEN a.trend_id IS NOT NULL THEN a.node_id ELSE t.node_id END AS node_id,
  CASE WHEN a.trend_id IS NOT NULL THEN a.cost ELSE t.processing_cost END AS processing_cost
FROM fx_trends t LEFT JOIN arts a ON a.trend_id = t.id""", fx=FXA)
def q_current_trends(spark, sf):
    """O-SNK4 through the append-only update log: stored trends + newest update per id."""
    from trendspark.operators.state import current_trends, trend_updates

    a = _articles(spark, sf).select(F.col("trend_id").alias("id"), "node_id", F.col("cost").alias("processing_cost"))
    cur = current_trends(fixture(spark, sf, "fx_trends"), trend_updates(a, P.as_of_epoch))
    return cur.select("id", "processed", "node_id", "processing_cost")
