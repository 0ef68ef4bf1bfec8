"""Feed sources (O-SRC1..4), streams (O-T1..3), composite jobs (O-P1..P7) and small sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trendspark.fixtures import fixture
from trendspark.operators import ingest as I
from trendspark.operators.common import global_index
from trendspark.operators import media as M
from trendspark.operators import prompts as PR
from trendspark.operators import publish as PB
from trendspark.operators import reports as R
from trendspark.operators import translate as TR
from trendspark.plans import q_ingest, q_media, q_prompts, q_publish, q_reports, q_translate
from trendspark.plans.registry import query
from trendspark import schemas as S
from trendspark.session import ensure_checkpoint_dir
from trendspark.sources import feed as FEED
from trendspark.sources.feed_docs import damage, feed_documents
from trendspark.sources.dimensions import model_prices

FXF = ("fx_feed_items", "fx_news_items")


def _docs(spark, sf):
    d = feed_documents(fixture(spark, sf, "fx_feed_items"), fixture(spark, sf, "fx_news_items"))
    return d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "value")


def _parsed_items(spark, sf):
    return FEED.feed_items(FEED.parse_documents(_docs(spark, sf)))


@query("feed_scan", "SELECT title, approx_traffic, pub_date_raw, link, snippet, picture FROM fx_feed_items", fx=FXF)
def q_feed_scan(spark, sf):
    return _parsed_items(spark, sf).select("title", "approx_traffic", "pub_date_raw", "link", "snippet", "picture")


@query("feed_scan_ordered", """
SELECT link, cast(floor(feed_pos / 100) AS bigint) AS doc_id,
  cast(row_number() OVER (PARTITION BY floor(feed_pos / 100) ORDER BY feed_pos) - 1 AS bigint) AS item_pos FROM fx_feed_items""", fx=FXF)
def q_feed_scan_ordered(spark, sf):
    it = _parsed_items(spark, sf)
    return it.select("link", F.col("path").cast("bigint").alias("doc_id"),
                     F.pmod(F.col("feed_pos"), F.lit(1 << FEED.POS_BITS)).cast("bigint").alias("item_pos"))


@query("feed_validate", """
SELECT DISTINCT cast(floor(feed_pos / 100) AS bigint) AS doc_id,
  CASE cast(floor(feed_pos / 100) AS bigint) % 7 WHEN 1 THEN 'no_ht_namespace' WHEN 2 THEN 'malformed' ELSE 'no_items' END AS reason
FROM fx_feed_items WHERE cast(floor(feed_pos / 100) AS bigint) % 7 IN (1, 2, 3)""", fx=FXF)
def q_feed_validate(spark, sf):
    d = damage(feed_documents(fixture(spark, sf, "fx_feed_items"), fixture(spark, sf, "fx_news_items")))
    docs = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "value")
    return FEED.feed_rejects(FEED.parse_documents(docs)).select(F.col("path").cast("bigint").alias("doc_id"), "reason")


@query("news_explode", """
SELECT f.link, cast(row_number() OVER (PARTITION BY n.trend_id ORDER BY n.news_pos) - 1 AS bigint) AS news_pos,
  n.title, n.snippet, n.url, n.source
FROM fx_news_items n JOIN fx_feed_items f ON f.feed_pos = n.trend_id""", fx=FXF)
def q_news_explode(spark, sf):
    it = _parsed_items(spark, sf)
    n = FEED.news_explode(it)
    return n.join(it.select("feed_pos", "link"), "feed_pos").select("link", "news_pos", "title", "snippet", "url", "source")


# ---- streams (they land files under spark.checkpoint.dir, run, and read the tables back)

def _scratch(spark, kind):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/registered/{kind}-{uuid.uuid4().hex}"


#: documents that land between two runs of ``max_per_run``, which is also the most files that a micro-batch of it takes
WAVE = 64


def _feed_stream(spark, sf, wave, max_files):
    """Land the feed's documents in waves, in document order, and run the stream after each wave.

    Only the names of the documents are numbered. All documents are written once, each wave into a folder of its own, and a wave
    lands when its folder is moved to the landing folder, so a wave costs what its own documents cost."""
    from trendspark.streaming.batches import filesystem
    from trendspark.streaming.jobs import start_feed_stream

    base = _scratch(spark, "feed")
    docs = _docs(spark, sf).select(F.col("path").alias("doc"), "value")
    if wave:
        names = global_index(docs.select("doc"), ["doc"], "i").select("doc", F.floor(F.col("i") / wave).cast("bigint").alias("wave")).checkpoint(eager=True)
        last = names.agg(F.max("wave")).first()[0]
        docs = docs.join(names, "doc")
    else:
        last, docs = 0, docs.withColumn("wave", F.lit(0).cast("bigint"))
    docs = docs.withColumn("wave", F.lpad(F.col("wave").cast("string"), 12, "0"))
    docs.write.partitionBy("wave", "doc").option("compression", "gzip").text(f"{base}/written")
    fs, landing = filesystem(spark, f"{base}/landing")
    fs.mkdirs(landing)
    for w in range(last + 1):
        name = f"wave={w:012d}"
        if not fs.rename(filesystem(spark, f"{base}/written/{name}")[1], filesystem(spark, f"{base}/landing/{name}")[1]):
            raise OSError(f"wave {w} did not land")
        start_feed_stream(spark, f"{base}/landing", f"{base}/tables", q_ingest.P, checkpoint=f"{base}/ckpt",
                          max_files=max_files).awaitTermination()
    return spark.read.parquet(f"{base}/tables/trends").select(*S.TRENDS.fieldNames())


_STREAM_SQL = q_ingest.CTE_RUNS + """
SELECT cast(row_number() OVER (ORDER BY i.feed_pos) AS bigint) AS id, title, traffic, pub_date, link, snippet, picture AS image_url,
  0 AS processed, cast(NULL AS bigint) AS node_id, cast(995198400 AS bigint) AS imported_at, cast(NULL AS decimal(10,6)) AS processing_cost
FROM items i JOIN taken t ON t.feed_pos = i.feed_pos"""


@query("feed_stream", _STREAM_SQL, fx=FXF)
def q_feed_stream(spark, sf):
    """O-T1: all documents in one micro-batch; each is a run of its own."""
    return _feed_stream(spark, sf, None, None)


@query("max_per_run", _STREAM_SQL, fx=FXF)
def q_max_per_run(spark, sf):
    """O-T2: the same documents in waves and in micro-batches of a bounded number of files: the same trends."""
    return _feed_stream(spark, sf, WAVE, WAVE)


_RAW_ART = q_publish.ANSWERS_CTE + ",\n" + q_publish._ART_CTE.replace("fx_ai_calls", "good").strip()[5:]


@query("process_stream", _RAW_ART + """
SELECT trend_id, node_id, title, uid, md5(body) AS body_md5, tag_ids, images, cost FROM arts""", fx=("fx_raw_answers",) + q_publish.FXM[1:])
def q_process_stream(spark, sf):
    """O-T3: raw provider answers land, the stream publishes them with their media; the articles table read back."""
    from trendspark.streaming.jobs import start_publish_stream

    base = _scratch(spark, "publish")
    fixture(spark, sf, "fx_trends").write.parquet(f"{base}/tables/trends")
    fixture(spark, sf, "fx_raw_answers").write.parquet(f"{base}/landing")
    start_publish_stream(spark, f"{base}/landing", f"{base}/tables", fixture(spark, sf, "fx_vocab"), fixture(spark, sf, "fx_users"), q_publish.P,
                         checkpoint=f"{base}/ckpt", media=q_publish.media_inputs(spark, sf), raw=True).awaitTermination()
    a = spark.read.parquet(f"{base}/tables/articles")
    return a.select("trend_id", "node_id", "title", "uid", F.md5("body").alias("body_md5"), q_publish._tags_str(F.col("tag_ids")).alias("tag_ids"),
                    q_publish.images_str(F.col("images")).alias("images"), "cost")


@query("clear_all", """
SELECT 'articles' AS name, cast(count(*) AS bigint) AS n_before, cast(count(*) AS bigint) AS n_after FROM fx_articles
UNION ALL SELECT 'news', cast(count(*) AS bigint), cast(0 AS bigint) FROM fx_news_items
UNION ALL SELECT 'trends', cast(count(*) AS bigint), cast(0 AS bigint) FROM fx_trends""", fx=("fx_articles", "fx_news_items", "fx_trends"))
def q_clear_all(spark, sf):
    """O-SNK9 on the tables the jobs write: rows of each table before and after."""
    from trendspark.streaming.batches import read_or_empty
    from trendspark.streaming.jobs import clear_tables

    base = _scratch(spark, "clear")
    frames = {"trends": fixture(spark, sf, "fx_trends"), "news": fixture(spark, sf, "fx_news_items"), "articles": fixture(spark, sf, "fx_articles")}
    for name, df in frames.items():
        df.write.parquet(f"{base}/{name}")
    before = [spark.read.parquet(f"{base}/{n}").agg(F.count(F.lit(1)).alias("n_before")).select(F.lit(n).alias("name"), "n_before").checkpoint(eager=True)
              for n in frames]
    clear_tables(spark, base)
    out = None
    for (name, df), b in zip(frames.items(), before):
        after = read_or_empty(spark, f"{base}/{name}", df.schema).agg(F.count(F.lit(1)).alias("n_after")).select(F.lit(name).alias("name"), "n_after")
        one = b.join(after, "name")
        out = one if out is None else out.unionByName(one)
    return out


# ---- composite jobs through their public entry points

@query("ingest_trends", q_ingest.CTE_STATUS + """
SELECT cast(row_number() OVER (ORDER BY feed_pos) AS bigint) AS id, title, traffic, pub_date, link, snippet, picture AS image_url,
  0 AS processed, cast(NULL AS bigint) AS node_id, cast(995198400 AS bigint) AS imported_at, cast(NULL AS decimal(10,6)) AS processing_cost
FROM capped""", fx=q_ingest.FEED)
def q_ingest_trends(spark, sf):
    out = I.ingest_trends(fixture(spark, sf, "fx_feed_items"), q_ingest._news(spark, sf), fixture(spark, sf, "fx_stored_keys"), q_ingest.P)
    return out["trends"]


@query("build_prompts", q_prompts.CTE + "SELECT tt.trend_id, pend.title, md5(tt.text) AS text_md5, tags.tags_list "
       "FROM tt JOIN pend ON pend.id = tt.trend_id, tags WHERE tt.has_text = 1", fx=q_prompts.FX)
def q_build_prompts(spark, sf):
    out = PR.build_prompts(*(fixture(spark, sf, x) for x in q_prompts.FX), q_prompts.P)
    return out.select("trend_id", "title", F.md5("text").alias("text_md5"), "tags_list")


@query("publish_articles", q_publish._BARE_CTE + "SELECT trend_id, node_id, uid, cost, tag_ids FROM arts", fx=q_publish.FXA)
def q_publish_articles(spark, sf):
    a = q_publish._articles(spark, sf)
    return a.select("trend_id", "node_id", "uid", "cost", q_publish._tags_str(F.col("tag_ids")).alias("tag_ids"))


@query("extract_media", q_media.CTE + "SELECT trend_id, ord, kind, url FROM files", fx=q_media.FX)
def q_extract_media(spark, sf):
    t, n, p = q_media._inputs(spark, sf)
    out = M.extract_media(n, p, fixture(spark, sf, "fx_image_meta"), fixture(spark, sf, "fx_url_status"), t)
    return out["files"].select("trend_id", "ord", "kind", "url")


@query("translate_fanout", q_translate.CTE + "SELECT node_id, langcode, md5(prompt) AS prompt_md5 FROM miss", fx=q_translate.FXT)
def q_translate_fanout(spark, sf):
    out = TR.translate_articles(*(fixture(spark, sf, x) for x in ("fx_articles", "fx_languages", "fx_translations", "fx_translation_calls")),
                                q_translate.P)
    return out["prompts"].select("node_id", "langcode", F.md5("prompt").alias("prompt_md5"))


@query("listing", f"SELECT {q_reports.SQL_FORMAT} FROM ({q_reports.SQL_LISTING_ROWS}) WHERE traffic >= 100 "
       "ORDER BY title ASC, id DESC LIMIT 25 OFFSET 50", fx=q_reports.FXL)
def q_listing(spark, sf):
    return R.listing(fixture(spark, sf, "fx_trends"), fixture(spark, sf, "fx_articles"),
                     [R.numeric_filter("traffic", ">=", 100)], sort="title", page=2)


# ---- small sinks and checks

@query("finish_without_article", q_prompts.CTE + """
SELECT t.id, 1 AS processed, t.node_id, t.processing_cost FROM fx_trends t
WHERE t.id IN (SELECT id FROM pend WHERE id NOT IN (SELECT trend_id FROM fx_news_items) UNION ALL SELECT trend_id FROM tt WHERE has_text = 0)""",
       fx=q_prompts.FX)
def q_finish_without_article(spark, sf):
    t, n = fixture(spark, sf, "fx_trends"), fixture(spark, sf, "fx_news_items")
    mine = PR.news_of_pending(n, PR.pending_trends(t))
    tt = PR.trend_text(mine, PR.page_pieces(mine, fixture(spark, sf, "fx_pages")), with_text=False)
    done = PR.no_article(t, n, tt, q_prompts.P).select("id", F.lit(None).cast("bigint").alias("node_id"),
                                                          F.lit(None).cast("decimal(10,6)").alias("processing_cost"))
    snap = PB.finish_trends(t.filter(F.col("processed") == 0), done)
    return snap.join(done.select("id"), "id", "left_semi").select("id", "processed", "node_id", "processing_cost")


@query("exists_probe", q_ingest.CTE_STATUS + """SELECT feed_pos FROM items i
WHERE EXISTS (SELECT 1 FROM fx_stored_keys s WHERE s.title = i.title AND s.pub_date = i.pub_date)""", fx=q_ingest.FEED)
def q_exists_probe(spark, sf):
    return q_ingest._feed(spark, sf).join(fixture(spark, sf, "fx_stored_keys").select(*I.KEY), I.KEY, "left_semi").select("feed_pos")


@query("audit_union", q_ingest.CTE_STATUS.rstrip() + ",\n" + q_publish.CTE.strip()[5:] + """
SELECT stage, reason, cast(count(*) AS bigint) AS n FROM (
  SELECT 'ingest' AS stage, run_status AS reason FROM run WHERE run_status <> 'accepted'
  UNION ALL SELECT 'publish', 'unknown_model' FROM priced WHERE unknown_model
  UNION ALL SELECT 'publish', 'separator_missing' FROM parsed WHERE no_separator
  UNION ALL SELECT 'publish', 'tag_skipped' FROM tr WHERE tag NOT IN (SELECT name FROM terms))
GROUP BY stage, reason""", fx=q_ingest.FEED + q_publish.FX)
def q_audit_union(spark, sf):
    """O-U4 / O-SNK10: the audit of both stages in one frame (counts per reason)."""
    a = I.audit_rows(I.with_run_status(q_ingest._status(spark, sf), q_ingest.P))
    p = PB.priced(PB.parsed(fixture(spark, sf, "fx_ai_calls")), model_prices(spark))
    b = PB.audit_publish(p, PB.unmatched_tags(p, fixture(spark, sf, "fx_vocab"), q_publish.P))
    return a.unionByName(b).groupBy("stage", "reason").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("image_filename", q_media.CTE.rstrip() + f""",
ti AS (SELECT id AS trend_id, {q_media.duck_slug('title')} AS slug FROM pend)
SELECT f.trend_id, f.ord, CASE WHEN f.kind = 'image' THEN CASE WHEN f.file_index = 0 THEN ti.slug || '.' || e.ext
  ELSE ti.slug || '-' || cast(f.file_index AS varchar) || '.' || e.ext END
  WHEN f.kind = 'fallback' THEN ti.slug || '.jpg' ELSE ti.slug || '-video-thumb.jpg' END AS filename
FROM files f JOIN ti ON ti.trend_id = f.trend_id,
  LATERAL (SELECT CASE WHEN lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) IN ('', 'jpeg') THEN 'jpg'
    ELSE lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) END AS ext) e""", fx=q_media.FX)
def q_image_filename(spark, sf):
    return q_media.q_media_manifest(spark, sf).select("trend_id", "ord", "filename")


@query("alt_text", q_media.CTE.rstrip() + """
SELECT f.trend_id, f.ord, CASE WHEN f.kind = 'image' THEN CASE WHEN f.alt IS NULL OR f.alt IN ('', '0') THEN p.title ELSE f.alt END
  WHEN f.kind = 'fallback' THEN p.title ELSE p.title || ' - Video' END AS alt
FROM files f JOIN pend p ON p.id = f.trend_id""", fx=q_media.FX)
def q_alt_text(spark, sf):
    return q_media.q_media_manifest(spark, sf).select("trend_id", "ord", "alt")
