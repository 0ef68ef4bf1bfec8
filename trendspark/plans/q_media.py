"""O-P4 media operators on pending fx_trends, their fx_news_items, fx_pages,
fx_images, fx_image_meta and fx_url_status."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.fixtures import fixture
from trendspark.functions import VIDEO_FRAME, image_extension, slugify
from trendspark.operators import media as M
from trendspark.operators.pages import IFRAME_SRC
from trendspark.operators.prompts import news_of_pending, pending_trends
from trendspark.plans.duck_text import q, romanised
from trendspark.plans.registry import query

FX = ("fx_trends", "fx_news_items", "fx_pages", "fx_image_meta", "fx_url_status")


def _inputs(spark, sf):
    t = pending_trends(fixture(spark, sf, "fx_trends"))
    n = news_of_pending(fixture(spark, sf, "fx_news_items"), t)
    return t, n, fixture(spark, sf, "fx_pages")


def duck_slug(x: str) -> str:
    return f"substr(trim(regexp_replace({romanised(x)}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 100)"


_ESC = "replace(replace(replace(replace(replace(video_url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
#: a video's frame and the blank line after it, as SQL over ``video_url``
FRAME = f" || {_ESC} || ".join(q(x) for x in VIDEO_FRAME.split("%s")) + " || chr(10) || chr(10)"

_IMG = """'(?i)<img\\b[^>]*[ \\t\\n\\r\\f]src=["'']([^"'']*)["'']'"""
_IFR = """'(?i)<iframe\\b[^>]*[ \\t\\n\\r\\f]src=["'']([^"'']*)["'']'"""
CTE = f"""WITH
pend AS (SELECT * FROM fx_trends WHERE processed = 0),
nw AS (SELECT * FROM fx_news_items WHERE trend_id IN (SELECT id FROM pend)),
pimg AS (SELECT url AS page_url, unnest(range(len(l))) AS img_pos, unnest(l) AS src
         FROM (SELECT url, regexp_extract_all(html, {_IMG}, 1) AS l FROM fx_pages)),
mu AS (SELECT n.trend_id, n.news_pos, cast(p.img_pos AS bigint) AS img_pos, p.src AS url
       FROM nw n JOIN pimg p ON p.page_url = n.url WHERE p.src <> ''),
dd AS (SELECT * FROM mu QUALIFY row_number() OVER (PARTITION BY trend_id, url ORDER BY news_pos, img_pos) = 1),
meta AS (SELECT url, max(width) AS width, max(height) AS height FROM fx_image_meta GROUP BY url),
dims AS (SELECT dd.*, cast(CASE WHEN m.width IS NULL OR m.width < 0 THEN 0 ELSE m.width END AS int) AS width,
                cast(CASE WHEN m.height IS NULL OR m.height < 0 THEN 0 ELSE m.height END AS int) AS height
         FROM dd LEFT JOIN meta m ON m.url = dd.url),
rk AS (SELECT *, cast(row_number() OVER (PARTITION BY trend_id ORDER BY
         CASE WHEN cast(width AS bigint) * height = 0 THEN 1 ELSE 0 END, cast(width AS bigint) * height DESC, news_pos, img_pos, url) AS bigint) AS rank
       FROM dims),
top AS (SELECT *, rank - 1 AS file_index FROM rk WHERE rank <= 10),
pvid AS (SELECT url AS page_url, unnest(range(len(l))) AS vid_pos, unnest(l) AS src
         FROM (SELECT url, regexp_extract_all(html, {_IFR}, 1) AS l FROM fx_pages)),
vids AS (SELECT trend_id, CASE WHEN starts_with(src, '//') THEN 'https:' || src ELSE src END AS video_url FROM (
         SELECT n.trend_id, p.src FROM nw n JOIN pvid p ON p.page_url = n.url
         WHERE contains(p.src, 'youtube.com') OR contains(p.src, 'youtu.be') OR contains(p.src, 'vimeo.com')
         QUALIFY row_number() OVER (PARTITION BY n.trend_id ORDER BY n.news_pos, p.vid_pos) = 1)),
st AS (SELECT url, max(status) AS status, max(body) AS body FROM fx_url_status GROUP BY url),
vid_ids AS (SELECT trend_id, video_url,
         regexp_extract(video_url, 'youtube\\.com/embed/([^?&]+)', 1) AS yt,
         regexp_extract(video_url, 'youtu\\.be/([^?&]+)', 1) AS ys,
         regexp_extract(video_url, 'vimeo\\.com/video/(\\d+)', 1) AS vm FROM vids),
thumbs AS (SELECT v.trend_id, v.video_url, CASE
         WHEN v.yt <> '' THEN CASE WHEN p.status = 200 THEN 'https://img.youtube.com/vi/' || v.yt || '/maxresdefault.jpg'
                                   ELSE 'https://img.youtube.com/vi/' || v.yt || '/hqdefault.jpg' END
         WHEN v.ys <> '' THEN 'https://img.youtube.com/vi/' || v.ys || '/maxresdefault.jpg'
         WHEN v.vm <> '' THEN CASE WHEN a.status = 200 THEN json_extract_string(a.body, '$[0].thumbnail_large') END
         END AS thumbnail_url
       FROM vid_ids v
       LEFT JOIN st p ON v.yt <> '' AND p.url = 'https://img.youtube.com/vi/' || v.yt || '/maxresdefault.jpg'
       LEFT JOIN st a ON v.yt = '' AND v.ys = '' AND v.vm <> '' AND a.url = 'https://vimeo.com/api/v2/video/' || v.vm || '.json'),
files AS (
  SELECT trend_id, rank AS ord, 'image' AS kind, url, file_index, '' AS alt FROM top
  UNION ALL SELECT id AS trend_id, cast(1 AS bigint), 'fallback', image_url, cast(NULL AS bigint), '' FROM pend
    WHERE id NOT IN (SELECT trend_id FROM top) AND image_url IS NOT NULL AND image_url NOT IN ('', '0')
  UNION ALL SELECT trend_id, cast(0 AS bigint), 'video_thumb', thumbnail_url, cast(NULL AS bigint), '' FROM thumbs WHERE thumbnail_url IS NOT NULL)
"""


def _media(spark, sf):
    t, n, p = _inputs(spark, sf)
    return M.extract_media(n, p, fixture(spark, sf, "fx_image_meta"), fixture(spark, sf, "fx_url_status"), t)


def _dd(spark, sf):
    t, n, p = _inputs(spark, sf)
    return M.image_dedupe(M.page_images(n, p))


def _videos(spark, sf):
    t, n, p = _inputs(spark, sf)
    return M.first_video(n, M.page_media(n, p))


@query("media_union", CTE + "SELECT trend_id, news_pos, img_pos, url FROM mu", fx=FX)
def q_media_union(spark, sf):
    t, n, p = _inputs(spark, sf)
    return M.page_images(n, p)


@query("image_dims_lookup", CTE + "SELECT trend_id, url, width, height FROM dims", fx=FX)
def q_image_dims_lookup(spark, sf):
    return M.image_dims_lookup(_dd(spark, sf), fixture(spark, sf, "fx_image_meta")).select("trend_id", "url", "width", "height")


@query("image_dims", "SELECT url, cast(width AS int) AS width, cast(height AS int) AS height FROM fx_image_meta",
       fx=("fx_image_meta",))
def q_image_dims(spark, sf):
    m = fixture(spark, sf, "fx_image_meta")
    return M.image_dims_lookup(m.select("url"), m).select("url", "width", "height")


FXI = ("fx_images",)
_DD_IMAGES = "WITH dd AS (SELECT * FROM fx_images QUALIFY row_number() OVER (PARTITION BY trend_id, url ORDER BY news_pos, width, height, alt) = 1)\n"
_RK_IMAGES = _DD_IMAGES.rstrip() + """,
rk AS (SELECT *, cast(row_number() OVER (PARTITION BY trend_id ORDER BY
         CASE WHEN cast(width AS bigint) * height = 0 THEN 1 ELSE 0 END, cast(width AS bigint) * height DESC, news_pos, url) AS bigint) AS rank
       FROM dd)
"""


def _img_dd(spark, sf):
    return M.image_dedupe(fixture(spark, sf, "fx_images"), order=("news_pos",))


@query("image_dedupe", _DD_IMAGES + "SELECT trend_id, url, news_pos, width, height, alt FROM dd", fx=FXI)
def q_image_dedupe(spark, sf):
    return _img_dd(spark, sf).select("trend_id", "url", "news_pos", "width", "height", "alt")


@query("media_rank", _RK_IMAGES + "SELECT trend_id, url, rank FROM rk", fx=FXI)
def q_media_rank(spark, sf):
    return M.media_rank(_img_dd(spark, sf), order=("news_pos",)).select("trend_id", "url", "rank")


@query("top_images", _RK_IMAGES.replace("FROM fx_images", "FROM fx_images WHERE url IN (SELECT url FROM fx_landed WHERE length > 0)")
       + "SELECT trend_id, url, rank, rank - 1 AS file_index FROM rk WHERE rank <= 10", fx=FXI + ("fx_landed",))
def q_top_images(spark, sf):
    i = M.landed_only(fixture(spark, sf, "fx_images"), fixture(spark, sf, "fx_landed"))
    return M.top_images(M.image_dedupe(i, order=("news_pos",)), order=("news_pos",)).select("trend_id", "url", "rank", "file_index")


@query("file_index", CTE + "SELECT trend_id, url, file_index FROM top", fx=FX)
def q_file_index(spark, sf):
    return _media(spark, sf)["images"].select("trend_id", "url", "file_index")


@query("image_extension", """
SELECT trend_id, news_pos, url, CASE WHEN lower(regexp_extract(url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) IN ('', 'jpeg') THEN 'jpg'
  ELSE lower(regexp_extract(url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) END AS ext FROM fx_images""", fx=FXI)
def q_image_extension(spark, sf):
    i = fixture(spark, sf, "fx_images")
    return i.select("trend_id", "news_pos", "url", image_extension(F.col("url")).alias("ext"))


@query("first_video", CTE + "SELECT trend_id, video_url FROM vids", fx=FX)
def q_first_video(spark, sf):
    return _videos(spark, sf)


@query("normalize_video_url", f"""
WITH v AS (SELECT page_id, unnest(regexp_extract_all(html, {_IFR}, 1)) AS src FROM fx_pages)
SELECT page_id, src, CASE WHEN starts_with(src, '//') THEN 'https:' || src ELSE src END AS video_url FROM v""", fx=("fx_pages",))
def q_normalize_video_url(spark, sf):
    p = fixture(spark, sf, "fx_pages")
    v = p.select("page_id", F.explode(F.regexp_extract_all(F.col("html"), F.lit(IFRAME_SRC), 1)).alias("src"))
    from trendspark.functions import normalize_video_url
    return v.select("page_id", "src", normalize_video_url(F.col("src")).alias("video_url"))


@query("video_thumbnail", CTE + "SELECT trend_id, video_url, thumbnail_url FROM thumbs", fx=FX)
def q_video_thumbnail(spark, sf):
    return M.video_thumbnail(_videos(spark, sf), fixture(spark, sf, "fx_url_status"))


@query("thumb_probe_source", """
SELECT url, status, CASE WHEN json_valid(body) THEN json_extract_string(body, '$[0].thumbnail_large') END AS thumbnail_large FROM fx_url_status""", fx=("fx_url_status",))
def q_thumb_probe(spark, sf):
    s = fixture(spark, sf, "fx_url_status")
    return s.select("url", "status", F.get_json_object(F.col("body"), "$[0].thumbnail_large").alias("thumbnail_large"))


@query("prepend_thumbnail", CTE + "SELECT trend_id, ord, kind, url FROM files WHERE trend_id IN (SELECT trend_id FROM thumbs WHERE thumbnail_url IS NOT NULL)",
       fx=FX)
def q_prepend_thumbnail(spark, sf):
    m = _media(spark, sf)
    f, has = m["files"], m["videos"].filter(F.col("thumbnail_url").isNotNull()).select("trend_id")
    return f.join(has, "trend_id", "left_semi").select("trend_id", "ord", "kind", "url")


@query("fallback_image", CTE + "SELECT trend_id, url FROM files WHERE kind = 'fallback'", fx=FX)
def q_fallback_image(spark, sf):
    return _media(spark, sf)["files"].filter(F.col("kind") == "fallback").select("trend_id", "url")


@query("media_counts", CTE + """
SELECT coalesce(c.trend_id, v.trend_id) AS trend_id, coalesce(c.n_images, 0) AS n_images, coalesce(c.n_files, 0) AS n_files,
  CASE WHEN v.trend_id IS NULL THEN 0 ELSE 1 END AS has_video
FROM (SELECT trend_id, cast(count(*) FILTER (WHERE kind = 'image') AS bigint) AS n_images, cast(count(*) AS bigint) AS n_files
      FROM files GROUP BY trend_id) c FULL JOIN vids v ON v.trend_id = c.trend_id""", fx=FX)
def q_media_counts(spark, sf):
    return _media(spark, sf)["counts"]


@query("media_manifest", CTE.rstrip() + f""",
ti AS (SELECT id AS trend_id, title, {duck_slug('title')} AS slug FROM pend)
SELECT f.trend_id, f.ord, f.kind, f.url,
  CASE WHEN f.kind = 'image' THEN CASE WHEN f.file_index = 0 THEN ti.slug || '.' || e.ext ELSE ti.slug || '-' || cast(f.file_index AS varchar) || '.' || e.ext END
       WHEN f.kind = 'fallback' THEN ti.slug || '.jpg' ELSE ti.slug || '-video-thumb.jpg' END AS filename,
  CASE WHEN f.kind = 'image' THEN CASE WHEN f.alt IS NULL OR f.alt IN ('', '0') THEN ti.title ELSE f.alt END
       WHEN f.kind = 'fallback' THEN ti.title ELSE ti.title || ' - Video' END AS alt
FROM files f JOIN ti ON ti.trend_id = f.trend_id,
  LATERAL (SELECT CASE WHEN lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) IN ('', 'jpeg') THEN 'jpg'
    ELSE lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) END AS ext) e""".replace("WITH\n", "WITH\n", 1), fx=FX)
def q_media_manifest(spark, sf):
    t, n, p = _inputs(spark, sf)
    titles = t.select(F.col("id").alias("trend_id"), "title", slugify(F.col("title")).alias("slug"))
    return M.media_manifest(_media(spark, sf)["files"], titles)


@query("slugify", f"SELECT doc_id, {duck_slug('text')} AS slug FROM documents")
def q_slugify(spark, sf):
    from trendspark.fixtures import table
    return table(spark, sf, "documents").select("doc_id", slugify(F.col("text")).alias("slug"))


@query("name_collisions", CTE.rstrip() + f""",
ti AS (SELECT id AS trend_id, {duck_slug('title')} AS slug FROM pend),
fn AS (SELECT f.trend_id, CASE WHEN f.kind = 'image' THEN CASE WHEN f.file_index = 0 THEN ti.slug || '.' || e.ext
    ELSE ti.slug || '-' || cast(f.file_index AS varchar) || '.' || e.ext END
    WHEN f.kind = 'fallback' THEN ti.slug || '.jpg' ELSE ti.slug || '-video-thumb.jpg' END AS filename
  FROM files f JOIN ti ON ti.trend_id = f.trend_id,
  LATERAL (SELECT CASE WHEN lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) IN ('', 'jpeg') THEN 'jpg'
    ELSE lower(regexp_extract(f.url, '(?i)\\.(jpe?g|png|gif|webp)$', 1)) END AS ext) e)
SELECT filename, count(DISTINCT trend_id) AS n_trends FROM fn GROUP BY filename HAVING count(DISTINCT trend_id) > 1""", fx=FX)
def q_name_collisions(spark, sf):
    """O-X17 check: file names that more than one trend would write (the reference overwrites)."""
    return M.name_collisions(q_media_manifest(spark, sf))
