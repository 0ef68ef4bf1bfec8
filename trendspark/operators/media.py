"""O-P4 extract_media: images and the first video of a trend's pages.

Per trend the reference fetches every page again, collects <img> URLs in page
order, drops repeats, probes sizes, sorts by area and keeps ten downloads, and
takes the first YouTube/Vimeo iframe. Here: one projection per needed page
(``pages.py``), sizes and landed bytes joined per page and cut to the images a
trend could keep, then per trend a partial aggregate for first occurrence and a
``row_number() <= 10`` window that Spark limits per map partition before the
shuffle (so a trend with millions of images ships at most ten per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendspark.functions import alt_text, image_extension, image_filename, normalize_video_url, vimeo_id, youtu_be_id, youtube_embed_id
from trendspark.functions.text import let
from trendspark.operators.pages import needed_pages, page_facts
from trendspark.params import MAX_IMAGES
from trendspark.session import ensure_checkpoint_dir

# Thumbnail URL layouts of the two video services.
YOUTUBE_MAXRES = "https://img.youtube.com/vi/{id}/maxresdefault.jpg"
YOUTUBE_HQ = "https://img.youtube.com/vi/{id}/hqdefault.jpg"
VIMEO_API = "https://vimeo.com/api/v2/video/{id}.json"

#: Bytes of the pages' kept images and videos (with their URLs) up to which they are handed to every task as one array.
BOOK_BYTES = 32 << 20


def _fmt(layout: str, vid: Column) -> Column:
    a, b = layout.split("{id}")
    return F.concat(F.lit(a), vid, F.lit(b))


def resolve_url(src: Column, page_url: Column) -> Column:
    """Absolute image URL against the page URL (scheme-relative, root-relative, relative)."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_dir = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)", 1)
    base_dir = F.when(base_dir == "", F.concat(origin, F.lit("/"))).otherwise(base_dir)
    return (
        F.when(src.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), src)
        .when(F.startswith(src, F.lit("//")), F.concat(scheme, F.lit(":"), src))
        .when(F.startswith(src, F.lit("/")), F.concat(origin, src))
        .otherwise(F.concat(base_dir, src))
    )


def page_media(news: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, images, video) of the pages that ``news`` needs; a narrow table, read by all steps below."""
    return page_facts(needed_pages(news, pages)).select("url", "images", "video")


def image_rows(facts: DataFrame) -> DataFrame:
    """(page_url, img_pos, url): the images of each page in page order."""
    i = facts.select("url", F.explode("images").alias("i"))
    return i.select(F.col("url").alias("page_url"), F.col("i.img_pos").cast("bigint").alias("img_pos"), resolve_url(F.col("i.src"), F.col("url")).alias("url"))


def page_images(news: DataFrame, pages: DataFrame) -> DataFrame:
    """O-U1 media_union: (trend_id, news_pos, img_pos, url) for every <img> of every
    child page, in page order. Pages are read once per distinct URL."""
    # no repartition by trend here: the de-dup below is a partial aggregate on
    # (trend, url) and the rank gets a per-partition WindowGroupLimit, so a trend
    # holding a large share of all images is spread and cut before it is shuffled
    return _of_news(news, image_rows(page_media(news, pages))).select("trend_id", "news_pos", "img_pos", "url")


def _of_news(news: DataFrame, by_page: DataFrame) -> DataFrame:
    return news.select("trend_id", "news_pos", F.col("url").alias("page_url")).join(by_page, "page_url")


def page_top_images(facts: DataFrame, image_meta: DataFrame, landed: DataFrame | None = None, n: int = MAX_IMAGES) -> DataFrame:
    """(page_url, img_pos, url, width, height): the images of each page that a trend could keep.

    Sizes and landed bytes are joined to pages, not to trends, which list a page many times. An image that ``n`` others of its
    page beat (by area, or by place at equal area) can't be among the first ``n`` of any trend that has the page, so
    no more than ``n`` distinct images of a page go on."""
    i = image_rows(facts).groupBy("page_url", "url").agg(F.min("img_pos").alias("img_pos"))
    i = image_dims_lookup(i if landed is None else landed_only(i, landed), image_meta)
    return top_images(i.withColumnRenamed("page_url", "trend_id"), n, ("img_pos",)).withColumnRenamed("trend_id", "page_url") \
        .select("page_url", "img_pos", "url", "width", "height")


def landed_only(images: DataFrame, landed: DataFrame) -> DataFrame:
    """O-S6: images whose bytes have landed. ``landed`` = (url, length), a listing of the landed files; a file without bytes is
    a dead image. Dead images take none of a trend's places."""
    return images.join(landed.filter(F.col("length") > 0).select("url").distinct(), "url", "left_semi")


def image_dedupe(images: DataFrame, order: tuple[str, ...] = ("news_pos", "img_pos")) -> DataFrame:
    """O-A14: one row per (trend, url), the first occurrence wins (partial aggregate)."""
    others = [c for c in images.columns if c not in ("trend_id", "url")]
    first = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])).alias("_f")
    return images.groupBy("trend_id", "url").agg(first).select("trend_id", "url", "_f.*")


def first_places(images: DataFrame) -> DataFrame:
    """:func:`image_dedupe` for images of distinct pages of a trend (trend_id, news_pos, img_pos, url, width, height): a
    position of the trend has an image once, and sizes go with the URL, so the first place is a minimum of numbers, which Spark aggregates by hash
    where a minimum of structs is sorted."""
    return images.groupBy("trend_id", "url").agg(
        F.min_by("img_pos", "news_pos").alias("img_pos"), F.min("news_pos").alias("news_pos"), F.max("width").alias("width"),
        F.max("height").alias("height"))


def image_dims_lookup(images: DataFrame, image_meta: DataFrame) -> DataFrame:
    """O-J9 / O-SRC10: width/height by URL; unknown or undecodable (-1) -> 0 x 0."""
    meta = image_meta.groupBy("url").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    out = images.drop("width", "height").join(meta, "url", "left")
    fix = lambda c: F.when(F.col(c).isNull() | (F.col(c) < 0), F.lit(0)).otherwise(F.col(c)).cast("int")
    return out.withColumn("width", fix("width")).withColumn("height", fix("height"))


def media_rank(images: DataFrame, order: tuple[str, ...] = ("news_pos", "img_pos")) -> DataFrame:
    """O-W2: rank in a trend by area desc, zero area last, ties in discovery order
    (the reference's sort is stable), URL as the last tie-break."""
    area = F.col("width").cast("bigint") * F.col("height").cast("bigint")
    w = Window.partitionBy("trend_id").orderBy(
        F.when(area == 0, 1).otherwise(0), area.desc(), *[F.col(c) for c in order], F.col("url")
    )
    return images.withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_images(images: DataFrame, n: int = MAX_IMAGES, order: tuple[str, ...] = ("news_pos", "img_pos")) -> DataFrame:
    """O-S6 + O-W3: at most n images per trend, with their 0-based file index."""
    return media_rank(images, order).filter(F.col("rank") <= n).withColumn("file_index", F.col("rank") - 1)


def first_video(news: DataFrame, facts: DataFrame) -> DataFrame:
    """O-F17 + O-X19: the first video iframe of the first child page that has one."""
    v = facts.filter(F.col("video").isNotNull()).select(F.col("url").alias("page_url"), "video")
    # min_by is a partial aggregate: skew-safe per trend
    return _of_news(news, v).groupBy("trend_id").agg(F.min_by("video", "news_pos").alias("src")) \
        .select("trend_id", normalize_video_url(F.col("src")).alias("video_url"))


def video_thumbnail(videos: DataFrame, url_status: DataFrame) -> DataFrame:
    """O-X20 + O-SRC11: YouTube embed -> maxres when its probe answered 200, else hq;
    youtu.be -> maxres; Vimeo -> ``[0].thumbnail_large`` of the landed API JSON; else NULL."""
    u = F.col("video_url")
    yt, ys, vm = youtube_embed_id(u), youtu_be_id(u), vimeo_id(u)
    v = videos.select(
        "trend_id", "video_url",
        F.when(yt != "", _fmt(YOUTUBE_MAXRES, yt)).alias("_probe"),
        F.when(yt != "", _fmt(YOUTUBE_HQ, yt)).alias("_hq"),
        F.when((yt == "") & (ys != ""), _fmt(YOUTUBE_MAXRES, ys)).alias("_short"),
        F.when((yt == "") & (ys == "") & (vm != ""), _fmt(VIMEO_API, vm)).alias("_api"),
    )
    st = url_status.groupBy("url").agg(F.max("status").alias("status"), F.max("body").alias("body"))
    # one look-up by one key: a video has a probe or an API address or neither; those with neither skip the join, as NULL
    # keys would all meet in one task
    v = v.withColumn("_key", F.coalesce("_probe", "_api"))
    found = v.filter(F.col("_key").isNotNull()).join(st.withColumnRenamed("url", "_key"), "_key", "left")
    v = found.unionByName(v.filter(F.col("_key").isNull()), allowMissingColumns=True)
    vimeo_thumb = F.when(F.col("status") == 200, F.get_json_object(F.col("body"), "$[0].thumbnail_large"))
    thumb = (
        F.when(F.col("_probe").isNotNull(), F.when(F.col("status") == 200, F.col("_probe")).otherwise(F.col("_hq")))
        .when(F.col("_short").isNotNull(), F.col("_short"))
        .when(F.col("_api").isNotNull(), vimeo_thumb)
    )
    return v.select("trend_id", "video_url", thumb.alias("thumbnail_url"))


def media_book(facts: DataFrame, by_page: DataFrame, limit: int = BOOK_BYTES) -> tuple[DataFrame, DataFrame] | None:
    """What a trend could take of its pages, as numbers: one row (codes, places, images) and the table (page_url, at, video). ``by_page`` is
    :func:`page_top_images`. ``images`` is each distinct image in order of its URL, ``codes`` an array for each page, in page order,
    of ``class << 32 | index of the image`` with ``places`` beside it; the class is the order by area. None if all that is larger than ``limit``."""
    images = by_page.groupBy("url").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    videos = facts.filter(F.col("video").isNotNull()).groupBy(F.col("url").alias("page_url")).agg(F.min("video").alias("video"))
    row = lambda c: F.sum(F.octet_length(c) + 64)
    size = by_page.agg(row("page_url").alias("n")).unionAll(images.agg(row("url"))).unionAll(videos.agg(row("page_url") + row("video")))
    if (size.agg(F.sum("n").alias("n")).first()["n"] or 0) > limit:
        return None
    area = F.col("width").cast("bigint") * F.col("height").cast("bigint")
    # windows over all rows: no more than fit the book
    images = images.withColumn("no", F.row_number().over(Window.orderBy("url")) - 1) \
        .withColumn("class", F.dense_rank().over(Window.orderBy(F.when(area == 0, 1).otherwise(0), area.desc())).cast("bigint"))
    code = F.shiftleft("class", 32).bitwiseOR(F.col("no").cast("bigint"))
    pages = by_page.join(images.select("url", code.alias("code")), "url").groupBy("page_url") \
        .agg(F.sort_array(F.collect_list(F.struct("img_pos", "code"))).alias("i")).join(videos, "page_url", "full") \
        .select("page_url", F.coalesce("i", F.array().cast("array<struct<img_pos:bigint,code:bigint>>")).alias("i"), "video")
    pages = pages.withColumn("at", F.row_number().over(Window.orderBy("page_url")) - 1).checkpoint(eager=True)
    lists = pages.agg(F.sort_array(F.collect_list(F.struct("at", "i"))).alias("p")).select(
        F.transform("p", lambda x: x["i"]["code"]).alias("codes"), F.transform("p", lambda x: x["i"]["img_pos"]).alias("places"))
    urls = images.agg(F.sort_array(F.collect_list(F.struct("no", "url", "width", "height"))).alias("images"))
    return lists.crossJoin(urls).checkpoint(eager=True), F.broadcast(pages.select("page_url", "at", "video"))


def trend_pages(news: DataFrame, at: DataFrame) -> DataFrame:
    """(trend_id, at, news_pos): the first position of each page of a trend; a trend has no more rows than the book has pages, however often it
    lists them."""
    return _of_news(news, at.select("page_url", "at")).groupBy("trend_id", "at").agg(F.min("news_pos").alias("news_pos"))


def book_ranks(places: DataFrame, book: DataFrame, n: int = MAX_IMAGES) -> DataFrame:
    """(trend_id, nos): the images in the book that a trend keeps, by rank, as :func:`top_images` of :func:`first_places` has them.

    Pages in order of position give images in order of discovery; of these the distinct ones are ordered by class and place.
    Pages without a position, or with that of another page, take part by image, in the order of :func:`media_rank`."""
    low = (1 << 32) - 1

    def usual(codes: Column) -> Column:
        found = F.array_distinct(F.flatten(F.transform(F.array_sort("p"), lambda x: F.get(codes, x["at"]))))
        key = lambda c, i: c.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))
        return let(found, lambda f: F.transform(F.slice(F.sort_array(F.transform(f, key)), 1, n),
                                                lambda k: F.get(f, k.bitwiseAND(F.lit(low)).cast("int")).bitwiseAND(F.lit(low)).cast("int")))

    def by_image(codes: Column, places: Column) -> Column:
        of_page = lambda x: F.transform(F.get(codes, x["at"]), lambda c, i: F.struct(
            c.alias("code"), x["news_pos"].isNull().alias("none"), x["news_pos"].alias("news_pos"),
            F.when(x["news_pos"].isNotNull(), F.get(F.get(places, x["at"]), i)).alias("img_pos")))
        first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["code"] != x["code"]))
        ranked = F.transform(let(F.sort_array(F.flatten(F.transform("p", of_page))), first), lambda x: F.struct(
            F.shiftright(x["code"], 32).alias("class"), x["news_pos"].alias("news_pos"), x["img_pos"].alias("img_pos"), x["code"].alias("code")))
        return F.transform(F.slice(F.sort_array(ranked), 1, n), lambda x: x["code"].bitwiseAND(F.lit(low)).cast("int"))

    t = places.groupBy("trend_id").agg(F.collect_list(F.struct("news_pos", "at")).alias("p"))
    lists = book.select(F.struct("codes", "places")).scalar()
    unique = F.size(F.array_distinct(F.filter(F.col("p")["news_pos"], lambda x: x.isNotNull()))) == F.size("p")
    nos = let(F.col("_lists"), lambda b: F.when(unique, usual(b["codes"])).otherwise(by_image(b["codes"], b["places"])))
    return t.withColumn("_lists", lists).select("trend_id", nos.alias("nos"))


def book_images(ranks: DataFrame, book: DataFrame) -> DataFrame:
    """One row per kept image: the columns of ``ranks`` but ``nos``, and url, width, height, rank, file_index; a row without images
    has one row with NULLs."""
    others = [c for c in ranks.columns if c != "nos"]
    # outer: the rule that infers a filter from an explode would compute the array twice
    t = ranks.select(*others, F.posexplode_outer("nos").alias("_at", "_no")).withColumn("_i", F.get(book.select("images").scalar(), F.col("_no")))
    return t.select(*others, "_i.url", "_i.width", "_i.height", (F.col("_at") + 1).cast("bigint").alias("rank"), F.col("_at").cast("bigint").alias("file_index"))


def book_video(places: DataFrame, at: DataFrame) -> DataFrame:
    """:func:`first_video` from the pages of the book."""
    v = places.join(F.broadcast(at.filter(F.col("video").isNotNull()).select("at", "video")), "at")
    first = v.groupBy("trend_id").agg(F.min_by("at", "news_pos").alias("at"))
    return first.join(F.broadcast(at.select("at", "video")), "at", "left").select("trend_id", normalize_video_url(F.col("video")).alias("video_url"))


def with_own(trends: DataFrame, images: DataFrame) -> DataFrame:
    """``images`` met by their trends: every row of both sides, with the trend's feed picture as ``_own``."""
    return trends.select(F.col("id").alias("trend_id"), F.col("image_url").alias("_own")).join(images, "trend_id", "full")


def media_files(top: DataFrame, thumbs: DataFrame, trends: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """O-U2 + O-U3: the ordered file list per trend: video thumbnail first, then the
    kept images; a trend with no kept image falls back to its feed picture.
    Columns: trend_id, ord, kind, url, file_index, alt.

    Trends and kept images meet in one full join on the trend, the key that the rank has dealt the images by: a trend without
    a match is one that falls back, so the ranking is neither evaluated nor dealt a second time. ``met`` is that join where it is at hand."""
    alt = F.coalesce(F.col("alt"), F.lit("")) if "alt" in top.columns else F.lit("")
    imgs = top.select("trend_id", "rank", "url", "file_index", alt.alias("alt"))
    j = with_own(trends, imgs) if met is None else met.withColumn("alt", F.lit(""))
    kept = F.col("rank").isNotNull()
    both = j.filter(kept | (F.col("_own").isNotNull() & ~F.col("_own").isin("", "0"))).select(
        "trend_id", F.coalesce("rank", F.lit(1).cast("bigint")).alias("ord"), F.when(kept, F.lit("image")).otherwise(F.lit("fallback")).alias("kind"),
        F.when(kept, F.col("url")).otherwise(F.col("_own")).alias("url"), "file_index", F.coalesce("alt", F.lit("")).alias("alt"))
    th = thumbs.filter(F.col("thumbnail_url").isNotNull()).select(
        "trend_id", F.lit(0).cast("bigint").alias("ord"), F.lit("video_thumb").alias("kind"), F.col("thumbnail_url").alias("url"),
        F.lit(None).cast("bigint").alias("file_index"), F.lit("").alias("alt"),
    )
    return both.unionByName(th)


def media_counts(files: DataFrame, videos: DataFrame) -> DataFrame:
    """O-A13: kept images, attached files and video 0/1 per trend."""
    c = files.groupBy("trend_id").agg(
        F.count_if(F.col("kind") == "image").cast("bigint").alias("n_images"),
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
    )
    v = videos.select("trend_id", F.lit(1).alias("has_video"))
    return c.join(v, "trend_id", "full").select(
        "trend_id", F.coalesce("n_images", F.lit(0)).cast("bigint").alias("n_images"),
        F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"),
        F.coalesce("has_video", F.lit(0)).alias("has_video"),
    )


def media_manifest(files: DataFrame, titles: DataFrame) -> DataFrame:
    """O-SNK8 + O-X16/X17/X18: file name and alt text of every file.

    ``titles`` = (trend_id, title, slug) of the generated articles."""
    j = files.join(titles, "trend_id")
    ext = image_extension(F.col("url"))
    filename = (
        F.when(F.col("kind") == "image", image_filename(F.col("slug"), F.col("file_index"), ext))
        .when(F.col("kind") == "fallback", F.concat(F.col("slug"), F.lit(".jpg")))
        .otherwise(F.concat(F.col("slug"), F.lit("-video-thumb.jpg")))
    )
    alt = (
        F.when(F.col("kind") == "image", alt_text(F.col("alt"), F.col("title")))
        .when(F.col("kind") == "fallback", F.col("title"))
        .otherwise(F.concat(F.col("title"), F.lit(" - Video")))
    )
    return j.select("trend_id", "ord", "kind", "url", filename.alias("filename"), alt.alias("alt"))


def name_collisions(manifest: DataFrame) -> DataFrame:
    """File names written by more than one trend (the reference overwrites them)."""
    return manifest.groupBy("filename").agg(F.countDistinct("trend_id").alias("n_trends")).filter(F.col("n_trends") > 1)


def extract_media(news: DataFrame, pages: DataFrame, image_meta: DataFrame, url_status: DataFrame,
                  trends: DataFrame, landed: DataFrame | None = None, facts: DataFrame | None = None,
                  materialize: bool = False, book_bytes: int = BOOK_BYTES) -> dict[str, DataFrame]:
    """O-P4 composite. What the needed pages hold is computed once and checkpointed (spark.checkpoint.dir), as images and videos
    both come from it; ``facts`` is :func:`page_media` where it is at hand. With ``materialize`` the kept images and the
    videos are checkpointed too, for callers that use several of the outputs.

    Trends list the same pages again and again. Where what they could take of the pages is small (``book_bytes``), every task has that
    as one array, and trends are grouped with the places of their pages in it; more is joined to the news rows. Both
    ways give the same rows."""
    ensure_checkpoint_dir(news.sparkSession)
    facts = page_media(news, pages).checkpoint(eager=True) if facts is None else facts
    by_page = page_top_images(facts, image_meta, landed).checkpoint(eager=True)
    book = media_book(facts, by_page, book_bytes)
    met = None
    if book is None:
        top, videos = top_images(first_places(_of_news(news, by_page))), first_video(news, facts)
    else:
        places = trend_pages(news, book[1])
        ranks = book_ranks(places, book[0])
        top = book_images(ranks, book[0]).filter(F.col("rank").isNotNull())
        videos = book_video(places, book[1])
        # trends meet their images as one row, and rows of images come after the join: they are not sorted for it
        met = None if materialize else book_images(with_own(trends, ranks), book[0])
    if materialize:
        top, videos = top.checkpoint(eager=True), videos.checkpoint(eager=True)
    thumbs = video_thumbnail(videos, url_status)
    files = media_files(top, thumbs, trends, met)
    return {"images": top, "videos": thumbs, "files": files, "counts": media_counts(files, videos)}
