"""The landed pages that a set of news rows needs, read once.

The keys of the news reduce the pages on their narrow columns (url, page_id) first: one page a URL is picked
there, and only the picked rows' HTML is fetched, by a semi-join below every expression on it. One projection
then yields what both jobs want of a page: its cleaned text (O-P2), its image sources and its first video (O-P4);
a job that reads only some of these columns computes only those.

``page_id`` is the key of the pages; without such a column the greatest HTML of a URL is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions import is_video_url, main_content, scraped_piece

IMG_SRC = r"""(?i)<img\b[^>]*[ \t\n\r\f]src=["']([^"']*)["']"""
IFRAME_SRC = r"""(?i)<iframe\b[^>]*[ \t\n\r\f]src=["']([^"']*)["']"""


def needed_pages(news: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html): one page for each URL of ``news`` that has landed."""
    keys = news.filter(F.col("url").isNotNull()).select("url").distinct()
    if "page_id" not in pages.columns:
        return pages.join(keys, "url", "left_semi").groupBy("url").agg(F.max("html").alias("html"))
    pick = pages.select("url", "page_id").join(keys, "url", "left_semi").groupBy("url").agg(F.min("page_id").alias("page_id"))
    # the few pages that are left are dealt evenly: what is done with their HTML is the costly part
    return pages.join(pick, ["url", "page_id"], "left_semi").select("url", "html").repartition("url")


def page_facts(needed: DataFrame) -> DataFrame:
    """(url, piece, images, video): the cleaned text; the non-empty image sources as written, with their places; the first video source."""
    # two projections: the content column is computed once, not inlined per use
    p = needed.withColumn("content", main_content(F.col("html")))
    src = F.transform(F.regexp_extract_all(F.col("html"), F.lit(IMG_SRC), 1), lambda s, i: F.struct(i.alias("img_pos"), s.alias("src")))
    videos = F.filter(F.regexp_extract_all(F.col("html"), F.lit(IFRAME_SRC), 1), is_video_url)
    return p.select("url", scraped_piece(F.col("html"), F.col("content")).alias("piece"),
                    F.filter(src, lambda s: s["src"] != "").alias("images"), F.get(videos, F.lit(0)).alias("video"))
