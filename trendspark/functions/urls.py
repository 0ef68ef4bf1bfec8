"""URL expressions: hosts, TLD lists, video and image URLs (O-X4, X5, X16-X21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark.functions.text import html_escape

__all__ = [
    "url_host", "parse_tld_list", "host_suffixes", "is_video_url", "normalize_video_url",
    "youtube_embed_id", "youtu_be_id", "vimeo_id", "image_extension", "image_filename",
    "alt_text", "embed_video", "VIDEO_HOSTS", "VIDEO_FRAME",
]

# Hosts whose iframes count as videos.
VIDEO_HOSTS = ["youtube.com", "youtu.be", "vimeo.com"]


def url_host(url: Column) -> Column:
    """Lower-cased host, '' when the URL has none (no scheme and no //authority)."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\[\]]+)", 1))


def parse_tld_list(s: str | None) -> list[str]:
    """O-X5 on the parameter: comma split, trim, lower-case, drop blanks (and '0')."""
    if not s:
        return []
    out = []
    for p in s.lower().split(","):
        p = p.strip(" \t\n\r\x00\x0b")
        if p not in ("", "0"):
            out.append(p)
    return out


def host_suffixes(host: Column) -> Column:
    """``news.x.ru`` -> [news.x.ru, x.ru, ru]: a host matches suffix t when it equals t
    or ends with '.t', so the theta join becomes an equi-join on these values."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def is_video_url(src: Column) -> Column:
    """Case-sensitive substring test, as the XPath ``contains`` in the reference."""
    cond = F.lit(False)
    for h in VIDEO_HOSTS:
        cond = cond | F.contains(src, F.lit(h))
    return cond


def normalize_video_url(src: Column) -> Column:
    return F.when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src)).otherwise(src)


def youtube_embed_id(u: Column) -> Column:
    return F.regexp_extract(u, r"youtube\.com/embed/([^?&]+)", 1)


def youtu_be_id(u: Column) -> Column:
    return F.regexp_extract(u, r"youtu\.be/([^?&]+)", 1)


def vimeo_id(u: Column) -> Column:
    return F.regexp_extract(u, r"vimeo\.com/video/(\d+)", 1)


def image_extension(url: Column) -> Column:
    """jpg/jpeg/png/gif/webp at the very end (case-insensitive); jpeg -> jpg; else jpg."""
    e = F.lower(F.regexp_extract(url, r"(?i)\.(jpe?g|png|gif|webp)$", 1))
    return F.when(e.isin("", "jpeg"), F.lit("jpg")).otherwise(e)


def image_filename(slug: Column, index: Column, ext: Column) -> Column:
    """index 0 -> ``slug.ext``; n -> ``slug-n.ext``."""
    return F.when(index == 0, F.concat(slug, F.lit("."), ext)).otherwise(
        F.concat(slug, F.lit("-"), index.cast("string"), F.lit("."), ext)
    )


def alt_text(alt: Column, title: Column) -> Column:
    return F.when(alt.isNull() | alt.isin("", "0"), title).otherwise(alt)


# Fixed value: the markup around an embedded video's address.
VIDEO_FRAME = (
    '<div class="embedded-video" style="position: relative; padding-bottom: 56.25%; height: 0; overflow: hidden; max-width: 100%; margin: 20px 0;">'
    '<iframe src="%s" style="position: absolute; top: 0; left: 0; width: 100%; height: 100%;" frameborder="0" allow="accelerometer; autoplay; '
    'clipboard-write; encrypted-media; gyroscope; picture-in-picture" allowfullscreen></iframe></div>'
)


def embed_video(body: Column, video_url: Column) -> Column:
    """Prefix the body with a responsive iframe for the three video hosts (O-X21)."""
    before, after = VIDEO_FRAME.split("%s")
    frame = F.concat(F.lit(before), html_escape(video_url), F.lit(after))
    ok = video_url.isNotNull() & (video_url != "") & is_video_url(video_url)
    return F.when(ok, F.concat(frame, F.lit("\n\n"), F.coalesce(body, F.lit("")))).otherwise(body)
