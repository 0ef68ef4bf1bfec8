"""O-SRC10, O-S6: landed image files: their sizes, from the bytes of their headers, and their listing.

Width and height of PNG, GIF, JPEG and WebP files are read by Column expressions on the first bytes, without decoding a pixel
and without Python. What is none of these, or is cut off before its size, is 0 x 0, as an image that can't be read. Spark lists no empty files; they are as files that have not landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions.text import let

# Signatures of the formats, and the JPEG markers that are no frame header though they look like one.
PNG = "89504E470D0A1A0A"
GIF = ("474946383761", "474946383961")  # GIF87a, GIF89a
RIFF, WEBP = "52494646", "57454250"
VP8, VP8L, VP8X = "56503820", "5650384C", "56503858"
JPEG = "FFD8"
NOT_FRAMES = (0xC4, 0xC8, 0xCC)
#: Segments of a JPEG file that are walked before its frame header; real files have a few dozen.
MAX_SEGMENTS = 4_096


def _hex(c: Column, at, n: int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.hex(F.substr(c, at + 1, F.lit(n)))


def _big(c: Column, at, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` bytes; NULL where the bytes end before."""
    return let(_hex(c, at, n), lambda h: F.when(F.char_length(h) == 2 * n, F.conv(h, 16, 10).cast("long")))


def _little(c: Column, at, n: int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return let(F.concat(*[_hex(c, at + k, 1) for k in reversed(range(n))]), lambda h: F.when(F.char_length(h) == 2 * n, F.conv(h, 16, 10).cast("long")))


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def _jpeg(c: Column) -> Column:
    """Walk the segments to the frame header: ``at`` is the place of the next marker, ``frame`` that of the frame header."""
    steps = F.sequence(F.lit(1), F.least(F.lit(MAX_SEGMENTS), F.floor(F.octet_length(c) / 4).cast("int") + 1))
    start = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("frame"))

    def step(s: Column, _: Column) -> Column:
        def look(m: Column) -> Column:  # the marker FFxx and its length as one number
            kind = F.pmod(F.floor(m / 65536), F.lit(256)).cast("int")
            marker = F.floor(m / 16777216) == 0xFF
            frame = marker & kind.between(0xC0, 0xCF) & ~kind.isin(*NOT_FRAMES)
            fill = marker & (kind == 0xFF)  # a marker may be led by further FF bytes
            on = F.when(fill, s["at"] + 1).when(marker & (kind != 0xDA) & (kind != 0xD9), s["at"] + 2 + F.pmod(m, F.lit(65536)))
            return F.struct(F.when(~frame, on).alias("at"), F.when(frame, s["at"]).alias("frame"))

        return F.when(s["at"].isNull() | s["frame"].isNotNull(), s).otherwise(let(_big(c, s["at"], 4), look))

    return let(F.aggregate(steps, start, step), lambda s: F.when(s["frame"].isNotNull(), _size(_big(c, s["frame"] + 7, 2), _big(c, s["frame"] + 5, 2))))


def _webp(c: Column) -> Column:
    kind = _hex(c, 12, 4)
    bits = _little(c, 21, 4)  # lossless: 14 bits each, less one
    return (
        F.when(kind == VP8X, _size(_little(c, 24, 3) + 1, _little(c, 27, 3) + 1))
        .when((kind == VP8) & (_hex(c, 23, 3) == "9D012A"), _size(_little(c, 26, 2).bitwiseAND(0x3FFF), _little(c, 28, 2).bitwiseAND(0x3FFF)))
        .when((kind == VP8L) & (_hex(c, 20, 1) == "2F"),
              _size(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1))
    )


def image_size(content: Column) -> Column:
    """STRUCT<width, height> of an image file's bytes; 0 x 0 if they can't be read."""
    c = content
    size = (
        F.when(_hex(c, 0, 8) == PNG, _size(_big(c, 16, 4), _big(c, 20, 4)))
        .when(_hex(c, 0, 6).isin(*GIF), _size(_little(c, 6, 2), _little(c, 8, 2)))
        .when((_hex(c, 0, 4) == RIFF) & (_hex(c, 8, 4) == WEBP), _webp(c))
        .when(_hex(c, 0, 2) == JPEG, _jpeg(c))
    )
    whole = lambda s: s["width"].isNotNull() & s["height"].isNotNull()
    return let(size, lambda s: F.when(whole(s), s).otherwise(_size(F.lit(0), F.lit(0))))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """O-SRC10: (url, width, height) of the landed image files."""
    s = _files(spark, path).select(F.col("path").alias("url"), image_size(F.col("content")).alias("s"))
    return s.select("url", "s.width", "s.height")


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """O-S6: (url, length) of the landed files, from the listing alone: no file is opened."""
    return _files(spark, path).select(F.col("path").alias("url"), "length")
