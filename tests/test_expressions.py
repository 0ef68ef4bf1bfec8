"""Literal input/expected pairs for the scalar functions (FIXTURES.md)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import trendspark.functions as X
from trendspark.functions import text as T
from trendspark.functions.text import fill_template


def _eval(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_parse_traffic(spark):
    cases = {"200K+": 200, "2.5M+": 2500, "1B+": 1000000, "200+": 200, "1,000+": 1, "2 M": 2, "1.2.3K": 1,
             "1.005M": 1004, "n/a": 0, "": 0, " 50k ": 50, None: 0, "1\n2K": 0}
    assert _eval(spark, X.parse_traffic, list(cases)) == list(cases.values())


def test_migrate_traffic(spark):
    cases = {"1,000+": 1000, "2 M": 2000, "1B+": 1000000, "50K+": 50}
    assert _eval(spark, X.migrate_traffic, list(cases)) == list(cases.values())


def test_parse_pub_date(spark):
    got = _eval(spark, X.parse_pub_date, ["Tue, 2 Dec 2025 06:10:00 -0800", "bad", "2 Dec 2025 06:10:00 GMT", None])
    assert got == [dt.datetime(2025, 12, 2, 14, 10), None, dt.datetime(2025, 12, 2, 6, 10), None]


def test_url_host_and_tld_list(spark):
    got = _eval(spark, X.url_host, ["https://a.ru/x", "https://ru/", "https://guru.com", "https://x.NEWS:80/", "", "news.ru/x",
                                    "//cdn.x.org/a", "https://u:p@Host.Com:8080/a"])
    assert got == ["a.ru", "ru", "guru.com", "x.news", "", "", "cdn.x.org", "host.com"]
    assert X.parse_tld_list("ru, cn ,,News,0") == ["ru", "cn", "news"]
    assert X.parse_tld_list("") == [] and X.parse_tld_list(None) == []


def test_tld_filter_cases(spark):
    from trendspark.operators.ingest import tld_flagged
    from trendspark.params import Params

    urls = ["https://a.ru/x", "https://ru/", "https://guru.com", "https://x.NEWS:80/", "", "a.ru/no-scheme"]
    news = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "feed_pos long, url string")
    flagged = sorted(r[0] for r in tld_flagged(news, Params(filtered_tlds="ru, cn ,,News")).collect())
    assert flagged == [0, 1, 3]


def test_parse_response(spark):
    df = spark.createDataFrame([("A---TITLE_SEPARATOR---B---TAGS_SEPARATOR---c, d",), ("B---TAGS_SEPARATOR---c",),
                                ("\x0b T \n---TITLE_SEPARATOR---  body ",)], "r string")
    got = [tuple(r[0]) for r in df.select(X.parse_response(F.col("r"), F.lit("fb"))).collect()]
    assert got == [("A", "B", ["c", "d"]), ("fb", "B---TAGS_SEPARATOR---c", []), ("T", "body", [])]


def test_split_tags(spark):
    assert _eval(spark, X.split_tags, [" a, ,0,b", ""]) == [["a", "b"], []]


def test_parse_translation(spark):
    df = spark.createDataFrame([(" T \n---TITLE_SEPARATOR---\n B ",), ("no sep",)], "r string")
    got = [tuple(r[0]) for r in df.select(X.parse_translation(F.col("r"), F.lit("t0"), F.lit("b0"))).collect()]
    assert got == [("T", "B"), ("t0", "b0")]


def test_slugify(spark):
    got = _eval(spark, X.slugify, ["Élan Vital!", "--", "Straße Œuvre Łódź", "a" * 120 + " b"])
    assert got[:3] == ["elan-vital", "", "strasse-oeuvre-lodz"] and got[3] == "a" * 100


def test_image_extension_and_names(spark):
    assert _eval(spark, X.image_extension, ["x.JPEG", "x.webp", "x.png?w=1", "x.gif"]) == ["jpg", "webp", "jpg", "gif"]
    df = spark.createDataFrame([(0,), (3,)], "i long")
    got = [r[0] for r in df.select(X.image_filename(F.lit("s"), F.col("i"), F.lit("png"))).collect()]
    assert got == ["s.png", "s-3.png"]


def test_video_ids(spark):
    df = spark.createDataFrame([("https://www.youtube.com/embed/ID?x",), ("https://www.youtube.com/watch?v=ID",),
                                ("https://youtu.be/ID",), ("https://player.vimeo.com/video/123",)], "u string")
    got = df.select(X.youtube_embed_id(F.col("u")), X.youtu_be_id(F.col("u")), X.vimeo_id(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("ID", "", ""), ("", "", ""), ("", "ID", ""), ("", "", "123")]
    assert _eval(spark, X.normalize_video_url, ["//y/x", "https://y"]) == ["https://y/x", "https://y"]


def test_html_to_text_and_title(spark):
    html = "<html><head><title> A &amp; B </title><script>var x='<p>';</script></head><body><p>a &amp;lt; b</p>\n\n <!-- c -->d &copy;</body></html>"
    assert _eval(spark, X.html_to_text, [html]) == ["A & B a &lt; b d ©"]
    assert _eval(spark, X.page_title, [html]) == ["A & B"]


def test_token_cost_and_money(spark):
    df = spark.createDataFrame([(1000000, 1000000), (None, 500), (333, 777)], "i long, o long")
    got = [r[0] for r in df.select(X.token_cost(F.col("i"), F.col("o"), F.lit(0.15), F.lit(0.6))).collect()]
    assert [str(g) for g in got] == ["0.750000", "0.000300", "0.000516"]
    from decimal import Decimal

    c = spark.createDataFrame([(None,), (Decimal(0),), (Decimal("1.23456"),)], "c decimal(10,6)")
    assert [r[0] for r in c.select(X.money_text(F.col("c"), zero_is_na=True)).collect()] == ["N/A", "N/A", "$1.2346"]


def test_fill_template(spark):
    df = spark.range(1)
    assert df.select(fill_template("a %s b %s c %s 100%%", F.lit("1"), F.lit("2"), F.lit("3"))).first()[0] == "a 1 b 2 c 3 100%"
    with pytest.raises(ValueError):
        fill_template("%s only", F.lit("1"), F.lit("2"))


def test_romanisation(spark):
    titles = ["Война и мир", "Žluťoučký kůň", "Αθήνα σήμερα", "أخبار اليوم", "חדשות היום", "さくら カメラ", "Щука Чёрный ящик", "final Ⅳ", "中文 only", "日本"]
    got = _eval(spark, X.slugify, titles)
    assert got == ["voyna-i-mir", "zlutoucky-kun", "athina-simera", "akhbar-alywm", "hdshvt-hyvm", "sakura-kamera",
                   "shchuka-chernyy-yashchik", "final-iv", "only", ""]
    assert len(set(got)) == len(got)
    assert T.ROMAN_TABLE["é"] == "e" and T.ROMAN_TABLE["\u0301"] == "" and all(v.isascii() for v in T.ROMAN_TABLE.values())


def test_entities(spark):
    from trendspark.functions.text import decode_entities

    vals = ["&#39;x", "&#x41;&#233;&#x1F600;", "&#0; &#xD800;", "&amp;#39;", "&#8217;&#8217;",
            "&hellip;&NotEqualTilde;&CounterClockwiseContourIntegral;", "&copy &copy; &notin; &notit; &nosuch; &AMP;lt;", "a && b &; &#; &#x; &", "&#128; &#13; &#9;|",
            "&#00000065; &#x00041; &#99999999999; &#xFFFF; &#xFDD0;", "", None]
    assert _eval(spark, decode_entities, vals) == [
        "'x", "Aé😀", "&#0; &#xD800;", "&#39;", "’’", "…≂̸∳", "&copy © ∉ &notit; &nosuch; &lt;", "a && b &; &#; &#x; &", "&#128; &#13; \t|",
        "A A &#99999999999; &#xFFFF; &#xFDD0;", "", None]
