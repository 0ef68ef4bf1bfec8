"""Feed files (good, no namespace, malformed, empty) and the incremental runs."""

import os
import tempfile

from pyspark.sql import functions as F

from feeds import FEED_BAD, FEED_EMPTY, FEED_GOOD, FEED_LATER, FEED_NO_NS
from trendspark.params import Params
from trendspark.sources.feed import read_feed
from trendspark.streaming.jobs import start_feed_stream


def _land(files):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    land = os.path.join(d, "landing")
    os.makedirs(land)
    for name, text in files:
        with open(os.path.join(land, name), "w") as f:
            f.write(text)
    return d, land


def test_feed_source_and_rejects(spark):
    d, land = _land([("a1.xml", FEED_GOOD), ("a2.xml", FEED_NO_NS), ("a3.xml", FEED_BAD), ("a4.xml", FEED_EMPTY)])
    f = read_feed(spark, land)
    items = f["items"].orderBy("feed_pos").collect()
    assert [r.title for r in items] == ["a & b", "c", "d", "c"]
    assert items[0].snippet == "x <b>y</b>" and items[0].picture == "http://p/1.jpg"
    news = f["news"].orderBy("feed_pos", "news_pos").collect()
    assert [(r.title, r.snippet, r.url) for r in news][:2] == [("n1", "", "https://News.Example.RU:8080/a"), ("n2", "", "https://b.com/a")]
    rejects = {os.path.basename(r.path): r.reason for r in f["rejects"].collect()}
    assert rejects == {"a2.xml": "no_ht_namespace", "a3.xml": "malformed", "a4.xml": "no_items"}


def test_feed_stream_is_incremental_and_idempotent(spark):
    d, land = _land([("a1.xml", FEED_GOOD)])
    tables, ckpt = os.path.join(d, "tables"), os.path.join(d, "ckpt")
    start_feed_stream(spark, land, tables, Params(), checkpoint=ckpt).awaitTermination()
    t1 = spark.read.parquet(f"{tables}/trends").orderBy("id").collect()
    assert [(r.id, r.title, r.traffic) for r in t1] == [(1, "a & b", 200), (2, "c", 2000)]
    news = spark.read.parquet(f"{tables}/news").collect()
    assert sorted((r.trend_id, r.title) for r in news) == [(1, "n1"), (2, "n2"), (2, "n3")]
    # same checkpoint, nothing new landed: nothing happens
    start_feed_stream(spark, land, tables, Params(), checkpoint=ckpt).awaitTermination()
    assert spark.read.parquet(f"{tables}/trends").count() == 2
    # a new file: only its unseen item is added, with the next id
    with open(os.path.join(land, "b1.xml"), "w") as f:
        f.write(FEED_LATER)
    start_feed_stream(spark, land, tables, Params(), checkpoint=ckpt).awaitTermination()
    t3 = spark.read.parquet(f"{tables}/trends").orderBy("id").collect()
    assert [(r.id, r.title) for r in t3] == [(1, "a & b"), (2, "c"), (3, "e")]
    # a fresh checkpoint re-reads every file, but the stored-key anti-join adds nothing
    start_feed_stream(spark, land, tables, Params(), checkpoint=os.path.join(d, "ckpt2")).awaitTermination()
    assert spark.read.parquet(f"{tables}/trends").count() == 3
    audit = spark.read.parquet(f"{tables}/audit").filter(F.col("stage") == "ingest").collect()
    assert {r.reason for r in audit} >= {"bad_date", "duplicate_in_feed", "duplicate_stored"}


def test_max_files_per_trigger_bounds_a_run(spark):
    d, land = _land([("a1.xml", FEED_GOOD), ("b1.xml", FEED_LATER)])
    tables = os.path.join(d, "tables")
    q = start_feed_stream(spark, land, tables, Params(max_trends=1), checkpoint=os.path.join(d, "ckpt"), max_files=1)
    q.awaitTermination()
    # one file per micro-batch, at most one accepted item per batch
    assert spark.read.parquet(f"{tables}/trends").count() == 2


def test_publish_stream_is_retry_safe(spark):
    from feeds import SF_SMALL
    from trendspark.fixtures import fixture
    from trendspark.plans import q_publish
    from trendspark.streaming.jobs import start_publish_stream

    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    fixture(spark, SF_SMALL, "fx_trends").write.parquet(f"{d}/tables/trends")
    fixture(spark, SF_SMALL, "fx_ai_calls").write.parquet(f"{d}/landing")
    vocab, users = fixture(spark, SF_SMALL, "fx_vocab"), fixture(spark, SF_SMALL, "fx_users")
    start_publish_stream(spark, f"{d}/landing", f"{d}/tables", vocab, users, q_publish.P, checkpoint=f"{d}/c1").awaitTermination()
    n1 = spark.read.parquet(f"{d}/tables/articles").count()
    assert n1 > 0
    # replay every answer with a fresh checkpoint: the article guard adds nothing
    start_publish_stream(spark, f"{d}/landing", f"{d}/tables", vocab, users, q_publish.P, checkpoint=f"{d}/c2").awaitTermination()
    arts = spark.read.parquet(f"{d}/tables/articles")
    assert arts.count() == n1 and arts.select("trend_id").distinct().count() == n1
    # published trends are processed now, with their node id and cost
    from trendspark.operators.state import current_trends

    cur = current_trends(spark.read.parquet(f"{d}/tables/trends"), spark.read.parquet(f"{d}/tables/trend_updates"))
    done = cur.join(arts.select(F.col("trend_id").alias("id"), F.col("node_id").alias("n")), "id")
    assert done.filter((F.col("processed") != 1) | (F.col("node_id") != F.col("n"))).count() == 0
    assert done.count() == n1


def test_too_long_and_scrape_audit(spark):
    import datetime as dt

    from trendspark.operators import ingest as I
    from trendspark.operators.prompts import scrape_audit

    items = spark.createDataFrame([(1, "t" * 256, "l", 10, dt.datetime(2025, 1, 1)), (2, "ok", "l", 10, dt.datetime(2025, 1, 1))],
                                  "feed_pos long, title string, link string, traffic long, pub_date timestamp")
    empty = spark.createDataFrame([], "feed_pos long, url string")
    none = spark.createDataFrame([], "title string, pub_date timestamp")
    st = {r.feed_pos: r.status for r in I.item_status(items, empty, none, Params()).collect()}
    assert st == {1: "too_long", 2: "accepted"}
    news = spark.createDataFrame([(1, 0, "https://a/x"), (1, 1, "https://b/y")], "trend_id long, news_pos long, url string")
    pages = spark.createDataFrame([(0, "https://a/x", "<html><body></body></html>")], "page_id long, url string, html string")
    got = {(r.key, r.reason) for r in scrape_audit(news, pages).collect()}
    assert got == {("1:0", "no_content"), ("1:1", "scrape_failed")}


def _png(width, height):
    import struct
    import zlib

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body) & 0xFFFFFFFF)

    raw = b"".join(b"\x00" + b"\x80\x40\x20" * width for _ in range(height))
    ihdr = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _jpeg(width, height, fill=b""):
    import struct

    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
    exif = b"\xff\xe1" + struct.pack(">H", 2 + 300) + b"\xff\xc0\x00\x11" * 75  # looks like frame headers inside
    table = b"\xff\xc4" + struct.pack(">H", 4) + b"\x00\x00"
    return b"\xff\xd8" + app + exif + table + fill + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9) + b"\xff\xd9"


def test_image_dims_from_landed_files(spark):
    import struct

    from trendspark.sources.images import landed_files, read_images

    riff = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    bits = (301 - 1) | ((77 - 1) << 14)
    files = {
        "a.png": (_png(4, 3), (4, 3)), "big.png": (_png(700, 2), (700, 2)), "cut.png": (_png(4, 3)[:20], (0, 0)),
        "a.gif": (b"GIF89a" + struct.pack("<HH", 640, 480) + bytes(3), (640, 480)), "b.gif": (b"GIF87a" + struct.pack("<HH", 1, 65535), (1, 65535)),
        "a.jpg": (_jpeg(1920, 1080), (1920, 1080)), "fill.jpg": (_jpeg(33, 44, b"\xff\xff"), (33, 44)), "cut.jpg": (_jpeg(1920, 1080)[:60], (0, 0)),
        "no-frame.jpg": (b"\xff\xd8\xff\xda\x00\x02" + bytes(50), (0, 0)),
        "x.webp": (riff(b"VP8X" + struct.pack("<I", 10) + bytes(4) + (1023).to_bytes(3, "little") + (2).to_bytes(3, "little")), (1024, 3)),
        "v.webp": (riff(b"VP8 " + struct.pack("<I", 20) + b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 320 | 0x4000, 200)), (320, 200)),
        "l.webp": (riff(b"VP8L" + struct.pack("<I", 9) + b"\x2f" + struct.pack("<I", bits)), (301, 77)),
        "broken.png": (b"not an image", (0, 0)),
    }
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, (data, _) in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    got = {os.path.basename(r.url): (r.width, r.height) for r in read_images(spark, d).collect()}
    assert got == {name: size for name, (_, size) in files.items()}
    # whole files: the same as Spark's own image reader
    decoded = spark.read.format("image").option("dropInvalid", True).load(f"{d}/*.png").select("image.origin", "image.width", "image.height").collect()
    assert {os.path.basename(r.origin): (r.width, r.height) for r in decoded} == {n: got[n] for n in ("a.png", "big.png")}
    assert {os.path.basename(r.url): r.length for r in landed_files(spark, d).collect()} == {n: len(x) for n, (x, _) in files.items()}


def test_dead_images_take_no_place(spark):
    from trendspark.operators import media as M

    html = "".join(f'<img src="https://i/{k}.png">' for k in range(30))
    pages = spark.createDataFrame([(1, "https://a/x", html), (2, "https://b/y", html + '<img src="https://i/0.png">')], "page_id long, url string, html string")
    news = spark.createDataFrame([(1, 0, "https://a/x"), (1, 1, "https://b/y"), (2, 0, "https://b/y")], "trend_id long, news_pos long, url string")
    meta = spark.createDataFrame([(f"https://i/{k}.png", 10 + k, 10) for k in range(30)], "url string, width int, height int")
    landed = spark.createDataFrame([(f"https://i/{k}.png", 5 if k % 2 else 0) for k in range(28)], "url string, length long")
    status = spark.createDataFrame([], "url string, status int, body string")
    trends = spark.createDataFrame([(1, "p"), (2, "p"), (3, "https://own/p.jpg")], "id long, image_url string")
    out = M.extract_media(news, pages, meta, status, trends, landed)
    files = sorted((r.trend_id, r.ord, r.kind, r.url) for r in out["files"].collect())
    want = [(t, n + 1, "image", f"https://i/{k}.png") for t in (1, 2) for n, k in enumerate(range(27, 7, -2))]
    assert files == want + [(3, 1, "fallback", "https://own/p.jpg")]


def test_published_cost_projection(spark):
    from decimal import Decimal

    from trendspark.operators.costs import published_projection
    from trendspark.sources.dimensions import cost_ranges

    rows = {(r.model, r.per_day): (r.min_day, r.max_day) for r in published_projection(cost_ranges(spark)).collect()}
    assert rows[("GPT-4o Mini", 120)] == (Decimal("0.3600"), Decimal("1.2000"))
    assert rows[("Claude 3 Opus", 240)] == (Decimal("48.0000"), Decimal("240.0000"))
    assert len(rows) == 24


def test_documents_are_written_last_and_parsed_once(spark):
    from trendspark.sources import feed as FEED
    from trendspark.sources.feed_docs import feed_documents

    items = spark.createDataFrame([(k, "t", "1K+", "d", f"l{k}", "a < b" if k % 2 else None, "") for k in (1, 2, 2, 105)],
                                  "feed_pos long, title string, approx_traffic string, pub_date_raw string, link string, snippet string, picture string")
    news = spark.createDataFrame([(2, 7, "news 10", "s", "u", "x"), (2, 7, "news 1", "s", "u", "x"), (2, 3, "n & m", None, "u", "x"), (9, 1, "no item", "", "", ""),
                                  (None, 1, "no trend", "", "", "")],
                                 "trend_id long, news_pos long, title string, snippet string, url string, source string")
    docs = feed_documents(items, news)
    got = {r.doc_id: r.value for r in docs.collect()}
    one = "<ht:news_item><ht:news_item_title>{}</ht:news_item_title><ht:news_item_snippet>{}</ht:news_item_snippet><ht:news_item_url>u</ht:news_item_url><ht:news_item_source>x</ht:news_item_source></ht:news_item>"
    children = one.format("n &amp; m", "") + one.format("news 10", "s") + one.format("news 1", "s")
    assert sorted(got) == [0, 1] and got[0].count("<item>") == 3 and got[0].count(children) == 2 and "no item" not in got[0]
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("<rss") < plan.index("Join") and "<ht:news_item>" not in plan[plan.index("Join"):]
    parsed = FEED.parse_documents(docs.select(F.col("doc_id").cast("string").alias("path"), "value"))
    plan = FEED.feed_rejects(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    assert [(r.path, r.feed_pos) for r in FEED.feed_items(parsed).orderBy("feed_pos").collect()] == [("0", (1 << 32) + k) for k in range(3)] + [("1", 2 << 32)]


def test_waves_are_written_once(spark, monkeypatch):
    import glob

    from feeds import SF_SMALL
    from trendspark.plans import q_sources

    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    monkeypatch.setattr(q_sources, "_scratch", lambda spark, kind: f"{d}/{kind}")
    whole = sorted(tuple(r) for r in q_sources._feed_stream(spark, SF_SMALL, None, None).collect())
    monkeypatch.setattr(q_sources, "_scratch", lambda spark, kind: f"{d}/waves")
    assert sorted(tuple(r) for r in q_sources._feed_stream(spark, SF_SMALL, 8, 8).collect()) == whole
    assert len(glob.glob(f"{d}/waves/landing/wave=*")) == 2 and not glob.glob(f"{d}/waves/written/wave=*")
    landed = glob.glob(f"{d}/waves/landing/wave=*/doc=*/*.gz")
    assert len(landed) == 15 == len(glob.glob(f"{d}/feed/landing/wave=*/doc=*/*.gz"))


def test_media_by_book_and_by_join_agree(spark):
    import random
    import re

    from trendspark.operators import media as M

    rng = random.Random(5)
    urls = [f"https://i/{k}.png" for k in range(25)]
    frames = ["//www.youtube.com/embed/a?x=1", "https://youtu.be/b", "https://maps/x"]
    rows = [(p, f"https://p/{p}", "".join(f'<img src="{u}">' for u in rng.choices(urls, k=rng.randint(0, 14))) + f'<iframe src="{rng.choice(frames)}"></iframe>')
            for p in range(12)]
    pages = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string")
    # news listed twice, positions missing, pages that never landed, unknown trends, a NULL trend
    news = [(t, rng.choice([k, None]) if t % 3 == 0 else k, f"https://p/{rng.randint(0, 13)}") for t in range(1, 40) for k in range(rng.randint(1, 12))]
    news += [(90 + t, 7, f"https://p/{p}") for t in range(6) for p in (t, t + 5)] + [(None, 1, "https://p/3")]
    news = spark.createDataFrame(news + news[:30], "trend_id long, news_pos long, url string")
    meta = spark.createDataFrame([(u, k // 4 * 10 - 10, 5) for k, u in enumerate(urls)], "url string, width int, height int")
    status = spark.createDataFrame([("https://img.youtube.com/vi/a/maxresdefault.jpg", 200, "")], "url string, status int, body string")
    trends = spark.createDataFrame([(k, "own") for k in [*range(70), 3, 69]] + [(None, "own")], "id long, image_url string")

    def files(**kw):
        # two pages at one position, from trend 90 on, are compared with the rule below
        out = {k: v.filter("trend_id IS NULL OR trend_id < 90") for k, v in M.extract_media(news, pages, meta, status, trends, **kw).items()}
        return [sorted(map(repr, out["files"].collect())), sorted(map(repr, out["counts"].collect())),
                sorted(map(repr, out["images"].select("trend_id", "url", "width", "height", "rank", "file_index").collect()))]

    joined = files(book_bytes=0)
    assert len(joined[2]) > 200 and files() == joined == files(materialize=True)
    place = {p: {u: i for i, u in reversed(list(enumerate(re.findall('<img src="([^"]*)"', h))))} for p, _, h in rows}
    area = {u: max(0, k // 4 * 10 - 10) for k, u in enumerate(urls)}
    want = []
    for t in range(6):
        first = {u: min(place[p][u] for p in (t, t + 5) if u in place[p]) for u in {**place[t], **place[t + 5]}}
        want += [(90 + t, u) for u in sorted(first, key=lambda u: (area[u] == 0, -area[u], first[u], u))[:10]]
    got = M.extract_media(news, pages, meta, status, trends)["images"].filter("trend_id >= 90").orderBy("trend_id", "rank").collect()
    assert [(r.trend_id, r.url) for r in got] == want
    # rows of images are neither shuffled nor sorted: no window over them
    plan = M.extract_media(news, pages, meta, status, trends)["files"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Window" in M.extract_media(news, pages, meta, status, trends, book_bytes=0)["files"]._jdf.queryExecution().optimizedPlan().toString()
