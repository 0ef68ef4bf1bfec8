"""The command line over landed feed files: fetch, then dashboard and listing."""

import json
import os
import tempfile

from feeds import FEED_GOOD, FEED_LATER


def test_fetch_dashboard_listing(spark, capsys):
    from trendspark.__main__ import main

    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{d}/feeds")
    for name, text in (("a1.xml", FEED_GOOD), ("b1.xml", FEED_LATER)):
        with open(f"{d}/feeds/{name}", "w") as f:
            f.write(text)
    main(["fetch", "--feeds", f"{d}/feeds", "--tables", f"{d}/tables", "--as-of", "2025-12-05 00:00:00"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"trends": 3}
    main(["dashboard", "--tables", f"{d}/tables", "--as-of", "2025-12-05 00:00:00"])
    dash = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert dash["total_trends"] == 3 and dash["pending_trends"] == 3 and dash["trends_this_month"] == 3
    assert [r["title"] for r in dash["top_traffic"]] == ["c", "a & b", "e"]
    main(["listing", "--tables", f"{d}/tables"])
    assert capsys.readouterr().out.strip() == ""  # nothing processed yet


def test_whole_run(spark, capsys):
    """Feed to article with media and tags, its translation, the news report, and clearing."""
    from trendspark.__main__ import main

    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{d}/feeds")
    with open(f"{d}/feeds/a1.xml", "w") as f:
        f.write(FEED_GOOD)
    t = f"{d}/tables"
    say = lambda: [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    main(["fetch", "--feeds", f"{d}/feeds", "--tables", t, "--as-of", "2025-12-05 00:00:00"])
    html = ('<html><head><title>Page</title></head><body><p>' + "word " * 30 + '</p><img src="/i/a.png"><img src="/i/dead.png">'
            '<iframe src="//www.youtube.com/embed/xyz"></iframe></body></html>')
    spark.createDataFrame([(1, "https://b.com/a", html)], "page_id long, url string, html string").write.parquet(f"{d}/pages")
    spark.createDataFrame([("https://b.com/i/a.png", 4, 3)], "url string, width int, height int").write.parquet(f"{d}/meta")
    spark.createDataFrame([("x", 200, "")], "url string, status int, body string").write.parquet(f"{d}/probes")
    spark.createDataFrame([(5, "tags", "War")], "tid long, vid string, name string").write.parquet(f"{d}/vocab")
    spark.createDataFrame([(7, 1)], "uid long, status int").write.parquet(f"{d}/users")
    spark.createDataFrame([("fr", "French", 0)], "langcode string, name string, is_default int").write.parquet(f"{d}/languages")
    main(["prompts", "--tables", t, "--pages", f"{d}/pages", "--vocab", f"{d}/vocab", "--tag-vocabulary", "tags"])
    assert say()[-1] == {"prompts": 1}
    body = json.dumps({"choices": [{"message": {"content": "Война\n---TITLE_SEPARATOR---\nText\n---TAGS_SEPARATOR---\nWar, Peace"}}],
                       "usage": {"promptTokens": 10, "completionTokens": 5}})
    raw = [(1, 2, "c", "openai", "gpt-4o-mini", body[:40]), (2, 2, "c", "openai", "gpt-4o-mini", body)]
    spark.createDataFrame(raw, "call_id long, trend_id long, trend_title string, provider string, model string, json string").write.parquet(f"{d}/answers")
    publish = ["publish", "--tables", t, "--answers", f"{d}/answers", "--vocab", f"{d}/vocab", "--users", f"{d}/users", "--raw", "--tag-vocabulary", "tags",
               "--tag-field", "field_tags", "--random-author", "--pages", f"{d}/pages", "--image-meta", f"{d}/meta", "--probes", f"{d}/probes"]
    for _ in range(2):  # the second run finds nothing new
        main(publish)
        assert say()[-1] == {"articles": 1}
    a = spark.read.parquet(f"{t}/articles").first()
    assert (a.trend_id, a.title, a.uid, a.tag_ids) == (2, "Война", 7, [5]) and a.body.endswith("</div>\n\nText") and "embed/xyz" in a.body
    assert [tuple(i) for i in a.images] == [("voyna-video-thumb.jpg", "Война - Video"), ("voyna.png", "Война"), ("voyna-1.png", "Война")]
    assert spark.read.parquet(f"{t}/media").count() == 3
    assert [tuple(r) for r in spark.read.parquet(f"{t}/attempts").select("trend_id", "call_id", "attempt", "reason").collect()] == [(2, 1, 1, "malformed_answer")]
    codes = ["--tables", t, "--languages", f"{d}/languages", "--codes", "fr"]
    main(["requests", *codes])
    asked = say()
    assert len(asked) == 1 and asked[0]["node_id"] == a.node_id and "Война" in asked[0]["prompt"]
    spark.createDataFrame([(a.node_id, "fr", "Guerre---TITLE_SEPARATOR---Texte")], "node_id long, langcode string, response string").write.parquet(f"{d}/tr")
    main(["translate", *codes, "--answers", f"{d}/tr"])
    assert say()[-1] == {"translations": 1}
    r = spark.read.parquet(f"{t}/translations").first()
    assert (r.node_id, r.langcode, r.title, r.body, r.tag_ids) == (a.node_id, "fr", "Guerre", "Texte", [5])
    main(["requests", *codes])
    assert say() == []
    main(["news", "--tables", t, "--trend", "2"])
    assert [(x["news_id"], x["news_title"], x["title"]) for x in say()] == [(3, "n3", "c"), (2, "n2", "c")]
    main(["listing", "--tables", t])
    assert [(x["id"], x["article_title"]) for x in say()] == [(2, "Война"), (1, None)]
    main(["clear", "--tables", t, "--yes"])
    assert set(say()[-1]["cleared"]) >= {"news", "trends", "trend_updates"}
    with open(f"{d}/feeds/b1.xml", "w") as f:
        f.write(FEED_GOOD)
    main(["fetch", "--feeds", f"{d}/feeds", "--tables", t, "--as-of", "2025-12-06 00:00:00"])
    assert say()[-1] == {"trends": 2}
    assert sorted(r.id for r in spark.read.parquet(f"{t}/trends").collect()) == [3, 4]  # ids of published articles are not given again
