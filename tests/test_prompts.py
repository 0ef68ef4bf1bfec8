"""A hot trend's text by ranges of positions, and only needed pages read."""

import random

from pyspark.sql import functions as F

from trendspark.operators import prompts as PR
from trendspark.operators.pages import needed_pages


def test_hot_trend_text_equals_one_step(spark):
    r = random.Random(3)
    rows = [(1 if i % 3 == 0 else i % 40, r.randrange(10**9), f"u{r.randrange(30)}") for i in range(900)]  # a third under one trend
    news = spark.createDataFrame(rows, "trend_id long, news_pos long, url string")
    pieces = spark.createDataFrame([(f"u{k}", f"text {k} " if k % 5 else "") for k in range(28)], "url string, piece string")
    whole = {x.trend_id: (x.text, x.has_text) for x in PR.trend_text(news, pieces).collect()}
    got = {x.trend_id: (x.text, x.has_text) for x in PR.trend_text(news, pieces, chunk_rows=40).collect()}
    by = dict((x.url, x.piece) for x in pieces.collect())
    want = {t: "".join(by.get(u, "") + "\n\n---\n\n" for _, _, u in sorted(x for x in rows if x[0] == t)) for t in {x[0] for x in rows}}
    assert got == whole and {t: x for t, (x, _) in got.items()} == want


def test_pages_are_reduced_below_the_regexes(spark):
    pages = spark.createDataFrame([(k, f"u{k % 6}", f"<p>{k}</p>") for k in range(12)], "page_id long, url string, html string")
    news = spark.createDataFrame([(1, 0, "u1"), (1, 1, "u4"), (2, 0, "gone"), (2, 1, None)], "trend_id long, news_pos long, url string")
    got = needed_pages(news, pages)
    assert sorted(tuple(x) for x in got.collect()) == [("u1", "<p>1</p>"), ("u4", "<p>4</p>")]
    plan = got.select("url", F.regexp_replace("html", "<[^>]*>", "").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("LeftSemi")


def test_texts_are_put_together_after_the_grouping(spark):
    """Pages as one array, and pages joined to the news rows, give the same texts; the first way groups places, not texts."""
    news = spark.createDataFrame([(t, k // 2, f"u{(t * k) % 9}" if k % 4 else None) for t in range(20) for k in range(t)],
                                 "trend_id long, news_pos long, url string")
    pieces = spark.createDataFrame([("u0", " \n"), ("u1", "b"), ("u2", "b c"), ("u3", "\t"), ("u4", None), ("u5", "a"), ("u5", "b"), ("u6", "")],
                                   "url string, piece string")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    want = rows(PR.trend_text(news, pieces, book_bytes=0))
    assert rows(PR.trend_text(news, pieces)) == want == rows(PR.trend_text(news, pieces, chunk_rows=3, book_bytes=0))
    titles = spark.createDataFrame([(3, "x"), (9, "y"), (99, "z")], "trend_id long, title string")
    by = dict((3, "x") if t == 3 else (9, "y") for t in (3, 9))
    want = [(*x, by[x[0]]) for x in want if x[0] in by and x[2] == 1]
    for size in (0, PR.BOOK_BYTES):
        assert rows(PR.trend_text(news, pieces, titles=titles, with_text_only=True, book_bytes=size)) == want
    plan = PR.trend_text(news, pieces).select(F.md5("text"), F.char_length("text"))._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(x for x in plan.splitlines() if "Aggregate [trend_id" in x)
    assert "piece" not in aggregate and "collect_list" in aggregate
    assert not [x for x in plan.splitlines() if "_texts#" in x]  # no row holds the array


def test_texts_are_written_where_all_pages_are_held(spark):
    """Pages too large for an array that the texts repeat: no row that is shuffled or sorted holds a text."""
    news = spark.createDataFrame([(t, k // 2, f"u{(t * k) % 11}" if k % 4 else None) for t in range(40) for k in range(t)],
                                 "trend_id long, news_pos long, url string")
    long = [("u0", " \n"), ("u1", "b" * 900), ("u2", "b c" * 300), ("u3", "\t"), ("u4", None), ("u5", "a" * 700), ("u5", "é" * 500), ("u6", ""),
            ("u7", "z" * 9)]
    pieces = spark.createDataFrame(long, "url string, piece string")
    titles = spark.createDataFrame([(t, f"x{t}") for t in range(7, 45)] + [(9, "z")], "trend_id long, title string")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    shuffled = lambda df: [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x and "piece" in x]
    for more in ({}, {"titles": titles, "with_text_only": True}):
        dealt, shelved = PR.trend_text(news, pieces, book_bytes=0, shelf_bytes=0, **more), PR.trend_text(news, pieces, book_bytes=0, **more)
        assert rows(shelved) == rows(dealt) == rows(PR.trend_text(news, pieces, **more))
        assert shelved.columns == dealt.columns and shuffled(dealt) and not shuffled(shelved)
        assert "MapInArrow" in shelved._jdf.queryExecution().optimizedPlan().toString()
    told = PR.trend_text(news, pieces, with_text=False)
    assert rows(told) == sorted((t, h) for t, _, h in rows(PR.trend_text(news, pieces)))


def test_a_written_batch_holds_few_texts(spark, monkeypatch):
    monkeypatch.setattr(PR, "BATCH_BYTES", 100)
    import pyarrow as pa

    page = pa.record_batch({"trend_id": pa.nulls(3, pa.int64()), "_at": pa.nulls(3, pa.list_(pa.int32())), "_no": pa.array([1, 2, 0], pa.int32()),
                            "_p": ["x" * 60, "é" * 200, PR.TEXT_PIECE_SEPARATOR]})
    trends = pa.record_batch({"trend_id": pa.array([5, 6, 7, 8], pa.int64()), "_at": pa.array([[1, 0], [2, 1], [], [1]], pa.list_(pa.int32())),
                              "_no": pa.nulls(4, pa.int32()), "_p": pa.nulls(4, pa.string())})
    got = list(PR._write_texts(["trend_id"])(iter([trends, page])))
    end = PR.TEXT_PIECE_SEPARATOR
    assert [(r["trend_id"], r["text"]) for b in got for r in b.to_pylist()] == [(5, "x" * 60 + end), (6, "é" * 200 + "x" * 60), (7, ""), (8, "x" * 60)]
    assert [b.num_rows for b in got] == [1, 1, 2]
