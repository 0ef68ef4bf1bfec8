"""Replay, gate, invalid answers, unanswered translations, dates, ids."""

import os
import tempfile

from pyspark.sql import functions as F

from feeds import FEED_GOOD, SF_SMALL
from trendspark.fixtures import fixture
from trendspark.functions import parse_pub_date
from trendspark.operators import translate as TR
from trendspark.operators.common import global_index
from trendspark.params import Params
from trendspark.streaming.jobs import ingest_batch, publish_batch, start_feed_stream


def _docs(spark):
    return spark.createDataFrame([("a.xml", FEED_GOOD)], "path string, value string")


def test_ingest_replay_after_news_only(spark):
    d, e = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    ingest_batch(spark, _docs(spark), d, Params(), stream="s")
    news = sorted(map(tuple, spark.read.parquet(f"{d}/news").collect()))
    # the state of a run that stopped before its trends: its decisions and its news are written
    for part in ("news", "_batches/feed/s/0/decisions"):
        spark.read.parquet(f"{d}/{part}").write.parquet(f"{e}/{part}")
    ingest_batch(spark, _docs(spark), e, Params(), stream="s")
    assert sorted(map(tuple, spark.read.parquet(f"{e}/news").collect())) == news
    assert spark.read.parquet(f"{e}/trends").count() == spark.read.parquet(f"{d}/trends").count()


def test_disabled_import_reads_nothing(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    os.makedirs(f"{d}/land")
    with open(f"{d}/land/a.xml", "w") as f:
        f.write(FEED_GOOD)
    args = (spark, f"{d}/land", f"{d}/tables")
    assert start_feed_stream(*args, Params(import_enabled=False), checkpoint=f"{d}/c") is None
    start_feed_stream(*args, Params(), checkpoint=f"{d}/c").awaitTermination()
    assert spark.read.parquet(f"{d}/tables/trends").count() > 0


def test_publish_replay_and_invalid_answer(spark):
    from trendspark.operators.state import current_trends
    from trendspark.plans import q_publish

    d = tempfile.mkdtemp(dir="/tmp")
    trends, calls = fixture(spark, SF_SMALL, "fx_trends"), fixture(spark, SF_SMALL, "fx_ai_calls")
    trends.write.parquet(f"{d}/trends")
    vocab, users = fixture(spark, SF_SMALL, "fx_vocab"), fixture(spark, SF_SMALL, "fx_users")
    bad = calls.withColumn("response", F.lit(None).cast("string"))
    assert publish_batch(spark, bad, d, vocab, users, q_publish.P) == 0
    assert spark.read.parquet(f"{d}/audit").filter("reason = 'invalid_response'").count() == calls.count()
    n = publish_batch(spark, calls, d, vocab, users, q_publish.P)
    e = tempfile.mkdtemp(dir="/tmp")
    trends.write.parquet(f"{e}/trends")
    spark.read.parquet(f"{d}/articles").write.parquet(f"{e}/articles")  # stopped before the update log
    assert n > 0 and publish_batch(spark, calls, e, vocab, users, q_publish.P) == 0
    done = current_trends(spark.read.parquet(f"{e}/trends"), spark.read.parquet(f"{e}/trend_updates"))
    assert done.join(spark.read.parquet(f"{e}/articles").select(F.col("trend_id").alias("id")), "id").filter("processed = 0").count() == 0


def test_unanswered_pairs_are_not_written(spark):
    fan = spark.createDataFrame([(1, "fr", "T", "B"), (1, "de", "T", "B")], "node_id long, langcode string, title string, body string")
    answers = spark.createDataFrame([(1, "fr", "no separator")], "node_id long, langcode string, response string")
    assert [(r.langcode, r.title) for r in TR.write_translations(fan, answers).collect()] == [("fr", "T")]


def test_dates_and_index(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = ["Tue, 02 Dec 25 06:10:00 +0000", "2025-12-02T06:10:00Z", "2025-12-02T07:10:00+01:00", "Tue, 2 Dec 2025 06:10:00 +0000", "x"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(F.date_format(parse_pub_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("d"))
    assert [r.d for r in df.collect()] == ["2025-12-02 06:10:00"] * 4 + [None]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        i = global_index(spark.range(200_000).repartition(7), ["id"], "i")
        assert i.filter("i <> id").count() == 0 and i.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
