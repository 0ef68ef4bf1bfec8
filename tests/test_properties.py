"""Property checks on whole fixture tables."""

from pyspark.sql import functions as F

from feeds import SF_SMALL
from trendspark.fixtures import fixture, table
from trendspark.functions import slugify
from trendspark.operators import publish as PB
from trendspark.operators.common import global_index
from trendspark.plans import q_media, q_publish


def test_slug_shape(spark):
    docs = table(spark, SF_SMALL, "documents").select(slugify(F.col("text")).alias("s"))
    assert docs.filter(~F.col("s").rlike(r"^[a-z0-9-]{0,100}$")).count() == 0


def test_tag_ids_come_from_vocabulary(spark):
    p = PB.parsed(fixture(spark, SF_SMALL, "fx_ai_calls"))
    vocab = fixture(spark, SF_SMALL, "fx_vocab")
    ids = PB.tags_to_terms(p, vocab, q_publish.P).select(F.explode("tag_ids").alias("tid"))
    assert ids.join(vocab, "tid", "left_anti").count() == 0


def test_at_most_ten_images(spark):
    top = q_media._media(spark, SF_SMALL)["images"]
    assert top.groupBy("trend_id").count().filter(F.col("count") > 10).count() == 0


def test_global_index_is_dense(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k").repartition(13)
    idx = global_index(df, ["k"], "i").orderBy("k").collect()
    assert [r.i for r in idx] == list(range(len(idx)))
    assert all(a.k < b.k for a, b in zip(idx, idx[1:]))


def test_publish_twice_adds_nothing(spark):
    calls = PB.latest_answer(fixture(spark, SF_SMALL, "fx_ai_calls"))
    first = calls.select("trend_id")
    assert PB.new_only(calls, first).count() == 0


def test_current_trends_takes_newest_update(spark):
    from decimal import Decimal

    from trendspark.operators.state import UPDATES, current_trends
    from trendspark import schemas as S

    t = spark.createDataFrame([(1, "a", 5, None, "l", None, None, 0, None, 10, None), (2, "b", 5, None, "l", None, None, 0, None, 10, None)],
                              S.TRENDS)
    u = spark.createDataFrame([(1, 1, 100, Decimal("0.1"), 20), (1, 1, 101, Decimal("0.2"), 30)], UPDATES)
    got = {r.id: (r.processed, r.node_id, r.processing_cost) for r in current_trends(t, u).collect()}
    assert got == {1: (1, 101, Decimal("0.200000")), 2: (0, None, None)}
