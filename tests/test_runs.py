"""One feed document is one run (cap, later offers), history probe, and batches that stop anywhere."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from feeds import FEED_GOOD, FEED_LATER
from trendspark.operators import history as H
from trendspark.operators import ingest as I
from trendspark.operators import runs as R
from trendspark.params import Params
from trendspark.streaming import batches, jobs


def sequential(items, stored, min_traffic, cap):
    """Document by document, item by item."""
    keys, status = set(stored), {}
    for doc in sorted({x[0] for x in items}):
        took, mine = 0, set()
        for _, pos, title, traffic, pub in sorted(x for x in items if x[0] == doc):
            if took >= cap:
                status[pos] = "after_cap"
            elif min_traffic and traffic < min_traffic:
                status[pos] = "skipped_traffic"
            elif pub is None:
                status[pos] = "bad_date"
            elif (title, pub) in mine:
                status[pos] = "duplicate_in_feed"
            elif (title, pub) in keys:
                status[pos] = "duplicate_stored"
            else:
                keys.add((title, pub))
                mine.add((title, pub))
                status[pos] = "accepted"
                took += 1
    return status


@pytest.mark.parametrize("seed,docs,per_doc,titles,cap", [(1, 12, 10, 30, 3), (2, 30, 6, 8, 1), (3, 8, 25, 400, 5), (4, 20, 12, 12, 4), (5, 6, 9, 20, 100)])
def test_documents_are_runs(spark, seed, docs, per_doc, titles, cap):
    r = random.Random(seed)
    items = []
    for d in range(docs):
        for p in range(per_doc):
            hot = r.random() < 0.33  # one key is listed by nearly every document
            pub = None if r.random() < 0.06 else dt.datetime(2025, 1, 1 + (0 if hot else r.randrange(2)))
            items.append((d * 7 + 1, ((d * 7 + 1) << 32) + p, "hot" if hot else f"t{r.randrange(titles)}", r.randrange(200), pub))
    stored = [("t1", dt.datetime(2025, 1, 1)), ("t2", dt.datetime(2025, 1, 2))]
    idf = spark.createDataFrame(items, "doc long, feed_pos long, title string, traffic long, pub_date timestamp")
    none = spark.createDataFrame([], "feed_pos long, url string")
    sdf = spark.createDataFrame(stored, "title string, pub_date timestamp")
    got = R.document_status(idf, none, sdf, Params(min_traffic=20, max_trends=cap))
    assert {x.feed_pos: x.status for x in got.collect()} == sequential(items, stored, 20, cap)


def test_same_list_polled_again_and_again(spark):
    """Every poll takes the next ones of a long list, whatever number of polls is in a batch."""
    items = [(d, (d << 32) + p, f"t{p}", 10, dt.datetime(2025, 1, 1)) for d in range(1, 7) for p in range(20)]
    idf = spark.createDataFrame(items, "doc long, feed_pos long, title string, traffic long, pub_date timestamp")
    got = R.document_status(idf, spark.createDataFrame([], "feed_pos long, url string"), spark.createDataFrame([], "title string, pub_date timestamp"),
                            Params(max_trends=4)).filter("status = 'accepted'").collect()
    assert sorted((x.doc, x.title) for x in got) == sorted((1 + p // 4, f"t{p}") for p in range(20))


def test_history_probe(spark):
    days = [dt.datetime(2025, 1, d, h) for d in range(1, 21) for h in (0, 5)]
    d = tempfile.mkdtemp(dir="/tmp")
    rows = [(f"t{i}", p) for i in range(40) for p in days] + [("none", None)]
    spark.createDataFrame(rows, "title string, pub_date timestamp").withColumn("pub_day", H.pub_day(F.col("pub_date"))) \
        .write.partitionBy("pub_day").parquet(f"{d}/trends")
    stored = spark.read.schema("title string, pub_date timestamp, pub_day string").parquet(f"{d}/trends")
    items = spark.createDataFrame([("t3", days[4]), ("t4", None), ("new", days[8]), ("t39", days[9]), ("none", None)], "title string, pub_date timestamp")
    near = H.of_days(stored, items)
    files = {os.path.dirname(f).rsplit("=", 1)[1] for f in near.inputFiles()}
    assert near.filter("pub_day is not null").select("pub_day").distinct().count() == 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "pub_day" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and files
    got = {tuple(r) for r in H.stored_keys(stored, items).collect()}
    assert {("t3", days[4]), ("t39", days[9])} <= got and len(got) < 12  # others only by false hits
    assert {tuple(r) for r in H.may_hold(stored, items, words=1).select("title", "pub_date").collect()} >= {("t3", days[4]), ("t39", days[9])}  # a full filter drops nothing
    want = {r.title for r in I.not_yet_stored(items, stored).collect()}
    assert {r.title for r in I.not_yet_stored(items, H.stored_keys(stored, items)).collect()} == want == {"t4", "new", "none"}
    assert H.stored_keys(stored, items.limit(0)).count() == 0
    # a table without folders is read whole, with the same rows
    flat = stored.withColumn("pub_day", F.lit(None).cast("string"))
    assert {("t3", days[4]), ("t39", days[9])} <= {tuple(r) for r in H.stored_keys(flat, items).collect()}


def _tables(spark, d):
    out = {}
    for t in ("news", "trends", "audit"):
        cols = [c for c in spark.read.parquet(f"{d}/{t}").columns if c not in ("batch", "seq")]
        out[t] = sorted(map(str, spark.read.parquet(f"{d}/{t}").select(*sorted(cols)).collect()))
    return out


def _docs(spark):
    return spark.createDataFrame([("a.xml", FEED_GOOD), ("b.xml", FEED_LATER), ("c.xml", "<rss><channel></channel></rss>")], "path string, value string")


@pytest.mark.parametrize("stop", ["decisions", "news", "trends", "audit"])
def test_feed_batch_stops_anywhere(spark, monkeypatch, stop):
    whole, d = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    first = Params(max_trends=2, min_traffic=1)
    jobs.ingest_batch(spark, _docs(spark), whole, first, stream="s", epoch=0)
    want = _tables(spark, whole)
    assert len(want["trends"]) == 3 and len(want["audit"]) > 2

    class Stopped(Exception):
        pass

    def stopping(write, after):
        def f(self, *a, **k):
            write(self, *a, **k)
            if after is True or a[0] == after:
                raise Stopped
        return f

    with monkeypatch.context() as m:
        if stop == "decisions":
            m.setattr(batches.Batch, "decide", stopping(batches.Batch.decide, True))
        else:
            m.setattr(batches.Batch, "append", stopping(batches.Batch.append, stop))
        with pytest.raises(Stopped):
            jobs.ingest_batch(spark, _docs(spark), d, first, stream="s", epoch=0)
    # the replay comes with other parameters; what was decided stands
    jobs.ingest_batch(spark, _docs(spark), d, Params(max_trends=1, min_traffic=150), stream="s", epoch=0)
    assert _tables(spark, d) == want
    jobs.ingest_batch(spark, _docs(spark), d, first, stream="s", epoch=0)
    assert _tables(spark, d) == want
    # another stream: its ids go on, and children are under the trends they came with
    other = spark.createDataFrame([("z.xml", FEED_GOOD.replace("<title>c<", "<title>zz<"))], "path string, value string")
    jobs.ingest_batch(spark, other, d, first, stream="t", epoch=0)
    ids = [r.id for r in spark.read.parquet(f"{d}/trends").collect()]
    assert sorted(ids) == [1, 2, 3, 4]


def test_stopped_batch_is_finished_before_another_decides(spark, monkeypatch):
    d = tempfile.mkdtemp(dir="/tmp")
    write = batches.Batch.append
    with monkeypatch.context() as m:
        def stop(self, table, *a, **k):
            if table == "trends":
                raise RuntimeError("lost")
            write(self, table, *a, **k)
        m.setattr(batches.Batch, "append", stop)
        with pytest.raises(RuntimeError):
            jobs.ingest_batch(spark, _docs(spark), d, Params(max_trends=1), stream="s", epoch=4)
    assert len(batches.unfinished(spark, d, "feed")) == 1
    other = spark.createDataFrame([("z.xml", FEED_GOOD.replace("<title>", "<title>new "))], "path string, value string")
    jobs.ingest_batch(spark, other, d, Params(), stream="t", epoch=0)
    assert not batches.unfinished(spark, d, "feed")
    trends = {r.id: r.title for r in spark.read.parquet(f"{d}/trends").collect()}
    assert trends[1] == "a & b" and len(trends) == len(set(trends)) == 4
    news = {(r.trend_id, r.title) for r in spark.read.parquet(f"{d}/news").collect()}
    by_title = {t: i for i, t in trends.items()}
    assert {(by_title["a & b"], "n1"), (by_title["new a & b"], "n1"), (by_title["new c"], "n2"), (by_title["new c"], "n3")} == news


def test_many_small_documents_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    for k in range(60):
        (tmp_path / f"landing/doc={k:03d}").mkdir(parents=True)
        (tmp_path / f"landing/doc={k:03d}/feed.xml").write_text(FEED_GOOD)
    parts = []
    monkeypatch.setattr(jobs, "ingest_batch", lambda s, docs, *a, **b: parts.append((docs.rdd.getNumPartitions(), docs.count())))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"]
    spark.conf.set(names[0], "4m")
    try:
        before = [spark.conf.get(n, None) for n in names]
        jobs.start_feed_stream(spark, str(tmp_path / "landing"), str(tmp_path / "tables"), Params(), str(tmp_path / "ckpt")).awaitTermination()
        assert [spark.conf.get(n, None) for n in names] == before
        own = jobs.reading_session(spark)
    finally:
        spark.conf.unset(names[0])
    assert [n for _, n in parts] == [60] and parts[0][0] <= spark.sparkContext.defaultParallelism + 1 < 60
    assert int(own.conf.get(names[2])) <= jobs.LISTERS * spark.sparkContext.defaultParallelism


def test_listed_hosts_by_suffix(spark):
    """The hosts that have a listed suffix among their own, with empty labels, dots at either end and upper case."""
    from trendspark.functions import host_suffixes, url_host

    hosts = ["x.ru", "ru", "xru", "a.b.ru", "ru.a", "x..ru", "x.ru.", "X.RU", "", "b.a.cn", "a.cn", "c.cn"]
    news = spark.createDataFrame([(k, f"https://{h}/p") for k, h in enumerate(hosts)] + [(90, None), (91, ""), (92, "x.ru"), (93, "//u@x.ru:8/")],
                                 "feed_pos long, url string")
    for tlds in ("ru", " .ru, a.cn", "ru., 0", "RU,cn"):
        p = Params(filtered_tlds=tlds)
        listed = F.array(*[F.lit(t) for t in I.parse_tld_list(tlds)])
        host = url_host(F.col("url"))
        want = news.filter((host != "") & F.arrays_overlap(host_suffixes(host), listed))
        assert sorted(I.tld_flagged(news, p).collect()) == sorted(want.select("feed_pos").distinct().collect())


def test_small_batches_run_in_steps_of_one_task(spark, tmp_path, monkeypatch):
    """A batch up to the bound is planned once and not dealt out; the settings end with it, also when it fails; both ways write the same."""
    docs = spark.createDataFrame([("a.xml", FEED_GOOD), ("b.xml", FEED_LATER), ("c.xml", "<x")], "path string, value string")
    seen, whole = [], R.document_status
    names = sorted(jobs.FEW)
    before = [spark.conf.get(n, None) for n in names]

    def status(*a):
        seen.append([spark.conf.get(n) for n in names])
        return whole(*a)

    monkeypatch.setattr(jobs.R, "document_status", status)
    got = []
    for few in (4, 6):  # the documents have six items
        monkeypatch.setattr(jobs, "FEW_ITEMS", few)
        jobs.ingest_batch(spark, docs, str(tmp_path / f"t{few}"), Params(max_trends=5))
        assert [spark.conf.get(n, None) for n in names] == before
        got.append({t: sorted(map(str, spark.read.parquet(str(tmp_path / f"t{few}/{t}")).drop("batch", "seq").collect())) for t in ("trends", "news", "audit")})
    assert seen[0] == [spark.conf.get(n) for n in names] and seen[1] == [jobs.FEW[n] for n in names] and seen[0] != seen[1]
    assert got[0] == got[1] and len(got[0]["trends"]) == 3
    monkeypatch.setattr(jobs.R, "document_status", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        jobs.ingest_batch(spark, docs, str(tmp_path / "stopped"), Params(max_trends=5))
    assert [spark.conf.get(n, None) for n in names] == before


def test_folders_of_waves_are_listed_by_one_job(spark, tmp_path, monkeypatch):
    for w in range(4):
        for k in range(40):
            (tmp_path / f"landing/wave={w}/doc={k:03d}").mkdir(parents=True)
            (tmp_path / f"landing/wave={w}/doc={k:03d}/feed.xml").write_text(FEED_GOOD)
    counted = []
    monkeypatch.setattr(jobs, "ingest_batch", lambda s, docs, *a, **b: counted.append(docs.count()))
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        jobs.reading_session(spark).readStream.format("text").load(str(tmp_path / "landing"))
        assert len(sc.statusTracker().getJobIdsForGroup("listing")) == 1
    finally:
        sc._jsc.clearJobGroup()
    jobs.start_feed_stream(spark, str(tmp_path / "landing"), str(tmp_path / "tables"), Params(), str(tmp_path / "ckpt")).awaitTermination()
    assert counted == [160]
