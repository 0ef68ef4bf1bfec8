"""O-T1..T4: incremental runs over landing folders.

* ``start_feed_stream`` (O-T1, O-T2): new feed files -> the ingest job per
  micro-batch, appended to the trends/news tables. A file is one run with its own cap
  (``operators/runs.py``), however many files a micro-batch has. ``availableNow``
  drains what has landed; ``maxFilesPerTrigger`` bounds a micro-batch. The checkpoint
  records each file once; a micro-batch that stops is taken up from what it decided
  (``batches.py``).
* ``start_publish_stream`` (O-T3, O-T4): new model answers, raw or normalised ->
  articles with their media. An answer whose trend already has an article is
  skipped (retry-safe), failures go to the audit and attempts tables and leave the
  trend pending.
* ``start_translation_stream`` (O-P5): new translation answers -> translations.

Checkpoints and tables live under the shared folder named by
``spark.checkpoint.dir`` unless a path is given.
"""

from __future__ import annotations

import hashlib
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trendspark import schemas as S
from trendspark.operators import history as H
from trendspark.operators.common import kept
from trendspark.operators import ingest as I
from trendspark.operators import publish as PB
from trendspark.operators import runs as R
from trendspark.operators import state as ST
from trendspark.operators import translate as TR
from trendspark.params import Params
from trendspark.sources import feed as FEED
from trendspark.sources.dimensions import model_prices
from trendspark.session import ensure_checkpoint_dir, settings
from trendspark.streaming.batches import Batch, filesystem, read_or_empty, run


def stream_name(checkpoint: str) -> str:
    """A stream is known by its checkpoint, as its epochs are counted there."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:24]



NEWS_OUT = "id bigint, trend_id bigint, news_pos bigint, title string, snippet string, url string, source string"
#: stored trends and the folder (day of the date) they are kept in; NULL where a table is kept without folders
TRENDS_IN = T.StructType([*S.TRENDS.fields, T.StructField("pub_day", T.StringType()), T.StructField("batch", T.StringType())])


def read_trends(spark: SparkSession, tables: str) -> DataFrame:
    return read_or_empty(spark, f"{tables}/trends", TRENDS_IN)


def _parts(**frames: DataFrame | None) -> DataFrame:
    """Several frames as one table of decisions: ``part`` and a struct column for each."""
    out = None
    for name, df in frames.items():
        if df is not None:
            d = df.select(F.lit(name).alias("part"), F.struct(*df.columns).alias(name))
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("seq", F.monotonically_increasing_id())


def _part(decisions: DataFrame, name: str) -> DataFrame | None:
    if name not in decisions.columns:
        return None
    return decisions.filter(F.col("part") == name).select(f"{name}.*", "seq")


#: Items up to which a batch is small: its steps are many and take a task each, planned once. What it reads of stored trends has passed
#: the filter of its keys.
FEW_ITEMS = 20_000
FEW = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}


def _ingest_decisions(spark: SparkSession, docs: DataFrame, tables: str, params: Params, scope: ExitStack) -> DataFrame:
    """The accepted trends and their news, with their ids, and an audit row for every other item and every rejected document.
    The settings of a small batch hold until ``scope`` ends."""
    parsed = kept(FEED.checked(FEED.parse_documents(docs)))  # the XML is parsed once
    if (parsed.agg(F.sum(F.size("items"))).first()[0] or 0) <= FEW_ITEMS:
        scope.enter_context(settings(spark, FEW))
    items = kept(I.typed_items(FEED.feed_items(parsed)))
    stored = read_trends(spark, tables)
    # the children of an item stay behind while its status is found
    status = kept(R.document_status(items.drop("news_item"), FEED.news_explode(items), H.stored_keys(stored, items), params))
    # ids go on after those of published articles too, which outlive a cleared table
    arts = read_or_empty(spark, f"{tables}/articles", ARTICLES_OUT)
    last = max(stored.agg(F.max("id")).first()[0] or 0, arts.agg(F.max("trend_id")).first()[0] or 0)
    ids = R.numbered(status.filter(F.col("status") == I.ACCEPTED).select("feed_pos"), last + 1)
    took = kept(status.join(ids, "feed_pos").join(items.select("feed_pos", "news_item"), "feed_pos"))
    last_news = read_or_empty(spark, f"{tables}/news", NEWS_OUT).agg(F.max("id")).first()[0] or 0
    rejects = parsed.filter(F.col("reason").isNotNull()).select(
        F.lit("feed").alias("stage"), F.col("path").alias("key"), "reason", F.lit(None).cast("string").alias("detail"))
    return _parts(trend=I.append_trends(took, params), news=I.append_news(FEED.news_explode(took), took, last_news),
                  audit=I.audit_rows(status).unionByName(rejects))


def _ingest_apply(batch: Batch) -> None:
    d = batch.decisions()
    batch.append("news", _part(d, "news").drop("seq"), ["id"])
    batch.append("trends", _part(d, "trend").drop("seq").withColumn("pub_day", H.pub_day(F.col("pub_date"))), ["id"], day="pub_day")
    batch.append("audit", _part(d, "audit"), ["seq"])


def ingest_batch(spark: SparkSession, docs: DataFrame, tables: str, params: Params, stream: str | None = None, epoch: int = 0) -> dict[str, int]:
    """Runs over feed documents (path, value), one a document, in path order; appends to ``tables``. ``stream`` and ``epoch``
    name the batch, so that its replay changes nothing. A disabled import reads and writes nothing."""
    if not params.import_enabled:
        return {"accepted": 0}
    batch = Batch(spark, tables, "feed", stream, epoch)
    with ExitStack() as scope:
        if not run(batch, lambda: _ingest_decisions(spark, docs, tables, params, scope), _ingest_apply):
            return {"accepted": 0}
        return {"accepted": batch.decisions().filter("part = 'trend'").count()}


#: What a small file counts for beside its bytes when files are dealt to tasks, and listing tasks for each core.
OPEN_COST, LISTERS = 64 << 10, 4


def reading_session(spark: SparkSession) -> SparkSession:
    """``spark`` with settings of its own for landing folders of many small files, one in a folder: a task reads hundreds of them,
    and folders are listed by one job of a few tasks a core (Spark deals four files to a task of 16 MB, lists each folder by a task, and
    each folder of more than 32 folders by a job).
    The streams started from it, and their batches, keep the settings; ``spark`` has its own."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    open_cost, listers = "spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() > OPEN_COST:
        own.conf.set(open_cost, str(OPEN_COST))
    most = LISTERS * spark.sparkContext.defaultParallelism
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", "1")
    own.conf.set(listers, str(min(most, spark._jsparkSession.sessionState().conf().parallelPartitionDiscoveryParallelism())))
    return own


def start_feed_stream(spark: SparkSession, landing: str, tables: str, params: Params,
                      checkpoint: str | None = None, max_files: int | None = None,
                      available_now: bool = True) -> StreamingQuery | None:
    """Start the stream; None, with nothing read, if the import is disabled."""
    if not params.import_enabled:
        return None
    base = ensure_checkpoint_dir(spark)
    ckpt = checkpoint or f"{base.rstrip('/')}/streams/feed"
    reader = reading_session(spark).readStream.format("text").option("wholetext", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(landing).select(F.col("_metadata.file_path").alias("path"), "value")

    def each(batch: DataFrame, epoch_id: int) -> None:
        ingest_batch(batch.sparkSession, batch, tables, params, stream=stream_name(ckpt), epoch=epoch_id)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    return w.start()


ANSWERS = ("call_id bigint, trend_id bigint, trend_title string, provider string, model string, response string, "
           "input_tokens bigint, output_tokens bigint")
#: answers as the providers send them
RAW_ANSWERS = "call_id bigint, trend_id bigint, trend_title string, provider string, model string, json string"
ARTICLES_OUT = ("trend_id bigint, type string, title string, status int, uid bigint, body string, created bigint, "
                "tag_ids array<bigint>, images array<struct<filename:string,alt:string>>, domain_access string, domain_source string, "
                "cost decimal(10,6), node_id bigint")
MEDIA_OUT = "trend_id bigint, ord bigint, kind string, url string, filename string, alt string"
ATTEMPTS_OUT = "trend_id bigint, call_id bigint, attempt bigint, reason string"
TRANSLATIONS_OUT = "node_id bigint, langcode string, title string, body string, tag_ids array<bigint>"


def _publish_decisions(spark: SparkSession, answers: DataFrame, tables: str, vocab: DataFrame, users: DataFrame, params: Params,
                       media: dict[str, DataFrame] | None) -> DataFrame:
    if "json" in answers.columns:
        answers = PB.normalize_answers(answers)
    answers = answers.checkpoint(eager=True)
    trends = ST.current_trends(read_or_empty(spark, f"{tables}/trends", S.TRENDS), read_or_empty(spark, f"{tables}/trend_updates", ST.UPDATES))
    existing = read_or_empty(spark, f"{tables}/articles", ARTICLES_OUT)
    if media is not None and "news" not in media:
        media = {**media, "news": read_or_empty(spark, f"{tables}/news", NEWS_OUT)}
    out = PB.publish_articles(answers, trends, vocab, users, model_prices(spark), params, media, existing, materialize=True)
    attempts = PB.failed_attempts(answers, read_or_empty(spark, f"{tables}/attempts", ATTEMPTS_OUT))
    # articles of trends that are still pending (written by earlier versions that stopped before the update) are completed too
    old = existing.join(trends.filter(F.col("processed") == 0).select(F.col("id").alias("trend_id")), "trend_id", "left_semi")
    done = out["articles"].select("trend_id", "node_id", "cost").unionByName(old.select("trend_id", "node_id", "cost"))
    updates = ST.trend_updates(done.select(F.col("trend_id").alias("id"), "node_id", F.col("cost").alias("processing_cost")), params.as_of_epoch)
    return _parts(article=out["articles"], file=out["files"], update=updates, attempt=attempts, audit=out["audit"])


def _publish_apply(batch: Batch) -> None:
    d = batch.decisions()
    for name, table, key in (("article", "articles", ["trend_id"]), ("file", "media", ["trend_id", "ord", "kind"]),
                             ("update", "trend_updates", ["id"]), ("attempt", "attempts", ["call_id"])):
        rows = _part(d, name)
        if rows is not None:
            batch.append(table, rows.drop("seq"), key)
    batch.append("audit", _part(d, "audit"), ["seq"])


def publish_batch(spark: SparkSession, answers: DataFrame, tables: str, vocab: DataFrame, users: DataFrame,
                  params: Params, media: dict[str, DataFrame] | None = None, stream: str | None = None, epoch: int = 0) -> int:
    """Articles for new answers (raw or normalised) of pending trends, with their video, images and tags; trends already
    published are skipped (O-T4). Answers that can't be used go to the audit and to ``attempts``, their trends stay
    pending. Everything is decided before the first write (``batches.py``); published trends are marked processed through
    the append-only update log."""
    batch = Batch(spark, tables, "publish", stream, epoch)
    if not run(batch, lambda: _publish_decisions(spark, answers, tables, vocab, users, params, media), _publish_apply):
        return 0
    return _part(batch.decisions(), "article").count()


def start_publish_stream(spark: SparkSession, landing: str, tables: str, vocab: DataFrame, users: DataFrame,
                         params: Params, checkpoint: str | None = None, media: dict[str, DataFrame] | None = None,
                         raw: bool = False) -> StreamingQuery:
    """``raw``: the landed answers are provider JSON (:data:`RAW_ANSWERS`)."""
    base = ensure_checkpoint_dir(spark)
    ckpt = checkpoint or f"{base.rstrip('/')}/streams/publish"
    stream = spark.readStream.schema(RAW_ANSWERS if raw else ANSWERS).parquet(landing)

    def each(batch: DataFrame, epoch_id: int) -> None:
        publish_batch(batch.sparkSession, batch, tables, vocab, users, params, media, stream=stream_name(ckpt), epoch=epoch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


TRANSLATION_ANSWERS = "node_id bigint, langcode string, response string"


def pending_translations(spark: SparkSession, tables: str, languages: DataFrame, params: Params) -> DataFrame:
    """O-P5: the requests to send: (node_id, langcode, title, body, prompt) of published articles without that translation."""
    arts, have = read_or_empty(spark, f"{tables}/articles", ARTICLES_OUT), read_or_empty(spark, f"{tables}/translations", TRANSLATIONS_OUT)
    return TR.missing_translation(TR.translation_fanout(arts, languages, params), have)


def translate_batch(spark: SparkSession, answers: DataFrame, tables: str, languages: DataFrame, params: Params,
                    stream: str | None = None, epoch: int = 0) -> int:
    """O-P5, O-SNK7: translations for new answers (node_id, langcode, response), tags copied from the article; pairs that have
    one are skipped, unanswered ones stay to be asked."""
    batch = Batch(spark, tables, "translate", stream, epoch)

    def decide() -> DataFrame:
        arts, have = read_or_empty(spark, f"{tables}/articles", ARTICLES_OUT), read_or_empty(spark, f"{tables}/translations", TRANSLATIONS_OUT)
        first = answers.filter(F.col("response").isNotNull()).groupBy("node_id", "langcode").agg(F.min("response").alias("response"))
        return TR.translate_articles(arts, languages, have, first, params)["translations"]

    if not run(batch, decide, lambda b: b.append("translations", b.decisions(), ["node_id", "langcode"])):
        return 0
    return batch.decisions().count()


def start_translation_stream(spark: SparkSession, landing: str, tables: str, languages: DataFrame, params: Params,
                             checkpoint: str | None = None) -> StreamingQuery:
    base = ensure_checkpoint_dir(spark)
    ckpt = checkpoint or f"{base.rstrip('/')}/streams/translate"
    stream = spark.readStream.schema(TRANSLATION_ANSWERS).parquet(landing)

    def each(batch: DataFrame, epoch_id: int) -> None:
        translate_batch(batch.sparkSession, batch, tables, languages, params, stream=stream_name(ckpt), epoch=epoch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


#: the tables of an importer, children first
TABLES = ("news", "trends", "trend_updates", "attempts", "prompts", "_batches")


def clear_tables(spark: SparkSession, tables: str) -> list[str]:
    """O-SNK9: drop the stored news, trends and pending work, children first; articles, their files, translations and the audit stay,
    as the reference keeps its nodes and log. Returns what was dropped. Not to be run beside a stream."""
    out = []
    for name in TABLES:
        fs, p = filesystem(spark, f"{tables}/{name}")
        if fs.exists(p) and fs.delete(p, True):
            out.append(name)
    return out
