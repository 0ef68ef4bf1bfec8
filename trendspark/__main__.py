"""Command line: the reference's admin actions as Spark runs over landed files.

  python -m trendspark fetch     --feeds DIR --tables DIR [--min-traffic N] [--max-trends N] [--filtered-tlds S]
  python -m trendspark prompts   --tables DIR --pages PATH --vocab PATH [--tag-vocabulary V] [--template FILE]
  python -m trendspark publish   --tables DIR --answers DIR --vocab PATH --users PATH [--raw] [--tag-field F] [--random-author]
                                 [--pages PATH --image-meta PATH --probes PATH [--images DIR]]
  python -m trendspark requests  --tables DIR --languages PATH --codes fr,de      (translation requests still to send)
  python -m trendspark translate --tables DIR --languages PATH --codes fr,de --answers DIR
  python -m trendspark dashboard --tables DIR [--as-of 'YYYY-MM-DD HH:MM:SS']
  python -m trendspark listing   --tables DIR [--page N] [--sort COL] [--order asc|desc]
  python -m trendspark news      --tables DIR [--page N] [--trend ID]
  python -m trendspark clear     --tables DIR --yes

Table layout under --tables: trends/ (by day of the date) news/ (append-only), trend_updates/ (state log), articles/, media/ (files
of the articles), translations/, attempts/ (answers that can't be used), prompts/, audit/, _batches/ (what running batches decided).
The session comes from the environment (spark-submit / cluster defaults); UTC is pinned.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trendspark import schemas as S
from trendspark.params import Params


def _session() -> SparkSession:
    from trendspark.session import CORE_CONF, ensure_checkpoint_dir

    spark = SparkSession.builder.appName("trendspark").getOrCreate()
    for k, v in CORE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def _current(spark, tables):
    from trendspark.operators.state import UPDATES, current_trends
    from trendspark.streaming.batches import read_or_empty

    return current_trends(read_or_empty(spark, f"{tables}/trends", S.TRENDS), read_or_empty(spark, f"{tables}/trend_updates", UPDATES))


def _params(a) -> Params:
    as_of = dt.datetime.fromisoformat(a.as_of) if getattr(a, "as_of", None) else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return Params(
        min_traffic=getattr(a, "min_traffic", None), max_trends=getattr(a, "max_trends", None),
        filtered_tlds=getattr(a, "filtered_tlds", "") or "", tag_vocabulary=getattr(a, "tag_vocabulary", "") or "",
        tag_field=getattr(a, "tag_field", "") or "", assign_random_author=bool(getattr(a, "random_author", False)),
        prompt_template=open(a.template, encoding="utf-8").read() if getattr(a, "template", None) else None, as_of=as_of,
    )


def cmd_fetch(spark, a):
    from trendspark.streaming.jobs import start_feed_stream

    ckpt = a.checkpoint or f"{a.tables}/_checkpoints/feed"
    from trendspark.streaming.batches import read_or_empty

    q = start_feed_stream(spark, a.feeds, a.tables, _params(a), checkpoint=ckpt)
    if q is not None:
        q.awaitTermination()
    print(json.dumps({"trends": read_or_empty(spark, f"{a.tables}/trends", S.TRENDS).count()}))


def cmd_prompts(spark, a):
    from trendspark.operators import prompts as PR
    from trendspark.operators.state import trend_updates

    p = _params(a)
    trends = _current(spark, a.tables).checkpoint(eager=True)
    news = spark.read.parquet(f"{a.tables}/news")
    pages, vocab = spark.read.parquet(a.pages), spark.read.parquet(a.vocab)
    mine = PR.news_of_pending(news, PR.pending_trends(trends))
    pieces = PR.page_pieces(mine, pages)  # pages are read and cleaned once for the three outputs
    PR.build_prompts(trends, news, pages, vocab, p, pieces).write.mode("overwrite").parquet(f"{a.tables}/prompts")
    done = PR.no_article(trends, news, PR.trend_text(mine, pieces, with_text=False), p).select(
        "id", F.lit(None).cast("bigint").alias("node_id"), F.lit(None).cast("decimal(10,6)").alias("processing_cost"))
    trend_updates(done, p.as_of_epoch).write.mode("append").parquet(f"{a.tables}/trend_updates")
    PR.scrape_audit(mine, pages, pieces).write.mode("append").parquet(f"{a.tables}/audit")
    print(json.dumps({"prompts": spark.read.parquet(f"{a.tables}/prompts").count()}))


def cmd_publish(spark, a):
    from trendspark.streaming.jobs import start_publish_stream

    ckpt = a.checkpoint or f"{a.tables}/_checkpoints/publish"
    media = None
    if a.pages:
        from trendspark.sources.images import landed_files

        media = {"pages": spark.read.parquet(a.pages), "image_meta": spark.read.parquet(a.image_meta), "url_status": spark.read.parquet(a.probes)}
        if a.images:
            media["landed"] = landed_files(spark, a.images)
    start_publish_stream(spark, a.answers, a.tables, spark.read.parquet(a.vocab), spark.read.parquet(a.users), _params(a),
                         checkpoint=ckpt, media=media, raw=a.raw).awaitTermination()
    print(json.dumps({"articles": spark.read.parquet(f"{a.tables}/articles").count()}))


def _translation_params(a) -> Params:
    return Params(translation_enabled=True, translation_languages=tuple(a.codes.split(",")))


def cmd_requests(spark, a):
    from trendspark.streaming.jobs import pending_translations

    for r in pending_translations(spark, a.tables, spark.read.parquet(a.languages), _translation_params(a)) \
            .select("node_id", "langcode", "prompt").toLocalIterator():
        print(json.dumps(r.asDict(), ensure_ascii=False))


def cmd_translate(spark, a):
    from trendspark.streaming.batches import read_or_empty
    from trendspark.streaming.jobs import TRANSLATIONS_OUT, start_translation_stream

    ckpt = a.checkpoint or f"{a.tables}/_checkpoints/translate"
    start_translation_stream(spark, a.answers, a.tables, spark.read.parquet(a.languages), _translation_params(a), checkpoint=ckpt).awaitTermination()
    print(json.dumps({"translations": read_or_empty(spark, f"{a.tables}/translations", TRANSLATIONS_OUT).count()}))


def cmd_news(spark, a):
    from trendspark.operators import reports as R
    from trendspark.streaming.batches import read_or_empty
    from trendspark.streaming.jobs import NEWS_OUT

    rows = R.news_rows(read_or_empty(spark, f"{a.tables}/news", NEWS_OUT), _current(spark, a.tables),
                       [R.argument("trend_id", a.trend)] if a.trend is not None else [])
    for r in R.news_page(rows, a.page).collect():
        print(json.dumps(r.asDict(), default=str))


def cmd_clear(spark, a):
    from trendspark.streaming.jobs import clear_tables

    if not a.yes:
        raise SystemExit("clearing can't be undone: pass --yes")
    print(json.dumps({"cleared": clear_tables(spark, a.tables)}))


def cmd_dashboard(spark, a):
    from trendspark.operators import reports as R

    t = _current(spark, a.tables)
    k = R.kpis(t, _params(a)).first().asDict()
    out = {key: (str(v) if not isinstance(v, (int, float)) else v) for key, v in k.items()}
    out["recent"] = [r.asDict() for r in R.recent_trends(t).select("id", "title", "traffic", "processed").collect()]
    out["top_traffic"] = [r.asDict() for r in R.top_traffic(t).select("id", "title", "traffic").collect()]
    print(json.dumps(out, default=str))


def cmd_listing(spark, a):
    from trendspark.operators import reports as R
    from trendspark.streaming.batches import read_or_empty
    from trendspark.streaming.jobs import ARTICLES_OUT

    arts = read_or_empty(spark, f"{a.tables}/articles", ARTICLES_OUT)
    page = R.listing(_current(spark, a.tables), arts, sort=a.sort, order=a.order, page=a.page)
    for r in page.collect():
        print(json.dumps(r.asDict(), default=str))


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="trendspark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    f = sub.add_parser("fetch")
    f.add_argument("--feeds", required=True)
    f.add_argument("--min-traffic", type=int)
    f.add_argument("--max-trends", type=int)
    f.add_argument("--filtered-tlds", default="")
    f.add_argument("--checkpoint")
    pr = sub.add_parser("prompts")
    pr.add_argument("--pages", required=True)
    pr.add_argument("--vocab", required=True)
    pr.add_argument("--tag-vocabulary", default="")
    pr.add_argument("--template")
    pu = sub.add_parser("publish")
    pu.add_argument("--answers", required=True)
    pu.add_argument("--vocab", required=True)
    pu.add_argument("--users", required=True)
    pu.add_argument("--tag-vocabulary", default="")
    pu.add_argument("--tag-field", default="")
    pu.add_argument("--random-author", action="store_true")
    pu.add_argument("--checkpoint")
    pu.add_argument("--raw", action="store_true")
    for x in ("--pages", "--image-meta", "--probes", "--images"):
        pu.add_argument(x)
    for name in ("requests", "translate"):
        tr = sub.add_parser(name)
        tr.add_argument("--languages", required=True)
        tr.add_argument("--codes", required=True)
    tr.add_argument("--answers", required=True)
    tr.add_argument("--checkpoint")
    ne = sub.add_parser("news")
    ne.add_argument("--page", type=int, default=0)
    ne.add_argument("--trend", type=int)
    sub.add_parser("clear").add_argument("--yes", action="store_true")
    sub.add_parser("dashboard")
    li = sub.add_parser("listing")
    li.add_argument("--page", type=int, default=0)
    li.add_argument("--sort", default="imported_at")
    li.add_argument("--order")
    for p in sub.choices.values():
        p.add_argument("--tables", required=True)
        p.add_argument("--as-of")
    a = ap.parse_args(argv)
    spark = _session()
    {"fetch": cmd_fetch, "prompts": cmd_prompts, "publish": cmd_publish, "requests": cmd_requests, "translate": cmd_translate,
     "dashboard": cmd_dashboard, "listing": cmd_listing, "news": cmd_news, "clear": cmd_clear}[a.cmd](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
