"""O-P3 publish_articles: answers -> parsed articles with tags, cost, author, media.

The reference parses one answer, looks tags up one by one, prices the call and
saves a node. Here every step is a set operation over all answers of a run:
``posexplode`` + one join for tags, a broadcast join for prices, a join on a
dense user index for authors, and anti-joins for idempotence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendspark.functions import created_ts, embed_video, parse_response, slugify, token_cost
from trendspark.operators import media as M
from trendspark.operators.common import global_index
from trendspark.params import Params

# Fixed value: the multiplier of the deterministic author pick (Knuth's multiplicative hash).
AUTHOR_HASH = 2654435761


def latest_answer(calls: DataFrame) -> DataFrame:
    """One answer per trend: the last call (highest call_id), as a partial aggregate."""
    cols = [c for c in calls.columns if c not in ("trend_id",)]
    return calls.groupBy("trend_id").agg(F.max_by(F.struct(*cols), F.col("call_id")).alias("_a")).select("trend_id", "_a.*")


def normalize_answers(raw: DataFrame) -> DataFrame:
    """O-SRC7: landed provider JSON (column ``json``) in either layout -> one shape.

    chat layout: choices[0].message.content, usage.prompt_tokens|promptTokens,
    usage.completion_tokens|completionTokens; messages layout: content[0].text,
    usage.input_tokens|inputTokens, usage.output_tokens|outputTokens. The JSON is read as a variant, so
    further fields, counts written as text and missing parts do no harm. ``reject`` tells why an answer can't be
    used (``response`` NULL): ``malformed_answer`` for what is no JSON (a cut-off body, too), ``invalid_response`` for one
    without text."""
    answers = raw.withColumn("_v", F.try_parse_json("json"))
    chat = F.coalesce(F.col("provider") != "claude", F.lit(True))

    def field(kind: str, chat_paths: list[str], message_paths: list[str]) -> Column:
        get = [F.coalesce(*[F.try_variant_get("_v", f"$.{x}", kind) for x in paths]) for paths in (chat_paths, message_paths)]
        return F.when(chat, get[0]).otherwise(get[1])

    text = field("string", ["choices[0].message.content"], ["content[0].text"])
    out = answers.select(
        *[c for c in raw.columns if c != "json"], text.alias("response"),
        field("bigint", ["usage.prompt_tokens", "usage.promptTokens"], ["usage.input_tokens", "usage.inputTokens"]).alias("input_tokens"),
        field("bigint", ["usage.completion_tokens", "usage.completionTokens"], ["usage.output_tokens", "usage.outputTokens"]).alias("output_tokens"),
        F.col("_v").isNull().alias("_bad"))
    reject = F.when(F.col("_bad"), F.lit("malformed_answer")).when(F.col("response").isNull(), F.lit("invalid_response"))
    return out.withColumn("reject", reject).drop("_bad")


def failed_attempts(calls: DataFrame, earlier: DataFrame) -> DataFrame:
    """(trend_id, call_id, attempt, reason) of the answers of this run that can't be used; ``attempt`` counts on from the
    ``earlier`` ones of the trend. Their trends stay pending, to be asked again."""
    reason = F.coalesce(F.col("reject"), F.lit("invalid_response")) if "reject" in calls.columns else F.lit("invalid_response")
    bad = calls.filter(F.col("response").isNull()).select("trend_id", "call_id", reason.alias("reason"))
    before = earlier.groupBy("trend_id").agg(F.max("attempt").alias("_n"))
    # answers of one trend in one run: a handful, one for each time it was asked
    nth = F.row_number().over(Window.partitionBy("trend_id").orderBy("call_id"))
    return bad.join(before, "trend_id", "left").select(
        "trend_id", "call_id", (F.coalesce("_n", F.lit(0)) + nth).cast("bigint").alias("attempt"), "reason")


def parsed(answers: DataFrame) -> DataFrame:
    """O-X10/X11 on every answer: title, body, tags (fallback title = trend title)."""
    p = parse_response(F.col("response"), F.col("trend_title"))
    return answers.withColumn("_p", p).select(
        *answers.columns, F.col("_p.title").alias("gen_title"), F.col("_p.body").alias("gen_body"), F.col("_p.tags").alias("tags"),
        (F.instr(F.col("response"), "---TITLE_SEPARATOR---") == 0).alias("no_separator"),
    )


def first_terms(vocab: DataFrame, params: Params) -> DataFrame:
    """O-W1: the first term (lowest id) of each name in the configured vocabulary."""
    return vocab.filter(F.col("vid") == (params.tag_vocabulary or "")).groupBy("name").agg(F.min("tid").alias("tid"))


def tag_rows(parsed_answers: DataFrame, key: str = "call_id") -> DataFrame:
    """Answer tags as rows (key, tag_pos, tag), order kept, repeats kept."""
    return parsed_answers.select(key, F.posexplode("tags").alias("tag_pos", "tag"))


def tags_to_terms(parsed_answers: DataFrame, vocab: DataFrame, params: Params, key: str = "call_id") -> DataFrame:
    """O-J4: (key, tag_ids ARRAY<BIGINT>) — existing terms only, the answer's order,
    repeats kept, nothing created. Empty array when tags are not configured."""
    if not params.tag_field or not params.tag_vocabulary:
        return parsed_answers.select(key, F.array().cast("array<bigint>").alias("tag_ids"))
    hits = tag_rows(parsed_answers, key).join(first_terms(vocab, params), F.col("tag") == F.col("name"))
    ids = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tag_pos", "tid"))).alias("_t"))
    ids = ids.select(key, F.transform("_t", lambda x: x["tid"]).alias("tag_ids"))
    return parsed_answers.select(key).join(ids, key, "left").select(
        key, F.coalesce(F.col("tag_ids"), F.array().cast("array<bigint>")).alias("tag_ids")
    )


def unmatched_tags(parsed_answers: DataFrame, vocab: DataFrame, params: Params, key: str = "call_id") -> DataFrame:
    """O-J5: tags with no term (logged, skipped); none if tags are not configured."""
    if not params.tag_field or not params.tag_vocabulary:
        return tag_rows(parsed_answers, key).limit(0)
    terms = first_terms(vocab, params).select(F.col("name").alias("tag"))
    return tag_rows(parsed_answers, key).join(terms, "tag", "left_anti")


def priced(answers: DataFrame, prices: DataFrame) -> DataFrame:
    """O-J6 + O-X14: cost of each call; unknown (provider, model) or missing usage -> 0."""
    p = prices.select("provider", "model", "input_per_m", "output_per_m")
    j = answers.join(p, ["provider", "model"], "left")
    return j.withColumn("cost", token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_m"), F.col("output_per_m"))) \
        .withColumn("unknown_model", F.col("input_per_m").isNull())


def eligible_users(users: DataFrame) -> DataFrame:
    """O-F7: uid not in (0, 1) and active."""
    return users.filter(~F.col("uid").isin(0, 1) & (F.col("status") == 1)).select("uid")


def author_assign(items: DataFrame, users: DataFrame, params: Params, key: str = "trend_id") -> DataFrame:
    """O-J12: a deterministic 'random' eligible author per item; uid 1 when the option
    is off or nobody is eligible. Users get a dense index 0..n-1 by uid (distributed),
    items pick index ((key + seed) mod n) * (K mod n) mod n."""
    if not params.assign_random_author:
        return items.withColumn("uid", F.lit(1).cast("bigint"))
    idx = global_index(eligible_users(users), ["uid"], "idx")
    n = F.greatest(idx.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    pick = F.pmod(F.pmod(F.col(key) + F.lit(params.author_seed), n) * F.pmod(F.lit(AUTHOR_HASH), n), n)
    u = idx.select(F.col("idx").alias("_pick"), F.col("uid").alias("_uid"))
    return items.withColumn("_pick", pick).join(u, "_pick", "left").withColumn(
        "uid", F.coalesce(F.col("_uid"), F.lit(1)).cast("bigint")
    ).drop("_pick", "_uid")


def assign_node_ids(articles: DataFrame, trends: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Node ids: highest stored node id (of trends and ``existing`` articles) + trend id. Unique (trend ids are), stable
    across retries of the same run (the article key is the trend), and free of
    any global sort or single-partition numbering."""
    stored = trends.select("node_id") if existing is None else trends.select("node_id").union(existing.select("node_id"))
    base = F.coalesce(stored.agg(F.max("node_id")).scalar(), F.lit(0)).cast("bigint")
    return articles.withColumn("node_id", (base + F.col("trend_id")).cast("bigint"))


def new_only(answers: DataFrame, articles: DataFrame | None) -> DataFrame:
    """O-T4: skip trends that already have an article (retry-safe publishing)."""
    return answers if articles is None else answers.join(articles.select("trend_id"), "trend_id", "left_anti")


def article_media(parsed_answers: DataFrame, trends: DataFrame, media: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """O-P4 and O-SNK8 for the trends that get an article: (trend_id, video_url) and the manifest of their files, named
    after the generated titles. ``media``: news, pages, image_meta, url_status, and landed where the bytes of images have landed."""
    todo = trends.join(parsed_answers.select(F.col("trend_id").alias("id")), "id", "left_semi")
    news = media["news"].join(todo.select(F.col("id").alias("trend_id")), "trend_id", "left_semi")
    got = M.extract_media(news, media["pages"], media["image_meta"], media["url_status"], todo, media.get("landed"), materialize=True)
    titles = parsed_answers.select("trend_id", F.col("gen_title").alias("title"), slugify(F.col("gen_title")).alias("slug"))
    return got["videos"].select("trend_id", "video_url"), M.media_manifest(got["files"], titles)


def article_images(manifest: DataFrame) -> DataFrame:
    """(trend_id, images): file names and alt texts in order, the video's thumbnail first; at most eleven a trend."""
    files = F.sort_array(F.collect_list(F.struct("ord", "filename", "alt")))
    return manifest.groupBy("trend_id").agg(F.transform(files, lambda f: F.struct(f["filename"].alias("filename"), f["alt"].alias("alt"))).alias("images"))


NO_IMAGES = "array<struct<filename:string,alt:string>>"


def article_rows(parsed_answers: DataFrame, trends: DataFrame, tag_ids: DataFrame, authors: DataFrame,
                 videos: DataFrame | None, params: Params, images: DataFrame | None = None) -> DataFrame:
    """O-SNK6: one published article per trend (without node ids)."""
    t = trends.select(F.col("id").alias("trend_id"), "pub_date")
    a = parsed_answers.join(t, "trend_id").join(tag_ids, "call_id", "left").join(authors.select("trend_id", "uid"), "trend_id", "left")
    body = F.col("gen_body")
    if videos is not None:
        a = a.join(videos.select("trend_id", "video_url"), "trend_id", "left")
        body = embed_video(body, F.col("video_url"))
    a = a.withColumn("images", F.lit(None).cast(NO_IMAGES)) if images is None else a.join(images, "trend_id", "left")
    return a.select(
        "trend_id",
        F.lit(params.content_type_effective).alias("type"),
        F.col("gen_title").alias("title"),
        F.lit(1).alias("status"),
        F.coalesce(F.col("uid"), F.lit(1)).cast("bigint").alias("uid"),
        body.alias("body"),
        created_ts(F.col("pub_date"), params.as_of_epoch).alias("created"),
        F.coalesce(F.col("tag_ids"), F.array().cast("array<bigint>")).alias("tag_ids"),
        F.coalesce(F.col("images"), F.array().cast(NO_IMAGES)).alias("images"),
        F.lit(params.domain_id or None).cast("string").alias("domain_access"),
        F.lit(None if params.skip_domain_source or not params.domain_id else params.domain_id).cast("string").alias("domain_source"),
        "cost",
    )


def finish_trends(trends: DataFrame, done: DataFrame) -> DataFrame:
    """O-SNK4 / O-SNK5: new snapshot of the trends table. ``done`` = (id, node_id,
    processing_cost) for finished ids; node/cost NULL for finished-without-article."""
    d = done.select("id", F.col("node_id").alias("_node"), F.col("processing_cost").alias("_cost"), F.lit(1).alias("_done"))
    j = trends.join(d, "id", "left")
    return j.select(
        "id", "title", "traffic", "pub_date", "link", "snippet", "image_url",
        F.when(F.col("_done") == 1, F.lit(1)).otherwise(F.col("processed")).alias("processed"),
        F.when(F.col("_done") == 1, F.col("_node")).otherwise(F.col("node_id")).alias("node_id"),
        "imported_at",
        F.when(F.col("_done") == 1, F.col("_cost").cast("decimal(10,6)")).otherwise(F.col("processing_cost")).alias("processing_cost"),
    )


def audit_publish(p: DataFrame, unmatched: DataFrame) -> DataFrame:
    """O-SNK10 (publish part): unknown model, missing separator, skipped tag."""
    a = p.filter(F.col("unknown_model")).select(F.lit("publish").alias("stage"), F.col("call_id").cast("string").alias("key"),
                                               F.lit("unknown_model").alias("reason"), F.col("model").alias("detail"))
    b = p.filter(F.col("no_separator")).select(F.lit("publish").alias("stage"), F.col("call_id").cast("string").alias("key"),
                                              F.lit("separator_missing").alias("reason"), F.lit(None).cast("string").alias("detail"))
    c = unmatched.select(F.lit("publish").alias("stage"), F.col("call_id").cast("string").alias("key"),
                         F.lit("tag_skipped").alias("reason"), F.col("tag").alias("detail"))
    return a.unionByName(b).unionByName(c)


def publish_articles(calls: DataFrame, trends: DataFrame, vocab: DataFrame, users: DataFrame, prices: DataFrame,
                     params: Params, media: dict[str, DataFrame] | None = None, existing: DataFrame | None = None,
                     materialize: bool = False) -> dict[str, DataFrame]:
    """O-P3 composite: latest answer per pending trend -> articles, their files, finished trends, audit.

    ``calls`` may be raw (column ``json``) or normalised; ``media`` are the inputs of :func:`article_media`, without which
    articles have neither video nor images. The priced answers feed four branches (tags, authors, media, article rows) with
    different columns, so Spark cannot share their shuffles; with ``materialize``
    they are computed once and checkpointed (spark.checkpoint.dir) first."""
    if "json" in calls.columns:
        calls = normalize_answers(calls)
    # an answer without text is an invalid one: it goes to the audit and its trend stays pending
    reason = F.coalesce(F.col("reject"), F.lit("invalid_response")) if "reject" in calls.columns else F.lit("invalid_response")
    rejects = calls.filter(F.col("response").isNull()).select(F.lit("publish").alias("stage"), F.col("call_id").cast("string").alias("key"),
                                                              reason.alias("reason"), F.lit(None).cast("string").alias("detail"))
    pend = trends.filter(F.col("processed") == 0)
    good = latest_answer(calls.filter(F.col("response").isNotNull()).drop("reject"))
    p = priced(parsed(new_only(good, existing)), prices)
    if materialize:
        p = p.checkpoint(eager=True)
    tags = tags_to_terms(p, vocab, params)
    authors = author_assign(p.select("trend_id"), users, params)
    videos = images = manifest = None
    if media is not None:
        videos, manifest = article_media(p, pend, media)
        if materialize:
            manifest = manifest.checkpoint(eager=True)
        images = article_images(manifest)
    arts = assign_node_ids(article_rows(p, pend, tags, authors, videos, params, images), trends,
                           existing if existing is not None and "node_id" in existing.columns else None)
    if materialize:
        arts = arts.checkpoint(eager=True)
    done = arts.select(F.col("trend_id").alias("id"), "node_id", F.col("cost").alias("processing_cost"))
    return {
        "articles": arts,
        "files": manifest,
        "trends": finish_trends(trends, done),
        "audit": audit_publish(p, unmatched_tags(p, vocab, params)).unionByName(rejects),
    }
