"""O-P2 build_prompts: pending trends + news + pages + vocabulary -> one prompt per trend.

The reference loops per trend and per news URL, fetching each page twice. Here a
page is cleaned once per distinct URL (pieces by URL), joined to the news rows,
and the pieces of a trend are concatenated in child order by one grouped
aggregate. Only pages that pending news need are read (``operators/pages.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.functions import fill_template
from trendspark.functions.text import let, php_trim
from trendspark.operators.common import global_index, kept
from trendspark.operators.pages import needed_pages, page_facts
from trendspark.params import NO_TAGS_TEXT, TEXT_PIECE_SEPARATOR, Params
from trendspark.session import ensure_checkpoint_dir

# Default prompt template (a job parameter; any template with three %s slots works). The
# separator lines in it are the fixed values the answer parser relies on.
DEFAULT_PROMPT = resources.files("trendspark.resources").joinpath("default_prompt.txt").read_text(encoding="utf-8")


#: Children up to which a trend's text is put together in one step, and ranges of positions beyond that.
CHUNK_ROWS, CHUNKS = 1_000, 256
#: Bytes of cleaned pages (with their URLs) up to which they are handed to every task as one array.
BOOK_BYTES = 32 << 20
#: Bytes of cleaned pages up to which a task holds them all, compressed, and bytes of texts that it hands on at a time.
SHELF_BYTES, BATCH_BYTES = 640 << 20, 8 << 20
#: A shelf is sent to no more tasks than make texts of so many times its size each.
SHELF_USES = 2


def pending_trends(trends: DataFrame) -> DataFrame:
    """O-SRC5: trends still to process (processed = 0)."""
    return trends.filter(F.col("processed") == 0)


def news_of_pending(news: DataFrame, pending: DataFrame) -> DataFrame:
    """O-SRC5 / O-J1: children of the pending trends (semi-join instead of a per-id lookup)."""
    return news.join(pending.select(F.col("id").alias("trend_id")), "trend_id", "left_semi")


def page_pieces(news: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, piece): each distinct page that ``news`` needs, cleaned once (O-X6..X8, O-F10) and kept: prompts, finished
    trends and the audit read it, and the join below is planned by its size."""
    return kept(page_facts(needed_pages(news, pages)).select("url", "piece"))


def page_source(news: DataFrame, pages: DataFrame) -> DataFrame:
    """O-SRC6 / O-J7: news rows with their page HTML; a missing page yields ''."""
    return news.join(needed_pages(news, pages), "url", "left").withColumn("html", F.coalesce(F.col("html"), F.lit("")))


def news_pieces(news: DataFrame, pieces: DataFrame) -> DataFrame:
    """News rows with the cleaned text of their page ('' when missing or empty)."""
    return news.join(pieces, "url", "left").withColumn("piece", F.coalesce(F.col("piece"), F.lit("")))


def scrape_audit(news: DataFrame, pages: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """O-SNK10 (prompt part): news URLs with no landed page (the fetch failed) or
    whose page gave no text."""
    p = (page_pieces(news, pages) if pieces is None else pieces).withColumn("_has_page", F.lit(True))
    j = news.join(p, "url", "left")
    reason = F.when(F.col("_has_page").isNull(), F.lit("scrape_failed")).when(F.col("piece") == "", F.lit("no_content"))
    return j.select(
        F.lit("prompts").alias("stage"),
        F.concat_ws(":", F.col("trend_id").cast("string"), F.col("news_pos").cast("string")).alias("key"),
        reason.alias("reason"), F.col("url").alias("detail"),
    ).filter(F.col("reason").isNotNull())


def _joined(pieces: DataFrame, by: list[str], order: str, text: Column) -> DataFrame:
    """Strings of a group in order, as one; ``has_text`` if one of them has any."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text.alias("p"))))
    return pieces.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("text"), F.max("has_text").alias("has_text"))


def _has_text(piece: Column) -> Column:
    return F.when(php_trim(piece) != "", F.lit(1)).otherwise(F.lit(0))


def _separated(pieces: DataFrame, by: list[str]) -> DataFrame:
    p = pieces.withColumn("has_text", _has_text(F.col("piece")))
    return _joined(p, by, "news_pos", F.concat("piece", F.lit(TEXT_PIECE_SEPARATOR)))


def _bytes(pieces: DataFrame) -> int:
    return pieces.agg(F.sum(F.coalesce(F.octet_length("piece"), F.lit(0)) + F.octet_length("url") + 64).alias("n")).first()["n"] or 0


def _book(pieces: DataFrame) -> tuple[Column, Column, DataFrame]:
    """The distinct texts of ``pieces``, each with its separator, in order: as an array, the place of the empty one in it, and
    (url, at, has_text), the place of each URL's text."""
    empty = pieces.sparkSession.range(1).select(F.lit(None).cast("string").alias("url"), F.lit("").alias("piece"))
    p = pieces.select("url", F.coalesce("piece", F.lit("")).alias("piece")).unionByName(empty)
    p = p.groupBy("piece").agg(F.collect_list("url").alias("urls")).select(
        F.concat("piece", F.lit(TEXT_PIECE_SEPARATOR)).alias("p"), _has_text(F.col("piece")).alias("has_text"), "urls")
    book = p.agg(F.sort_array(F.collect_list(F.struct("p", "has_text", "urls"))).alias("b")).checkpoint(eager=True)
    texts = book.select(F.transform("b", lambda x: x["p"]))
    nothing = book.select((F.array_position(F.transform("b", lambda x: x["p"]), TEXT_PIECE_SEPARATOR) - 1).cast("int"))
    at = book.select(F.posexplode("b").alias("at", "x")).select(F.explode("x.urls").alias("url"), "at", F.col("x.has_text").alias("has_text"))
    return texts.scalar(), nothing.scalar(), F.broadcast(at)


def trend_text(news: DataFrame, pieces: DataFrame, chunk_rows: int = CHUNK_ROWS, titles: DataFrame | None = None,
               with_text_only: bool = False, book_bytes: int = BOOK_BYTES, shelf_bytes: int = SHELF_BYTES, with_text: bool = True) -> DataFrame:
    """O-A10: (trend_id, text, has_text): pieces concatenated in child order, the separator after every piece, plus a flag
    telling whether any piece had text (O-F9 intent). ``titles`` (trend_id, ...) are joined to the trends, and
    ``with_text_only`` leaves out trends without text, both before a text is put together. Without ``with_text`` only the flags
    are found.

    Trends list the same pages again and again, so texts are many times the pages. Where the distinct cleaned pages are small
    (``book_bytes``), every task has them as one array, trends are grouped with the places of their pages in it, and a text is
    put together by a last projection: it is neither shuffled nor sorted nor spilled, and no task holds more than one.
    Up to ``shelf_bytes``, trends are grouped in the same way and dealt to tasks that are sent all pages each (:func:`_shelved_text`).
    Larger pages, and pages that the texts don't repeat, are joined to the news rows (:func:`_dealt_text`). All ways give the same text."""
    ensure_checkpoint_dir(news.sparkSession)
    if not with_text:
        told = pieces.select("url", _has_text(F.coalesce("piece", F.lit(""))).alias("has_text"))
        told = news.join(told, "url", "left").groupBy("trend_id").agg(F.max(F.coalesce("has_text", F.lit(0))).alias("has_text"))
        return _told(told, titles, with_text_only)
    size = _bytes(pieces)
    if book_bytes < size <= shelf_bytes:
        out = _shelved_text(news, pieces, size, titles, with_text_only)
        if out is not None:
            return out
    if size > book_bytes:
        out = _dealt_text(news, pieces, chunk_rows)
    else:
        texts, nothing, at = _book(pieces)
        rows = news.select("trend_id", "news_pos", "url").join(at, "url", "left")
        out = rows.groupBy("trend_id").agg(F.collect_list(F.struct("news_pos", F.coalesce("at", nothing).alias("at"))).alias("_at"),
                                           F.max(F.coalesce("has_text", F.lit(0))).alias("has_text"))
    out = _told(out, titles, with_text_only)
    if size <= book_bytes:
        # a function of arrays takes a subquery as a column only; both projections become one, so no row holds the array
        text = let(F.col("_texts"), lambda b: F.array_join(F.transform(F.array_sort("_at"), lambda x: F.get(b, x["at"])), ""))
        out = out.withColumn("_texts", texts).withColumn("text", text).drop("_at", "_texts")
    return _text_first(out)


def _told(trends: DataFrame, titles: DataFrame | None, with_text_only: bool) -> DataFrame:
    out = trends.filter(F.col("has_text") == 1) if with_text_only else trends
    return out if titles is None else out.join(titles, "trend_id")


def _text_first(trends: DataFrame) -> DataFrame:
    return trends.select("trend_id", "text", "has_text", *[c for c in trends.columns if c not in ("trend_id", "text", "has_text")])


def _shelved_text(news: DataFrame, pieces: DataFrame, size: int, titles: DataFrame | None, with_text_only: bool) -> DataFrame | None:
    """:func:`trend_text` with each task holding all pages: they are numbered in the order of their texts, trends are grouped with the
    numbers of their pages and dealt to as many tasks as run at once, and every task is sent the pages beside its trends. Texts are
    written from there and not shuffled, sorted or spilled. None if the texts aren't worth the copies."""
    empty = news.sparkSession.range(1).select(F.lit(None).cast("string").alias("url"), F.lit("").alias("piece"))
    p = pieces.select("url", F.coalesce("piece", F.lit("")).alias("piece")).unionByName(empty)
    p = p.select("url", F.concat("piece", F.lit(TEXT_PIECE_SEPARATOR)).alias("_p"), _has_text(F.col("piece")).alias("has_text"))
    p = global_index(p, ["_p"], "_no", wide=True).withColumn("_no", F.col("_no").cast("int"))
    nothing = p.filter(F.col("_p") == TEXT_PIECE_SEPARATOR).agg(F.min("_no")).first()[0]
    at = p.select("url", "_no", F.octet_length("_p").alias("_n"), "has_text")
    if (at.agg(F.sum(F.octet_length("url") + 64).alias("n")).first()["n"] or 0) <= BOOK_BYTES:
        at = F.broadcast(at)
    rows = news.select("trend_id", "news_pos", "url").join(at, "url", "left")
    trends = rows.groupBy("trend_id").agg(
        F.collect_list(F.struct("news_pos", F.coalesce("_no", F.lit(nothing)).alias("no"))).alias("_at"), F.sum("_n").alias("_n"),
        F.max(F.coalesce("has_text", F.lit(0))).alias("has_text")).withColumn("_at", F.transform(F.array_sort("_at"), lambda x: x["no"]))
    trends = kept(_told(trends, titles, with_text_only))
    uses = (trends.agg(F.sum("_n").alias("n")).first()["n"] or 0) // (SHELF_USES * max(size, 1))
    tasks = min(news.sparkSession.sparkContext.defaultParallelism, uses)
    if tasks < 2:
        return None
    trends = trends.drop("_n").withColumn("_task", F.pmod(F.xxhash64("trend_id"), F.lit(tasks)).cast("int"))
    pages = p.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"), "_no", "_p")
    both = trends.unionByName(pages, allowMissingColumns=True).repartitionById(tasks, "_task").drop("_task")
    fields = [f for f in trends.schema.fields if f.name not in ("_at", "_task")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])
    return _text_first(both.mapInArrow(_write_texts([f.name for f in fields]), schema))


def _write_texts(columns: list[str]):
    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = pa.Codec("lz4_raw")
        shelf, sizes, trends = {}, {}, []
        for b in batches:
            no = b.column("_no")
            if b.num_rows > no.null_count:
                mine = b.filter(no.is_valid())
                for n, x in zip(mine.column("_no").to_pylist(), mine.column("_p")):
                    x = x.as_buffer()
                    shelf[n], sizes[n] = codec.compress(x, asbytes=True), x.size
            if no.null_count:
                trends.append(b.filter(no.is_null()).select([*columns, "_at"]))
        size = np.zeros(max(sizes, default=0) + 1, np.int64)
        size[list(sizes)] = list(sizes.values())
        del sizes
        trends.reverse()
        while trends:
            b = trends.pop()
            at = b.column("_at")
            no = at.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(size[no])])
            places, of = ends[first], size[no].tolist()
            no, i = no.tolist(), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(places, places[i] + BATCH_BYTES, "right")) - 1)
                j = min(j, b.num_rows)
                a, z = first[i], first[j]
                data = b"".join([codec.decompress(shelf[n], m, asbytes=True) for n, m in zip(no[a:z], of[a:z])])
                at_text = pa.py_buffer((places[i:j + 1] - places[i]).astype(np.int32).tobytes())
                text = pa.StringArray.from_buffers(j - i, at_text, pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).select(columns).columns, text], [*columns, "text"])
                i = j

    return write


def _dealt_text(news: DataFrame, pieces: DataFrame, chunk_rows: int) -> DataFrame:
    """(trend_id, text, has_text) by a join of the pieces to the news rows.

    News rows are dealt by trend before the join: where the pieces are broadcast (AQE, by their size) the join keeps that
    partitioning and the texts aren't shuffled again. Trends with more than ``chunk_rows`` children are taken apart: their
    rows are dealt by ranges of positions (quantiles of each such trend), every range becomes one string in a
    task of its own, and the strings of the ranges are put together in order."""
    hot = news.groupBy("trend_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk_rows).select("trend_id").checkpoint(eager=True)
    if not hot.limit(1).count():
        return _separated(news_pieces(news.repartition("trend_id"), pieces), ["trend_id"])
    few = news.join(hot, "trend_id", "left_anti").repartition("trend_id")
    many = news.join(hot, "trend_id", "left_semi")
    at = [i / CHUNKS for i in range(1, CHUNKS)]
    bounds = many.groupBy("trend_id").agg(F.percentile_approx("news_pos", at).alias("_at"))
    many = many.join(bounds, "trend_id").withColumn("_chunk", F.size(F.filter("_at", lambda b: b < F.col("news_pos")))).drop("_at")
    parts = _separated(news_pieces(many, pieces), ["trend_id", "_chunk"])
    return _separated(news_pieces(few, pieces), ["trend_id"]).unionByName(_joined(parts, ["trend_id"], "_chunk", F.col("text")))


def tags_prompt_list(vocab: DataFrame, params: Params):
    """O-A11 (scalar): all term names of the configured vocabulary joined by ', ' in
    tree order (name, then id); 'No tags available' when there are none."""
    if not params.tag_vocabulary:
        return F.lit(NO_TAGS_TEXT)
    names = vocab.filter(F.col("vid") == params.tag_vocabulary).agg(
        F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY name, tid)").alias("names")
    )
    return F.coalesce(names.scalar(), F.lit(NO_TAGS_TEXT))


def vocab_scan(vocab: DataFrame, params: Params) -> DataFrame:
    """O-SRC8: terms of the configured vocabulary; empty when none is configured."""
    if not params.tag_vocabulary:
        return vocab.limit(0)
    return vocab.filter(F.col("vid") == params.tag_vocabulary)


def no_article(trends: DataFrame, news: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """O-F9 / O-SNK5: pending trends finished without an article, with the reason.
    ``literal_quirks`` keeps the reference's behaviour where the text check can
    never fire (the separator is always appended)."""
    pend = pending_trends(trends).select("id")
    no_news = pend.join(news.select(F.col("trend_id").alias("id")), "id", "left_anti").withColumn("reason", F.lit("no_news"))
    if params.literal_quirks:
        return no_news
    no_text = texts.filter(F.col("has_text") == 0).select(F.col("trend_id").alias("id")).withColumn("reason", F.lit("no_text"))
    return no_news.unionByName(no_text)


def build_prompts(trends: DataFrame, news: DataFrame, pages: DataFrame, vocab: DataFrame, params: Params,
                  pieces: DataFrame | None = None) -> DataFrame:
    """O-P2 composite: (trend_id, title, text, tags_list, prompt) per pending trend
    that has news and (unless literal_quirks) some scraped text. ``pieces``: the cleaned
    pages where they are at hand."""
    pend = pending_trends(trends)
    if not params.import_enabled:  # O-F16 gate
        pend = pend.limit(0)
    mine = news_of_pending(news, pend)
    out = trend_text(mine, page_pieces(mine, pages) if pieces is None else pieces, with_text_only=not params.literal_quirks,
                     titles=pend.select(F.col("id").alias("trend_id"), "title"))
    template = params.prompt_template or DEFAULT_PROMPT
    tags = tags_prompt_list(vocab, params)
    return out.select(
        "trend_id", "title", "text", tags.alias("tags_list"),
        fill_template(template, F.col("title"), F.col("text"), tags).alias("prompt"),
    )
