"""O-P5 translate_fanout: articles x selected languages -> translation rows.

The language list is a job parameter, so the fan-out is an ``explode`` of a
literal array per article (no join at all); language names come from a
broadcast join with the (small, configuration-sized) language dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions import parse_translation, translation_prompt
from trendspark.params import Params


def non_default_languages(languages: DataFrame, params: Params) -> DataFrame:
    """O-F8: selected languages that are not the site default; blanks dropped."""
    sel = list(params.languages)
    return languages.filter((F.col("is_default") != 1) & F.col("langcode").isin(sel))


def translation_fanout(articles: DataFrame, languages: DataFrame, params: Params) -> DataFrame:
    """O-J8 + O-X13: one row per article and selected language, with its prompt.
    Unknown language codes use the code as the name."""
    if not params.translation_enabled or not params.languages:
        return articles.select("node_id", F.lit(None).cast("string").alias("langcode")).limit(0)
    codes = F.array(*[F.lit(c) for c in params.languages])
    fan = articles.select("node_id", "title", "body", F.explode(codes).alias("langcode"))
    names = languages.select("langcode", F.col("name").alias("language_name"))
    fan = fan.join(names, "langcode", "left")
    name = F.coalesce(F.col("language_name"), F.col("langcode"))
    return fan.select("node_id", "langcode", "title", "body", translation_prompt(name, F.col("title"), F.col("body")).alias("prompt"))


def missing_translation(fan: DataFrame, existing: DataFrame) -> DataFrame:
    """O-F11: drop (node, language) pairs that already have a translation."""
    return fan.join(existing.select("node_id", "langcode"), ["node_id", "langcode"], "left_anti")


def write_translations(fan: DataFrame, answers: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """O-X12 + O-SNK7: parsed translation per answered pair (the others are asked again); an answer
    without a separator keeps the original title/body. Tags are copied from the article."""
    got = answers.filter(F.col("response").isNotNull()).select("node_id", "langcode", "response")
    j = fan.join(got, ["node_id", "langcode"])
    p = parse_translation(F.col("response"), F.col("title"), F.col("body"))
    out = j.select("node_id", "langcode", p["title"].alias("title"), p["body"].alias("body"))
    if tags is not None:
        out = out.join(tags.select("node_id", "tag_ids"), "node_id", "left")
    return out


def translate_articles(articles: DataFrame, languages: DataFrame, existing: DataFrame, answers: DataFrame,
                       params: Params) -> dict[str, DataFrame]:
    fan = missing_translation(translation_fanout(articles, languages, params), existing)
    return {"prompts": fan, "translations": write_translations(fan, answers, articles if "tag_ids" in articles.columns else None)}
