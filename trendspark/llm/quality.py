"""Quality rules (operator 3): a threshold table compiled into one Spark projection.

Everything is built-in Spark functions. The counts of a text are columns; a rule is a row
``(name, ratio, low, high)`` whose ratio is a SQL expression over those columns; ``compile_rules``
turns the table into one boolean expression and one array of the names of failed rules.

Null or empty text: no words, all counts 0, ``base_failed`` true. Repeated rows and ties are
judged alone. Extra input columns are not read, those named like an added or internal column are
replaced; an empty table gives an empty table.

The counts leave through a generator of one row for each text: a caller's filter on them then stays above
their projection, which Spark would otherwise copy into the filter once for each use of a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Function words (fixed values) of the languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as be at by this was are or an from not",
    "de": "der die das und zu den mit von für ist des im dem nicht ein eine auf als auch es sich in",
    "fr": "le la les de des du et un une en que qui est dans pour par sur au avec ce il elle pas",
    "es": "el la los las de del y un una en que es por con para no se su al lo como más",
}
#: The threshold table: name, ratio (SQL over the count columns), least and most allowed.
RULES = [
    ("word_length", "word_chars / n_words", 1.5, 15.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("letter_word_ratio", "n_letter_words / n_words", 0.7, None),
    ("shouting_ratio", "n_bangs / n_words", None, 0.5),
    ("neighbour_repeat_ratio", "n_neighbour_repeats / n_words", None, 0.4),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    ("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
    ("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.5),
]
ADDED = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_bangs",
         "n_neighbour_repeats", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "base_failed", "kept", "failed_rules",
         "_t", "_w", "_l", "_wh", "_h", "_s", "_p"}


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """(all rules hold, names of the rules that fail). A ratio over zero is null and holds."""
    fails = []
    for name, ratio, low, high in rules:
        top, _, bottom = ratio.partition(" / ")
        r = F.expr(f"{top} / nullif({bottom}, 0)")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (r < low)
        if high is not None:
            bad = bad | (r > high)
        fails.append((name, F.coalesce(bad, F.lit(False))))
    ok = ~fails[0][1]
    for _, f in fails[1:]:
        ok = ok & ~f
    names = F.filter(F.array(*[F.when(f, F.lit(n)) for n, f in fails]), lambda x: x.isNotNull())
    return ok, names


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (with its columns but the text) plus the counts of the whole text."""
    keep = [c for c in docs.columns if c != text and c.lower() not in ADDED]
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, t.alias("_t"))
    d = d.select("*", F.filter(F.split("_t", "[ \\t-\\r]+", -1), lambda w: w != "").alias("_w"),
                 F.filter(F.split("_t", "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("_l"))
    d = d.select("*", F.size("_w").cast("long").alias("n_words"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"))
    idx = F.sequence(F.lit(0), F.size("_wh") - F.lit(WINDOW))
    win = F.transform(idx, lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + F.lit(k)) for k in range(WINDOW)]))
    d = d.withColumn("_h", F.when(F.size("_wh") >= WINDOW, win).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: only the others are sorted
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(some, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, j: ((j > 0) & (F.get(F.col("_s"), F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
                     | F.coalesce(F.get(F.col("_s"), j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW))))
    n_repeat = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return d.select(*keep, F.inline(F.array(F.struct(
        "n_words",
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_letter_words"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.size(F.filter("_wh", lambda x, i: (i > 0) & (F.get(F.col("_wh"), F.greatest(i - 1, F.lit(0))) == x)))
        .cast("long").alias("n_neighbour_repeats"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
    ))))


def quality(docs: DataFrame, text: str = "text", rules=RULES, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Counts, ``base_failed`` (too few words or too many repeated ones), ``kept`` and ``failed_rules``."""
    ok, names = compile_rules(rules)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    d = text_counts(docs, text).withColumn("base_failed", base)
    return d.withColumn("kept", ~F.col("base_failed") & ok).withColumn("failed_rules", names)
