"""Mixing sources to target weights (operator 7): hierarchical budgeting.

A tree domain > language > source. Each node has a weight among its siblings and a capacity, the
tokens below it times ``max_epochs``. Budgets go down from the root: the siblings of a node share it
by weight, and what a sibling can't use goes to its siblings, by weight again, before anything is
left to the next ancestor's level. A leaf repeats whole epochs, then takes the token-prefix of one
more epoch, whose order is a seeded hash of (epoch, document).

All steps are Spark SQL functions. The sharing is closed-form (siblings sorted by capacity to weight,
windows over the siblings only). The prefix is found by radix steps over the hash: token sums of 256
buckets for each leaf (partial sums first), then of the crossing bucket's 256 sub-buckets, and a
window over the documents of one sub-bucket, about 1/65536 of a leaf. The selection itself is a filter against one small
row for each leaf.

Tokens are words between ASCII white space unless ``tokens`` names a column. Null language or source
is the node ``unknown``; null or empty text has no tokens and goes with the epochs it falls into
(kept once its leaf has any budget). Rows with equal id and text fall together, and are kept together if
the first of them starts within the budget. Empty table: empty. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import small, table

#: Production parameters: domains as lists of sources, and target weights (1.0 where none is named).
DOMAINS = {"web": [f"src{i}" for i in range(0, 10)], "books": [f"src{i}" for i in range(10, 15)],
           "reference": [f"src{i}" for i in range(15, 20)]}
WEIGHTS = {"domain": {"web": 0.55, "books": 0.25, "reference": 0.15, "other": 0.05},
           "language": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "source": {}}


def _choose(pairs: dict, col: Column, default) -> Column:
    out = F.lit(default)
    for k, v in pairs.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Words between ASCII white space: places where a word starts."""
    t = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(t, " ", -1), lambda w: w != "")).cast("long")


def share(nodes: DataFrame, parent: list[str], weight: str, cap: str, budget: str) -> DataFrame:
    """Add ``alloc``: the parent's ``budget`` shared by weight, none above its capacity (water-filling)."""
    part = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = part.orderBy(F.col(cap) / F.col(weight), *[c for c in nodes.columns if c in ("domain", "language", "source")])
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = nodes.select("*", F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("_c"), F.sum(weight).over(after).alias("_w"))
    level = (F.col(budget) - F.col("_c")) / F.col("_w")
    d = d.withColumn("_full", F.col(cap) <= F.col(weight) * level)
    # the first sibling that isn't filled sets the level of all that aren't
    d = d.withColumn("_l", F.min(F.when(~F.col("_full"), F.struct("_c", level.alias("l")))).over(part)["l"])
    return d.withColumn("alloc", F.when(F.col("_full") | F.col("_l").isNull(), F.col(cap).cast("double"))
                        .otherwise(F.least(F.col(cap), F.greatest(F.lit(0.0), F.col(weight) * F.col("_l"))))).drop("_c", "_w", "_full", "_l")


def leaf_budgets(leaves: DataFrame, budget: float, weights=WEIGHTS) -> DataFrame:
    """Budgets of leaves ``(domain, language, source, cap)`` under a total ``budget`` in tokens."""
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _choose(weights["domain"], F.col("domain"), 1.0))
    top = share(top.withColumn("b", F.lit(float(budget))), [], "weight", "cap", "b").select("domain", F.col("alloc").alias("b"))
    mid = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(top, "domain")
    mid = share(mid.withColumn("weight", _choose(weights["language"], F.col("language"), 1.0)), ["domain"], "weight", "cap", "b")
    low = leaves.join(mid.select("domain", "language", F.col("alloc").alias("b")), ["domain", "language"])
    low = share(low.withColumn("weight", _choose(weights["source"], F.col("source"), 1.0)), ["domain", "language"], "weight", "cap", "b")
    return low.select("domain", "language", "source", "cap", F.floor(F.col("alloc") + 1e-6).alias("budget"))


def mix(docs: DataFrame, fraction: float = 0.8, max_epochs: int = 2, seed: int = 11, weights=WEIGHTS, domains=DOMAINS,
        tokens: str | None = None, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` plus ``mix_domain``, ``mix_tokens`` and ``mix_copies`` (epochs a row is used), rows with no copy left out.

    The total budget is ``fraction`` of all tokens.
    """
    docs = docs.drop("mix_domain", "mix_tokens", "mix_copies")
    n_tok = F.col(tokens).cast("long") if tokens else word_count(F.col(text))
    src, lng = F.coalesce(F.col(source).cast("string"), F.lit("unknown")), F.coalesce(F.col(lang).cast("string"), F.lit("unknown"))
    dom = F.lit("other")
    for name, members in domains.items():
        dom = F.when(src.isin(members), F.lit(name)).otherwise(dom)
    # the order inside the partial epoch; 48 bits in 6 bytes, ties by the whole hash
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text))
    rows = docs.select("*", dom.alias("_m_dom"), lng.alias("_m_lang"), src.alias("_m_src"), n_tok.alias("_m_tok"), h.alias("_m_h"))
    leaf = ["_m_dom", "_m_lang", "_m_src"]
    narrow = table(rows.select(*leaf, "_m_tok", "_m_h"), "mix-keys")
    sums = table(narrow.groupBy(*leaf).agg(F.sum("_m_tok").alias("_t"), F.count("*").alias("_n")), "mix-leaves")
    total = sums.agg(F.sum("_t")).first()[0] or 0
    cut = leaf_budgets(sums.select(F.col("_m_dom").alias("domain"), F.col("_m_lang").alias("language"), F.col("_m_src").alias("source"),
                                   (F.col("_t") * max_epochs).alias("cap")), fraction * total, weights)
    cut = sums.join(cut.select(F.col("domain").alias("_m_dom"), F.col("language").alias("_m_lang"), F.col("source").alias("_m_src"), "budget"), leaf)
    cut = cut.withColumn("_full", F.when(F.col("_t") > 0, F.floor(F.col("budget") / F.col("_t"))).otherwise(F.lit(1)))
    cut = cut.withColumn("_need", F.when(F.col("_t") > 0, F.col("budget") - F.col("_full") * F.col("_t")).otherwise(F.lit(0)))
    cut = table(cut.select(*leaf, F.col("_full").cast("long").alias("_full"), F.col("_need").cast("long").alias("_need"),
                           F.lit(0).cast("long").alias("_prefix")), "mix-cut")
    n_leaves = cut.count()
    u = F.expr("_m_h ^ (-9223372036854775807L - 1L)")  # order of the signed hash as bits
    live, crossing = narrow, cut.where("_need > 0")
    for k in (1, 2):  # the first 8 bits, then the next 8
        live = live.join(small(crossing.select(*leaf, "_prefix"), n_leaves), leaf)
        live = live.where(F.shiftrightunsigned(u, 64 - 8 * (k - 1)) == F.col("_prefix")) if k > 1 else live
        bucket = F.shiftrightunsigned(u, 64 - 8 * k)
        b = live.drop("_prefix").withColumn("_b", bucket).groupBy(*leaf, "_b").agg(F.sum("_m_tok").alias("_t"))
        w = Window.partitionBy(*leaf).orderBy("_b")
        b = b.withColumn("_cum", F.sum("_t").over(w))
        crossing = table(b.join(small(crossing, n_leaves), leaf).where("_cum > _need").groupBy(*leaf, "_need")
                         .agg(F.min(F.struct("_b", (F.col("_cum") - F.col("_t")).alias("c"))).alias("x"))
                         .select(*leaf, (F.col("_need") - F.col("x.c")).alias("_need"), F.col("x._b").alias("_prefix")), "mix-cross")
        live = live.drop("_prefix")
    last = live.join(small(crossing, n_leaves), leaf).where(F.shiftrightunsigned(u, 48) == F.col("_prefix"))
    last = last.groupBy(*leaf, "_need", "_m_h").agg(F.max("_m_tok").alias("_m_tok"), F.sum("_m_tok").alias("_t"))
    w = Window.partitionBy(*leaf).orderBy("_m_h")
    # the first hash whose tokens go over the budget: all before it are taken
    stop = (last.withColumn("_cum", F.sum("_t").over(w)).where("_cum > _need").groupBy(*leaf).agg(F.min("_m_h").alias("_stop")))
    ends = cut.join(stop, leaf, "left")
    ends = table(ends.select(*[F.col(c).alias(f"_e{c}") for c in leaf], "_full", "_need", "_stop"), "mix-ends")
    on = [F.col(c) == F.col(f"_e{c}") for c in leaf]
    copies = F.col("_full") + F.when((F.col("_need") > 0) & (F.col("_m_h") < F.col("_stop")), 1).otherwise(0)
    out = rows.join(small(ends, n_leaves), on).withColumn("_m_copies", copies).where("_m_copies > 0")
    return out.select(*docs.columns, F.col("_m_dom").alias("mix_domain"), F.col("_m_tok").alias("mix_tokens"), F.col("_m_copies").alias("mix_copies"))
