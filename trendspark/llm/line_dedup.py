"""Line dedup (operator 8): deletion-neighbourhood join over lines.

A line is dropped if an earlier line (order: document id, then line number) of the corpus is the same
or, for lines of at least ``min_words`` words, lies within one edit: one word replaced, inserted or
left out. The rule is judged on the input, so a chain of edits drops all but its first line.

1. Every line is a row of hashes. Equal lines become one, with their first place.
2. A line of q words within one edit of another shares with it the first floor(q/2) or the last
   ceil(q/2) words, for q the shorter length. Lines that share neither key with any other line are
   done (partial counts, no pairs).
3. The others emit their deletion variants: the hash of the line without word i, tagged with i, for the
   half the edit can be in; and, as the longer line of an insertion loses its word i to become the
   shorter one, the whole line tagged with every gap i. Two lines with an equal variant at an equal tag
   are within one edit, so each variant keeps only its earliest line, and a line takes the earliest
   over its variants: no pairs are made inside a group of any size.
4. The (line, earliest) pairs are verified by edit distance on their words, then lines are dropped.

Hashes have 64 bits twice for a whole line, once for a key or variant (verified in step 4).

Null text: null, no lines. Lines without a word are never counted, and stay while any line of their text
stays; a text whose lines all go becomes empty. Rows with an equal id and text are one row; rows with
equal ids and other texts are ordered by text hash. Null ids come first. Empty table: empty. Extra
columns are kept (any named like an added column is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import lean, mix, powers, prefix_hash, small_lists, table, text_batches, word_spans

_ODD = np.uint64(0x9E3779B97F4A7C15)
LINES = "k long, h long, line int, h1 long, h2 long, n int, pa long, sa long, pb long, sb long"
PLACE = ["k", "h", "line"]
#: characters of texts hashed at once
BLOCK = 1 << 18


def line_hashes(texts: list[str]) -> dict[str, np.ndarray]:
    """For each line with a word of some texts: which text, line number, two hashes, words, and its keys for
    q = n and q = n - 1. The texts are handled as one, with a line break after each."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b"\n".join(raws), np.uint8)
    ends = np.append(np.flatnonzero(b == 10), len(b))
    starts = np.append(0, ends[:-1] + 1)
    head = np.searchsorted(starts, np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]]))  # first line of each text
    p = prefix_hash(b)
    inv = powers(len(b) + 1)[1]
    ws, we = word_spans(b)
    words = mix((p[we] - p[ws]) * inv[ws] + (we - ws).astype(np.uint64))
    first = np.searchsorted(ws, starts)
    last = np.searchsorted(ws, ends)
    ok = np.flatnonzero(last > first)
    s, e, a, z = starts[ok], ends[ok], first[ok], last[ok]
    raw = (p[e] - p[s]) * inv[s]
    q, qi = _word_prefix(words)
    n = z - a

    def span(lo, hi, tag):
        return mix((q[hi] - q[lo]) * qi[lo] + tag.astype(np.uint64) * _ODD)

    of = np.searchsorted(head, ok, "right") - 1
    out = {"of": of, "line": ok - head[of], "h1": mix(raw + (e - s).astype(np.uint64)), "h2": span(a, z, n) ^ mix(raw * _ODD), "n": n}
    for name, m in (("a", n), ("b", n - 1)):
        half = m // 2
        out["p" + name] = span(a, a + half, 2 * m)
        out["s" + name] = span(z - (m - half), z, 2 * m + 1)
    return out


def _word_prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pw, inv = powers(len(words) + 1)
    q = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * pw[: len(words)], out=q[1:])
    return q, inv


def variants(lines: list[str], from_front: np.ndarray, from_back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tagged hashes of the deletion neighbourhoods, and which line each belongs to. ``from_front``: another
    line shares the first half, so the edit is at or behind the middle; ``from_back``: it shares the last half."""
    raws = [x.encode("utf-8", "replace") for x in lines]
    b = np.frombuffer(b"\n".join(raws), np.uint8)
    p, inv = prefix_hash(b), powers(len(b) + 1)[1]
    ws, we = word_spans(b)
    words = mix((p[we] - p[ws]) * inv[ws] + (we - ws).astype(np.uint64))
    q, qi = _word_prefix(words)
    z = np.searchsorted(ws, np.cumsum([len(r) + 1 for r in raws]))
    a = np.append(0, z[:-1])
    n = z - a
    of = np.repeat(np.arange(len(lines)), n + 1)
    i = np.arange(len(of)) - (a + np.arange(len(lines)))[of]
    middle = (n - 1) // 2
    use = (from_front[of] & (i >= middle[of])) | (from_back[of] & (i <= (n - middle)[of]))
    of, i = of[use], i[use]
    whole = mix(mix(((q[z] - q[a]) * qi[a])[of]) + i.astype(np.uint64) * _ODD)
    d = i < n[of]
    do, di = of[d], i[d]
    at = a[do] + di
    without = (q[at] - q[a[do]] + (q[z[do]] - q[at + 1]) * qi[1]) * qi[a[do]]
    return np.concatenate([do, of]), np.concatenate([mix(mix(without) + di.astype(np.uint64) * _ODD), whole])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word replaced, inserted or left out (or nothing) turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb[1:] or ra[1:] == rb or ra == rb[1:]


_WHITE = " \t\n\x0b\x0c\r"
_BLANK = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _tokens(line: str) -> list[str]:
    return [w for w in line.translate(_BLANK).split(" ") if w]


def line_dedup(docs: DataFrame, min_words: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the reduced text, plus ``n_lines`` (lines with a word), ``n_exact`` and ``n_near`` (dropped ones)."""
    text_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    keyed = docs.select(*rest, F.col(key).cast("long").alias("_k"), F.xxhash64(text).alias("_h"))
    src = keyed.select(F.coalesce("_k", F.lit(-(1 << 63))).alias("k"), F.col("_h").alias("h"), F.col(text).alias("t")).where(F.col("t").isNotNull())

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = np.cumsum(pdf["t"].str.len().to_numpy()) // BLOCK
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(sizes)) + 1):
                if not len(part):
                    continue
                rows = line_hashes(pdf["t"].iloc[part].tolist())
                at = part[rows.pop("of")]
                out = pd.DataFrame({"k": pdf["k"].to_numpy()[at], "h": pdf["h"].to_numpy()[at]})
                for c, x in rows.items():
                    out[c] = x.view(np.int64) if x.dtype == np.uint64 else x
                yield out

    lines = src.mapInPandas(lean(hashes), LINES)
    same = lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("at"), *[F.first(c).alias(c) for c in ("n", "pa", "sa", "pb", "sb")])
    same = table(same.select("at.*", "n", "pa", "sa", "pb", "sb"), "lines")
    near = _near(src, same, min_words)
    kept = same.select(*PLACE).join(near.select(*PLACE, F.lit(True).alias("near")), PLACE, "left")
    kept = kept.groupBy("k", "h").agg(F.collect_list(F.when(F.col("near").isNull(), F.col("line"))).alias("stay"), F.count("near").alias("nn"))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, total, exact = [], [], []
            for t, stay, nn in zip(pdf[text], pdf["_stay"], pdf["n_near"]):
                if t is None:
                    texts.append(None)
                    total.append(0)
                    exact.append(0)
                    continue
                ls = t.split("\n")
                stay = [] if stay is None else stay
                blank = [i for i, x in enumerate(ls) if not x or not x.strip(_WHITE)]
                total.append(len(ls) - len(blank))
                exact.append(total[-1] - len(stay) - nn)
                if len(stay) == total[-1]:
                    texts.append(t)
                elif not len(stay):
                    texts.append("")
                else:
                    texts.append("\n".join([ls[i] for i in sorted([*stay, *blank])]))
            yield pdf.drop(columns=["_stay"]).assign(**{text: texts, "n_lines": total, "n_exact": exact})

    kept = kept.toDF("_kept_k", "_kept_h", "_stay", "_nn")
    d = keyed.join(kept, (F.coalesce("_k", F.lit(-(1 << 63))) == F.col("_kept_k")) & (F.col("_h") == F.col("_kept_h")), "left")
    d = d.select(*rest, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_exact"),
                 F.coalesce("_nn", F.lit(0)).alias("n_near"), "_stay")
    return d.mapInPandas(lean(rebuild), d.drop("_stay").schema)


def _near(src: DataFrame, same: DataFrame, min_words: int) -> DataFrame:
    """Places of lines that have an earlier line within one edit."""
    long_ = same.where(F.col("n") >= min_words)
    keys = long_.select(*PLACE, F.posexplode(F.array("pa", "sa", "pb", "sb")).alias("side", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = keys.join(shared, "key", "left_semi").groupBy(*PLACE).agg(
        F.max(F.col("side") % 2 == 0).alias("front"), F.max(F.col("side") % 2 == 1).alias("back"))
    live = live.groupBy("k", "h").agg(F.collect_list(F.struct("line", "front", "back")).alias("ls"))
    live = table(live, "live-lines")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo: lo + 64]
                rows = [(k, h, x, cut[x["line"]]) for k, h, t, ls in zip(part["k"], part["h"], part["t"], part["ls"])
                        for cut in [t.split("\n")] for x in ls]
                of, keys = variants([r[3] for r in rows], *[np.array([r[2][side] for r in rows]) for side in ("front", "back")])
                out = {"k": [r[0] for r in rows], "h": [r[1] for r in rows], "line": [r[2]["line"] for r in rows]}
                yield pd.DataFrame({c: np.array(x)[of] for c, x in out.items()} | {"key": keys.view(np.int64)})

    var = table(src.join(small_lists(live, "ls", 40), ["k", "h"]).mapInPandas(lean(emit), "k long, h long, line int, key long"), "variants")
    first = var.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("to"), F.max(F.struct(*PLACE)).alias("last")).where("to < last").select("key", "to")
    pairs = var.join(first, "key").groupBy(*PLACE).agg(F.min("to").alias("to")).where(F.struct(*PLACE) > F.col("to"))
    return _verified(src, table(pairs, "line-pairs"))


def _verified(src: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (line, earliest) whose words are within one edit; both lines are fetched from their texts."""
    wanted = pairs.select(*PLACE).union(pairs.select("to.*")).distinct().groupBy("k", "h").agg(F.collect_list("line").alias("ls"))
    wanted = table(wanted, "line-texts")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h, t, ls in zip(pdf["k"], pdf["h"], pdf["t"], pdf["ls"]):
                cut = t.split("\n")
                rows += [(k, h, i, cut[i]) for i in ls]
            yield pd.DataFrame(rows, columns=["k", "h", "line", "s"])

    got = table(src.join(small_lists(wanted, "ls", 8), ["k", "h"]).mapInPandas(lean(fetch), "k long, h long, line int, s string").dropDuplicates(PLACE), "line-texts")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[within_one(_tokens(a), _tokens(b)) for a, b in zip(pdf["s"], pdf["s2"])], PLACE]

    other = got.select(F.struct(*PLACE).alias("to"), F.col("s").alias("s2"))
    return pairs.join(got, PLACE).join(other, "to").select(*PLACE, "s", "s2").mapInPandas(lean(check), "k long, h long, line int")
