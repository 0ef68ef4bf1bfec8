"""Language ID (operator 9): string-kernel classification.

Kernel: blended spectrum of byte n-grams (1..3 bytes of the lower-cased UTF-8 text), presence
not frequency, each order normalised by the numbers of distinct n-grams of both texts. Landmark
texts give a Nyström feature space; one-versus-rest kernel ridge regression is solved in it. As
the kernel is linear in presence, the landmark part folds into one matrix (n-gram x language) per
order, and a batch of texts is scored by matrix products.

Fitting reads a bounded sample (``per_lang`` texts of each language, picked by a hash of the id;
``per_lang_landmarks`` of them are landmarks); scoring reads every text whole.

Null texts and texts without a letter: ``und``, score 0. Rows with a null language don't teach; of more than
``max_langs`` labels those with the most texts teach. Repeated rows and equal texts get equal answers. No teaching
row: every text is ``und``. Extra columns stay, those named like an added one are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import lean, text_batches

ORDERS = (1, 2, 3)
_LETTER = re.compile(r"[^\W\d_]")
_CODE = re.compile(r"\S*\d\S*")
_SIZE = {1: 1 << 8, 2: 1 << 16, 3: 1 << 24}
_STAMP: dict[int, np.ndarray] = {}


def distinct_grams(text: str) -> list[np.ndarray]:
    """For each order the distinct byte n-grams as integers. A table stamped with positions
    finds them in one pass, without a sort and without clearing it between texts."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int32)
    out = []
    for n in ORDERS:
        if len(b) < n:
            out.append(np.zeros(0, np.int32))
            continue
        code = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            code = (code << 8) | b[k: len(b) - n + 1 + k]
        stamp = _STAMP.setdefault(n, np.zeros(_SIZE[n], np.int32))
        at = np.arange(len(code), dtype=np.int32)
        stamp[code] = at
        out.append(code[stamp[code] == at])
    return out


def _has_letter(text) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _familiar(known: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of a text's three-byte n-grams that are known; that of the two-byte ones counts as eight more of
    them, as a short text has few. Columns: the orders."""
    return (known[:, 2] + 8 * known[:, 1] / np.maximum(1, sizes[:, 1])) / (sizes[:, 2] + 8)


class Model:
    """``langs``; per order the known n-grams (sorted) and their weight for each language; for each language
    the least familiar share (:func:`_familiar`) of a text in it."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], weights: list[np.ndarray], least: np.ndarray | None = None):
        self.langs, self.grams, self.weights = langs, grams, weights
        self.least = np.zeros(len(langs)) if least is None else least

    def score(self, texts: list[str]) -> np.ndarray:
        """Decision values, texts x languages: sum over orders of presence @ weights / sqrt(|x|)."""
        return self.score_and_share(texts)[0]

    def score_and_share(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Decision values, and each text's familiar share."""
        known, sizes = np.zeros((len(texts), len(ORDERS))), np.zeros((len(texts), len(ORDERS)))
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        sets = [distinct_grams(t) for t in texts]
        for k, (grams, w) in enumerate(zip(self.grams, self.weights)):
            row = _row_table(k, grams)
            present = np.zeros((len(texts), len(grams)), np.float32)
            size = np.ones(len(texts), np.float32)
            for i, s in enumerate(sets):
                at = row[s[k]]
                at = at[at >= 0]
                present[i, at] = 1
                size[i] = max(1, len(s[k]))
                known[i, k], sizes[i, k] = len(at), len(s[k])
            out += (present @ w) / np.sqrt(size)[:, None]
        return out, _familiar(known, sizes)


_ROWS: dict = {}


def _row_table(k: int, grams: np.ndarray) -> np.ndarray:
    """n-gram -> its row in the weights, -1 if unknown (kept for the worker's next batches)."""
    key = (k, len(grams), int(grams.sum()) if len(grams) else 0)
    if _ROWS.get(k, (None,))[0] != key:
        t = np.full(_SIZE[ORDERS[k]], -1, np.int32)
        t[grams] = np.arange(len(grams), dtype=np.int32)
        _ROWS[k] = (key, t)
    return _ROWS[k][1]


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 96,
        per_lang_landmarks: int = 24, ridge: float = 1e-2, max_langs: int = 200, max_texts: int = 4_800, max_landmarks: int = 480) -> Model:
    """Fit on at most ``max_texts`` texts and ``max_landmarks`` landmarks, ``per_lang`` and ``per_lang_landmarks`` of a language
    at most: where there are many languages each has fewer. Only the n-gram sets of these texts reach the driver."""
    ok = train.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    # labels are counted first, so that neither their number nor that of their texts grows the sample
    labels = [r["lang"] for r in ok.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    ok = ok.where(F.col("lang").isin(labels)) if labels else ok.limit(0)
    per_lang = max(1, min(per_lang, max_texts // max(1, len(labels))))
    per_lang_landmarks = max(1, min(per_lang_landmarks, max_landmarks // max(1, len(labels))))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k", "h")
    ids = (ok.select("lang", "k", F.xxhash64("t").alias("h")).withColumn("r", F.row_number().over(w))
           .where(F.col("r") <= per_lang).select("lang", "k", "h", "r").collect())  # bounded: per_lang rows a language
    langs = sorted({r["lang"] for r in ids})
    if not ids:
        return Model([], [np.zeros(0, np.int32)] * len(ORDERS), [np.zeros((0, 0), np.float32)] * len(ORDERS))
    spark = train.sparkSession
    pick = F.broadcast(spark.createDataFrame([(r["lang"], r["k"], r["h"], r["r"]) for r in ids], "lang string, k string, h long, r int"))
    rows = (ok.withColumn("h", F.xxhash64("t")).join(pick, ["lang", "k", "h"]).select("lang", "k", "r", "t")
            .mapInPandas(lean(_gram_sets), "lang string, k string, r int, g1 binary, g2 binary, g3 binary")
            .dropDuplicates(["lang", "r"]).orderBy("lang", "r").collect())
    sets = [[np.frombuffer(r[f"g{n}"], np.int32) for n in ORDERS] for r in rows]
    marks = [i for i, r in enumerate(rows) if r["r"] <= per_lang_landmarks]
    y = np.array([[1.0 if r["lang"] == x else -1.0 for x in langs] for r in rows])
    k_all = np.zeros((len(rows), len(marks)))
    grams, presence = [], []
    known = np.zeros((len(rows), len(ORDERS)))
    mark = np.isin(np.arange(len(rows)), marks)
    for k in range(len(ORDERS)):
        g = np.unique(np.concatenate([sets[i][k] for i in marks]))
        p = np.zeros((len(g), len(marks)), np.float32)  # landmark presence, normalised
        for j, i in enumerate(marks):
            p[np.searchsorted(g, sets[i][k]), j] = 1 / np.sqrt(max(1, len(sets[i][k])))
        grams.append(g)
        presence.append(p)
        holders = (p > 0).sum(1)
        for i, s in enumerate(sets):
            at = np.searchsorted(g, s[k])
            at = at[(at < len(g)) & (g[np.minimum(at, len(g) - 1)] == s[k])] if len(g) else at[:0]
            k_all[i] += p[at].sum(0) / np.sqrt(max(1, len(s[k])))
            known[i, k] = (holders[at] > mark[i]).sum()  # a landmark is held out: another one must know the n-gram
    k_all /= len(ORDERS)
    k_mm = k_all[marks]
    # every language counts alike, however many texts teach it
    share = np.array([1 / max(1, sum(r["lang"] == x["lang"] for x in rows)) for r in rows])[:, None]
    a = k_all.T @ (share * k_all) + ridge * (k_mm + k_mm.T) / 2 + 1e-8 * np.eye(len(marks))
    alpha = np.linalg.solve(a, k_all.T @ (share * y))
    share = _familiar(known, np.array([[len(x) for x in s] for s in sets]))
    least = np.array([0.6 * np.quantile([v for v, r in zip(share, rows) if r["lang"] == x], 0.05) for x in langs])
    return Model(langs, grams, [(p @ alpha / len(ORDERS)).astype(np.float32) for p in presence], least)


def _gram_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [distinct_grams(t) for t in pdf["t"]]
        out = pdf[["lang", "k", "r"]].copy()
        for k, n in enumerate(ORDERS):
            out[f"g{n}"] = [np.sort(s[k]).tobytes() for s in sets]
        yield out


def _words_match(model: Model, text: str, lang: int) -> bool:
    """Whether the text without its words with digits (keys, numbers) is familiar enough."""
    words = _CODE.sub(" ", text)
    return words != text and _has_letter(words) and model.score_and_share([words])[1][0] >= model.least[lang]


def predict(docs: DataFrame, model: Model, text: str = "text", out_lang: str = "lang_pred", out_score: str = "score",
            batch: int = 128, out_match: str | None = None) -> DataFrame:
    """``docs`` plus the predicted language and a score from 0 to 1 (0.5: on the decision border); as ``out_match``,
    if named, whether the text's n-grams are as familiar as its language asks (:class:`Model`)."""
    text_batches(docs.sparkSession)
    added = {c.lower() for c in (out_lang, out_score, out_match) if c}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    cols = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out_lang, T.StringType()), T.StructField(out_score, T.DoubleType()),
                           *([T.StructField(out_match, T.BooleanType())] if out_match else [])])

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            good = [i for i, t in enumerate(texts) if _has_letter(t)] if model.langs else []
            langs, scores, match = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for lo in range(0, len(good), batch):
                at = good[lo: lo + batch]
                f, share = model.score_and_share([texts[i] for i in at])
                for i, j, v, x in zip(at, f.argmax(1), f.max(1), share):
                    match[i] = x >= model.least[j] or _words_match(model, texts[i], j)
                    langs[i], scores[i] = model.langs[j], min(1.0, max(0.0, (float(v) + 1) / 2))
            yield pdf[cols].assign(**{out_lang: langs, out_score: scores} | ({out_match: match} if out_match else {}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from predicted(batches)
        finally:  # 128 MB that a worker would hold through later stages
            _STAMP.clear()
            _ROWS.clear()

    return docs.mapInPandas(lean(run), schema)
