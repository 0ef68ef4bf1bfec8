"""Quality classifier (operator 11): a factorisation machine.

Features of a text are (1) its words, hashed into ``BUCKETS`` buckets, each valued by the logarithm of its
count and the text's words scaled to length one; (2) structure statistics (:data:`STATS`) of the whole text;
(3) numeric metadata columns, if named. A statistic is one of ``BINS`` indicator features, cut at quantiles of
the teaching sample in which both classes weigh alike; a missing value (no word to divide by, a null column) is
an indicator of its own.

Score: w0 + sum w_i x_i + the interaction of all pairs, sum_{i<j} <v_i, v_j> x_i x_j, which is linear in the
number of features by the identity 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2). Logistic loss, both
classes weighted alike, AdaGrad over shuffled batches. A feature that no teaching text has gets weight and
factors zero. A fifth of the sample is kept from training and sets the border: it is moved to score ``border``.

Teaching reads at most ``per_class`` labelled texts of each class, picked by a hash of the id; only their
features reach the driver (at most ``BUCKETS`` of 8 bytes a text). The model's size is fixed (BUCKETS x FACTORS
floats), whatever the corpus. Scoring reads every text whole; a task holds the features of some 2 MB of text, or
of one longer text.

Null text is the empty text; it is scored by its statistics. Labels that are null, neither 0 nor 1, or differ for
one id teach nothing; of rows with one id, one text teaches. Without labels of both classes every score is
``border`` if only label 1 was seen, else next to 0. Null ids don't teach and are scored. Repeated rows get equal scores.
Extra columns stay, those named like an added one are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import lean, mix, powers, prefix_hash, text_batches, word_spans

BUCKETS = 1 << 14
FACTORS = 8
BINS = 12
#: bytes of text whose features are computed at once
CHUNK = 2 << 20
STATS = ("log_words", "bytes_per_word", "bangs_per_word", "symbols_per_word", "pipes_per_word", "digits_per_byte", "capitals_per_letter",
         "lines_per_word", "stops_per_word", "other_bytes_per_byte", "controls_per_byte", "distinct_words", "commonest_word",
         "neighbour_repeats", "words_without_letter")

# byte classes: 0 other ASCII, 1 lower, 2 capital, 3 digit, 4 bang, 5 symbol, 6 pipe, 7 newline, 8 stop, 9 beyond ASCII, 10 control
_CLASSES = 11
_CLASS = np.zeros(256, np.int64)
for _n, _s in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, "!"), (5, "#*$%&<>~^=+_@{}[]\\"),
               (6, "|"), (7, "\n"), (8, ".,;:?")):
    _CLASS[[ord(c) for c in _s]] = _n
_CLASS[128:] = 9
_CLASS[[c for c in range(32) if c not in (9, 10, 13)]] = 10
_LETTER = np.isin(_CLASS, (1, 2, 9))


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK:
            yield lo, i
            lo, held = i, 0
        held += n + 1
    if lo < len(sizes):
        yield lo, len(sizes)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive runs of ``texts``: word rows ``(text, bucket, value)``, sorted, and the statistics, texts x STATS."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    for lo, hi in _chunks([len(x) for x in data]):
        yield _features(data[lo:hi])


def _features(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    b = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    size = np.array([len(x) for x in data], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    doc = np.repeat(np.arange(n), size + 1)
    by_class = np.bincount(doc * _CLASSES + _CLASS[b], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    by_class[:, 7] -= 1  # the newline put after each text
    s, e = word_spans(b)
    h, of = prefix_hash(b), doc[s]
    word = mix((h[e] - h[s]) * powers(len(b) + 1)[1][s])
    words = np.bincount(of, minlength=n).astype(float)
    key, count = np.unique(of * BUCKETS + (word & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = np.log1p(count)
    value /= np.sqrt(np.bincount(row, value * value, n))[row]
    same = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[b])])
    bare = np.bincount(of, letters[e] == letters[s], n)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    with np.errstate(divide="ignore", invalid="ignore"):
        per_word = [by_class[:, k] / words for k in (4, 5, 6, 7, 8)]
        stats = np.column_stack([
            np.log2(1 + words), (size - np.bincount(doc, _space(b), n) + 1) / words, per_word[0], per_word[1], per_word[2],
            by_class[:, 3] / size, by_class[:, 2] / (by_class[:, 1] + by_class[:, 2]), per_word[3], per_word[4], by_class[:, 9] / size,
            by_class[:, 10] / size, np.bincount(row, minlength=n) / words, top / words,
            np.bincount(of[1:], same, n) / np.maximum(words - 1, 0), bare / words])
    stats[~np.isfinite(stats)] = np.nan
    return row, bucket, value, stats


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


class Model:
    """``cuts``: for each statistic its bin borders; ``w0``, ``w`` and ``v`` over words, then statistics' bins; ``shift``
    is added before the logistic function."""

    def __init__(self, cuts: list[np.ndarray], w0: float, w: np.ndarray, v: np.ndarray, shift: float):
        self.cuts, self.w0, self.w, self.v, self.shift = cuts, w0, w, v, shift

    def margin(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        r, i, x = _joined(row, bucket, value, stats, self.cuts)
        return _forward(r, i, x, len(stats), self.w0, self.w, self.v)[0]

    def score(self, texts: list[str | None], meta: np.ndarray | None = None) -> np.ndarray:
        out, at = [], 0
        for row, bucket, value, stats in features(texts):
            if meta is not None:
                stats = np.column_stack([stats, meta[at: at + len(stats)]])
            at += len(stats)
            out.append(self.margin(row, bucket, value, stats))
        f = np.concatenate([*out, np.zeros(0)]) + self.shift
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _bins(stats: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Feature numbers of the statistics' bins; bin BINS is that of a missing value."""
    cols = [np.where(np.isnan(stats[:, k]), BINS, np.searchsorted(c, np.nan_to_num(stats[:, k]), "right")) + k * (BINS + 1)
            for k, c in enumerate(cuts)]
    return BUCKETS + (np.column_stack(cols) if cols else np.zeros((len(stats), 0), np.int64))


def _joined(row, bucket, value, stats, cuts):
    """Word and bin features of each text as one list of (text, feature, value), by text. Bins weigh 1 / sqrt(their number)."""
    n, bins = len(stats), _bins(stats, cuts)
    r = np.concatenate([row, np.repeat(np.arange(n), bins.shape[1])])
    i = np.concatenate([bucket, bins.ravel()])
    x = np.concatenate([value, np.full(bins.size, max(1, bins.shape[1]) ** -0.5)])
    at = np.argsort(r, kind="stable")
    return r[at], i[at], x[at]


def _forward(r, i, x, n, w0, w, v):
    """(margins, sums of v x for each text): linear in the number of features."""
    vx = v[i] * x[:, None]
    start = np.searchsorted(r, np.arange(n))
    s = np.add.reduceat(vx, start) if len(r) else np.zeros((n, v.shape[1]))
    q = np.add.reduceat(vx * vx, start) if len(r) else s
    return w0 + np.bincount(r, w[i] * x, n) + 0.5 * (s * s - q).sum(1), s


def train(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, border: float = 0.7, epochs: int = 12,
          batch: int = 128, rate: float = 0.15, decay: float = 1e-4, seed: int = 11) -> Model:
    """``rows``: bucket numbers and values of each text; ``y``: 0 or 1."""
    rng = np.random.default_rng(seed)
    size = np.bincount(y, minlength=2)
    wide = BUCKETS + stats.shape[1] * (BINS + 1)
    weight = np.where(y == 1, 0.5 / max(1, size[1]), 0.5 / max(1, size[0]))
    cuts = [_cuts(stats[:, k], weight) for k in range(stats.shape[1])]
    if not size.all():
        f = np.log(border / (1 - border)) + 1e-9 if size[1] else -40.0
        return Model(cuts, float(f), np.zeros(wide), np.zeros((wide, FACTORS)), 0.0)
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        of = order[y[order] == c]
        held[of[: len(of) // 5]] = True
    learn = order[~held[order]]
    weight = np.where(y == 1, 0.5 / (y[learn] == 1).sum(), 0.5 / (y[learn] == 0).sum()) * len(learn)
    w0, w, v = 0.0, np.zeros(wide), rng.normal(0, 0.02, (wide, FACTORS))
    g0, gw, gv = 1e-6, np.full(wide, 1e-6), np.full((wide, FACTORS), 1e-6)
    seen = np.zeros(wide, bool)
    for _ in range(epochs):
        learn = rng.permutation(learn)
        for lo in range(0, len(learn), batch):
            at = learn[lo: lo + batch]
            r, i, x = _joined(*_packed([rows[k] for k in at]), stats[at], cuts)
            f, s = _forward(r, i, x, len(at), w0, w, v)
            d = (1 / (1 + np.exp(-np.clip(f, -40, 40))) - y[at]) * weight[at] / len(at)
            u, where = np.unique(i, return_inverse=True)
            seen[u] = True
            dw = np.bincount(where, d[r] * x, len(u)) + decay * w[u]
            each = d[r, None] * x[:, None] * (s[r] - v[i] * x[:, None])
            dv = np.column_stack([np.bincount(where, each[:, k], len(u)) for k in range(FACTORS)]) + decay * v[u]
            d0 = d.sum()
            g0, gw[u], gv[u] = g0 + d0 * d0, gw[u] + dw * dw, gv[u] + dv * dv
            w0 -= rate * d0 / np.sqrt(g0)
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
    v[~seen] = 0
    model = Model(cuts, float(w0), w, v, 0.0)
    test = np.flatnonzero(held) if held.any() else learn
    f = np.concatenate([model.margin(*_packed([rows[k] for k in part]), stats[part]) for part in np.array_split(test, -(-len(test) // 1024))])
    model.shift = float(np.log(border / (1 - border)) - _border(f, y[test]))
    return model


def _packed(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    return r, np.concatenate([b for b, _ in rows]).astype(np.int64), np.concatenate([x for _, x in rows]).astype(float)


def _cuts(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Borders of ``BINS`` bins of equal weight, fewer where values tie."""
    ok = ~np.isnan(x)
    if not ok.any():
        return np.zeros(0)
    at = np.argsort(x[ok], kind="stable")
    v, c = x[ok][at], np.cumsum(weight[ok][at])
    return np.unique(v[np.searchsorted(c, c[-1] * np.arange(1, BINS) / BINS).clip(0, len(v) - 1)])


def _border(f: np.ndarray, y: np.ndarray) -> float:
    """The margin that parts both classes best (least sum of their error rates): of the best gaps the middle one's middle."""
    at = np.argsort(f, kind="stable")
    f, y = f[at], y[at]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum()) + \
        np.concatenate([[0], np.cumsum((y == 0)[::-1])])[::-1] / max(1, (y == 0).sum())
    ends = np.concatenate([[f[0] - 1], f, [f[-1] + 1]])
    gap = np.diff(ends) > 0
    best = np.flatnonzero(gap & (wrong <= wrong[gap].min() + 1e-12))
    k = best[np.argmax(ends[best + 1] - ends[best])]
    return float((ends[k] + ends[k + 1]) / 2)


def fit(train_docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        meta: tuple[str, ...] = (), per_class: int = 6_000, border: float = 0.7) -> Model:
    """A model from at most ``per_class`` labelled texts of each class."""
    spark = train_docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"), F.max(label).alias("_y2"))
    known = known.where("_y = _y2").select("_k", F.col("_y").cast("int").alias("_y"))
    order = [F.xxhash64(F.col("_k").cast("string")), F.col("_k")]
    # labelled ids need not have a text: ids of the documents come first
    there = train_docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()
    known = known.join(there, "_k", "left_semi")
    pick = [known.where(F.col("_y") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    pick = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * per_class rows at most
    cols = [F.col(text).alias("t"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(meta)]]
    one = (train_docs.select(F.col(key).alias("_k"), F.struct(F.xxhash64(text).alias("h"), *cols).alias("_d"))
           .join(pick, "_k").groupBy("_k", "_y").agg(F.min("_d").alias("_d")).select("_y", "_d.*"))
    names = [f"m{i}" for i in range(len(meta))]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for row, bucket, value, stats in features(pdf["t"].tolist()):
                part = pdf.iloc[at: at + len(stats)]
                at += len(stats)
                ends = np.searchsorted(row, np.arange(len(stats) + 1))
                yield pd.DataFrame({"y": part["_y"].to_numpy(), "b": [bucket[i:j].astype("<i4").tobytes() for i, j in zip(ends, ends[1:])],
                                    "x": [value[i:j].astype("<f4").tobytes() for i, j in zip(ends, ends[1:])],
                                    "s": list(np.column_stack([stats, part[names].to_numpy(float)]))})

    got = sorted((r["y"], bytes(r["b"]), bytes(r["x"]), r["s"])
                 for r in one.mapInPandas(lean(rows), "y int, b binary, x binary, s array<double>").collect() if r["y"] in (0, 1))  # bounded: 2 * per_class rows
    if not got:
        return train([], np.zeros((0, len(STATS) + len(meta))), np.zeros(0, np.int64), border)
    stats = np.array([[np.nan if v is None else v for v in r[3]] for r in got], float)
    return train([(np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<f4")) for r in got], stats, np.array([r[0] for r in got]), border)


def predict(docs: DataFrame, model: Model, text: str = "text", meta: tuple[str, ...] = (), out_score: str = "score",
            out_label: str = "predicted", border: float = 0.7) -> DataFrame:
    """``docs`` plus the score (0 to 1) and whether it reaches ``border`` (1 or 0)."""
    spark = docs.sparkSession
    text_batches(spark)
    added = {out_score.lower(), out_label.lower()}
    keep = [c for c in docs.columns if c.lower() not in added]
    inner = [F.col(text).alias("_fm_text"), *[F.col(c).cast("double").alias(f"_fm_meta{i}") for i, c in enumerate(meta)]]
    d = docs.select(F.struct(*keep).alias("_fm_row"), *inner) if keep else docs.select(F.struct(F.lit(0).alias("_")).alias("_fm_row"), *inner)
    names = [f"_fm_meta{i}" for i in range(len(meta))]
    schema = T.StructType([d.schema["_fm_row"], T.StructField("_fm_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:  # Arrow, as rows pass unchanged
            m = np.column_stack([rb.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]) if names else None
            yield pa.RecordBatch.from_arrays([rb.column("_fm_row"), pa.array(model.score(rb.column("_fm_text").to_pylist(), m))],
                                             names=["_fm_row", "_fm_score"])

    d = d.mapInArrow(lean(run), schema)
    return d.select(*[F.col(f"_fm_row.`{c}`").alias(c) for c in keep], F.col("_fm_score").alias(out_score),
                    (F.col("_fm_score") >= border).cast("int").alias(out_label))
