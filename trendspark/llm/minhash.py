"""MinHash near-dedup (operator 6): DartMinHash.

A text is a weighted set: its five-word shingles, weighted by how often each stands in it (a shorter
text is one shingle). The weight axis of an element is cut into regions that double in height ([0, 1), [1, 2),
[2, 4), [4, 8) and so on, up to ``TALLEST``), so an element of weight w owns about log2(w) of them. A hash of (element, region,
level) says how many darts fall into the region's level of ranks and, for each dart, its coordinate, its rank and its height
in the region; darts above the element's weight are not thrown. A signature keeps for each of ``coords`` coordinates the
dart of the least rank. Levels double in width, and a text opens only as many as its total weight asks for (about
log(coords) / weight, then further ones while a coordinate is empty), so a signature costs about
coords * log(coords) darts whatever the weights. Two signatures agree at a coordinate with probability
equal to the weighted Jaccard similarity.

``rows`` coordinates are a band; texts with an equal band are candidates (24 bands of 4: a pair at 0.8
is missed with probability 3e-6). Texts with equal shingle sets are one class first. A bucket is
first compared with its best-connected member only. In a bucket whose members are then still in
different components, the members outside its largest component are held in blocks of about ``block`` texts,
and all its members stream past each block. So every pair that crosses components is compared, no pair
is a row, and the rows sent are members times blocks. Every link is verified by the exact weighted
Jaccard similarity; a block returns the edges of a spanning forest of its links.

Null or empty texts and texts without words have no shingle: a class of their own, kept. Repeated
rows (equal ids) are one document in the answer, with the smallest class of their texts. Null ids
are left out. Empty table: empty. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import components, lean, mix, powers, prefix_hash, small, table, text_batches, word_spans
from trendspark.llm.embed_dedup import forest

SHINGLE = 5
BASE_LEVEL = 2.0 ** -12
#: height from which regions no longer double: the dart counts of one region stay in the thousands
TALLEST = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CDF: dict[float, np.ndarray] = {}


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and how often each stands in the text."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    s, e = word_spans(b)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = prefix_hash(b)
    w = mix((h[e] - h[s]) * powers(len(b) + 1)[1][s] + (e - s).astype(np.uint64))
    n = max(1, len(w) - SHINGLE + 1)
    x = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        x = mix(x * _ODD + w[k: k + n])
    return np.unique(x, return_counts=True)


def _poisson(mean: float) -> np.ndarray:
    """Distribution function of the Poisson law with this mean, up to where it is 1."""
    if mean not in _CDF:
        k = np.arange(1, int(mean + 12 * np.sqrt(mean) + 24))
        _CDF[mean] = np.cumsum(np.exp(np.r_[0.0, np.cumsum(np.log(mean / k))] - mean))
    return _CDF[mean]


def regions(element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The weight regions of each element: index of the element, hash, height, covered share."""
    n = np.where(weight <= TALLEST, 1 + np.ceil(np.log2(np.minimum(weight, TALLEST))).astype(np.int64),
                 17 + -(-(weight - TALLEST) // TALLEST))
    of = np.repeat(np.arange(len(weight)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    height = np.minimum(1 << np.clip(k - 1, 0, 16), TALLEST)
    bottom = np.where(k == 0, 0, np.where(k <= 17, height, (k - 16) * TALLEST))
    share = np.minimum((weight[of] - bottom) / height, 1.0)
    return of, mix(element[of] + k.astype(np.uint64) * _ODD), height, share


def _dart_counts(h: np.ndarray, height: np.ndarray, mean: float) -> np.ndarray:
    """How many darts each region of hash ``h`` gets, ``mean`` for a height of 1."""
    at = (h >> np.uint64(11)) * 2.0 ** -53
    n = np.searchsorted(_poisson(mean), at, "right")
    for tall in np.unique(height[height > 1]):
        own = height == tall
        n[own] = np.searchsorted(_poisson(mean * int(tall)), at[own], "right")
    return n


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coords: int) -> np.ndarray:
    """Dart ids, sets x coords. Sets must not be empty."""
    of = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    counts = np.concatenate([c for _, c in sets])
    weight = np.bincount(of, weights=counts, minlength=len(sets))
    own, strip, height, share = regions(np.concatenate([e for e, _ in sets]), counts)
    doc = of[own]
    need = np.ceil(np.log2(np.maximum((np.log(coords) + 2) / weight / BASE_LEVEL, 1))).astype(int) + 1
    out = np.zeros(len(sets) * coords, np.uint64)
    hit = np.zeros(len(sets) * coords, bool)
    level = 0
    while True:
        if level:
            full = hit.reshape(len(sets), coords).all(1)
            need = np.where(full, np.minimum(need, level), np.maximum(need, level + 1))
            on = need[doc] > level
            doc, strip, height, share = doc[on], strip[on], height[on], share[on]
            if not len(doc):
                return out.reshape(len(sets), coords)
        width = BASE_LEVEL * (1 if level == 0 else 2.0 ** (level - 1))
        h = mix(strip + np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64))
        n = _dart_counts(h, height, coords * width)
        at = np.flatnonzero(n)
        if len(at):
            k = np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
            dart = mix(np.repeat(h[at], n[at]) + (k + 1).astype(np.uint64) * _ODD)
            cell = np.repeat(doc[at], n[at]) * coords + ((dart >> np.uint64(32)) % np.uint64(coords)).astype(np.int64)
            above = (mix(dart ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(11)) * 2.0 ** -53
            free = ~hit[cell] & (above < np.repeat(share[at], n[at]))
            dart, cell = dart[free], cell[free]
            order = np.argsort(mix(dart))[::-1]  # the rank inside the level; the least is written last
            out[cell[order]] = dart[order]
            hit[cell] = True
        level += 1


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n = sig.shape[1] // rows
    x = np.zeros((len(sig), n), np.uint64)
    for k in range(rows):
        x = mix(x * _ODD + sig[:, k::rows][:, :n])
    return mix(x + np.arange(n, dtype=np.uint64) * _ODD).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of :func:`shingles`."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _pack(s: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    return s[0].tobytes(), s[1].astype("<i4").tobytes() if s[1].max() > 1 else b""


def _unpack(e: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(e, np.uint64)
    return e, np.frombuffer(c, "<i4").astype(np.int64) if c else np.ones(len(e), np.int64)


def sign(docs: DataFrame, coords: int, rows: int) -> DataFrame:
    """(id, digest of the shingle set, bands) of every text with a word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 128):
                part = pdf.iloc[lo: lo + 128]
                sets = [shingles(t) for t in part["t"]]
                have = [i for i, s in enumerate(sets) if len(s[0])]
                if have:
                    b = bands(signatures([sets[i] for i in have], coords), rows)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[have], "bands": list(b),
                                        "digest": [hashlib.blake2b(b"|".join(_pack(sets[i])), digest_size=16).digest() for i in have]})

    return docs.mapInPandas(lean(run), "id long, bands array<long>, digest binary")


def near_documents(docs: DataFrame, threshold: float = 0.8, coords: int = 96, rows: int = 4, block: int = 256, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per id: ``class_id`` (smallest id of its class) and ``kept``."""
    text_batches(docs.sparkSession)
    d = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    signed = table(sign(d, coords, rows), "signatures")
    one = table(signed.groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("m")).select("digest", F.col("m.id").alias("rep"), "m.bands"), "classes")
    buckets = one.select("rep", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = table(buckets.join(shared, "band"), "buckets")
    degree = buckets.groupBy("rep").agg(F.sum("n").alias("degree"))
    buckets = table(buckets.join(degree, "rep"), "buckets")
    pairs = _star(buckets, F.struct(F.col("degree"), (-F.col("rep")).alias("r")), lambda x: -x["r"])
    weights = _elements(d, buckets)
    edges = table(_verify(pairs, weights, threshold), "edges")
    comp = components(edges)
    live = buckets.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held, members = _open_buckets(live, block)
    if held.limit(1).count():
        new = table(_compare(held, members, weights, threshold), "edges")
        if new.limit(1).count():
            comp = components(edges.union(new))
    own = signed.select("id", "digest").join(one.select("digest", "rep"), "digest")
    own = own.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("c"))
    own = own.groupBy("id").agg(F.min("c").alias("c"))
    ids = d.select("id").distinct().join(own, "id", "left")
    cls = F.coalesce("c", "id")
    return ids.select(F.col("id").alias(key), cls.alias("class_id"), (F.col("id") == cls).alias("kept"))


def _star(buckets: DataFrame, order, centre) -> DataFrame:
    """Pairs (a < b) of each bucket's centre, the member greatest by ``order``, with its other members."""
    top = buckets.groupBy("band").agg(F.max(order).alias("x")).select("band", centre(F.col("x")).alias("c"))
    d = buckets.join(top, "band").where("rep <> c")
    return table(d.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct(), "pairs")


def _open_buckets(live: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Of buckets with several components (one of each distinct set of members): (band, block, id) of the
    members outside the largest component, and (band, blocks, id) of all members."""
    sizes = table(live.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("x"),
                                                        F.min("rep").alias("lo")), "bucket-components")
    per = sizes.groupBy("band").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.sum("c").alias("n"), F.max("c").alias("most"),
                                    F.sum("x").alias("x"), F.min("lo").alias("lo"))
    per = per.where("n > most").groupBy("n", "x", "lo").agg(F.min(F.struct("band", "main", "most")).alias("b"))
    per = per.select("b.band", "b.main", F.ceil((F.col("n") - F.col("b.most")) / block).cast("int").alias("blocks"))
    d = table(live.select("band", F.col("rep").alias("id"), "component").join(per, "band"), "open-buckets")
    held = d.where("component <> main").select("band", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), "id")
    return held, d.select("band", "blocks", "id")


def _compare(held: DataFrame, members: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Edges of spanning forests of the links between held texts and their buckets' members."""
    guests = members.select("band", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(1).alias("visit"), "id")
    both = held.select("band", "block", F.lit(0).alias("visit"), "id").union(guests)
    both = both.join(weights, "id").select("band", "block", "visit", "id", "e", "c").repartition("band", "block")
    both = both.sortWithinPartitions("band", "block", "visit", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, rows, index = None, [], None
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(["band", "block"], sort=False):
                if key != unit:
                    unit, rows, index = key, [], None
                own, other = part[part["visit"] == 0], part[part["visit"] == 1]
                rows += list(zip(own["id"], own["e"], own["c"]))
                if len(other):
                    index = index or _Postings(rows)
                    out += index.links(other, threshold)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.mapInPandas(lean(run), "a long, b long")


class _Postings:
    """Held texts by element, to count what a text shares with each of them."""

    def __init__(self, rows: list[tuple]):
        sets = [_unpack(e, c) for _, e, c in rows]
        self.ids = np.array([i for i, _, _ in rows], np.int64)
        self.size = np.array([c.sum() for _, c in sets])
        x = np.concatenate([e for e, _ in sets])
        order = np.argsort(x, kind="stable")
        self.rows = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])[order]
        self.weights = np.concatenate([c for _, c in sets])[order]
        self.elements, self.first = np.unique(x[order], return_index=True)
        self.first = np.append(self.first, len(x))

    def links(self, guests: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
        mask = np.zeros((len(self.ids), len(guests)), bool)
        for k, (e, c) in enumerate(zip(guests["e"], guests["c"])):
            x, w = _unpack(e, c)
            at = np.searchsorted(self.elements, x)
            known = (at < len(self.elements)) & (self.elements[np.minimum(at, len(self.elements) - 1)] == x)
            at = at[known]
            n = self.first[at + 1] - self.first[at]
            where = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
            both = np.bincount(self.rows[where], weights=np.minimum(self.weights[where], np.repeat(w[known], n)), minlength=len(self.ids))
            mask[:, k] = both >= (threshold - 1e-12) * (self.size + w.sum() - both)
        ids = guests["id"].to_numpy()
        la, lb = forest(mask, self.ids, ids)
        pairs = {(int(a), int(b)) for i, r in ((self.ids, la), (ids, lb)) for a, b in zip(i, r) if a != b}
        return sorted(pairs)


def _elements(d: DataFrame, buckets: DataFrame) -> DataFrame:
    """Shingle sets of the texts that share a bucket."""
    ids = table(buckets.select(F.col("rep").alias("id")).distinct(), "candidates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo: lo + 256]
                packed = [_pack(shingles(t)) for t in part["t"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "e": [p[0] for p in packed], "c": [p[1] for p in packed]})

    return table(d.join(small(ids, ids.count()), "id", "left_semi").where(F.col("t").rlike("[^ \\t-\\r]")).mapInPandas(lean(run), "id long, e binary, c binary"), "shingles")


def _verify(pairs: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity reaches the threshold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [similarity(_unpack(ea, ca), _unpack(eb, cb)) >= threshold - 1e-12
                  for ea, ca, eb, cb in zip(pdf["ea"], pdf["ca"], pdf["eb"], pdf["cb"])]
            yield pdf.loc[ok, ["a", "b"]]

    left = weights.select(F.col("id").alias("a"), F.col("e").alias("ea"), F.col("c").alias("ca"))
    right = weights.select(F.col("id").alias("b"), F.col("e").alias("eb"), F.col("c").alias("cb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "ca", "eb", "cb").mapInPandas(lean(run), "a long, b long")
