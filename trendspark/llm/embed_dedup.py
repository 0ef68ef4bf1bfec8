"""Embedding near-dedup (operator 2): exact metric range join.

On unit vectors cosine >= c means distance <= eps = sqrt(2 - 2c). Pivots (a bounded sample, thinned
to directions at least eps / 2 apart) partition the vectors by nearest pivot; a cell has two parts.

* Its core lies within eps / 2 of the pivot. By the triangle inequality all of a core link with each other, so
  those links are counted by summed weights, and each member has one edge to the core's smallest id: no products
  and no copies of rows, however many near copies a core holds.
* The rest is its rim. Rims are compared with each other. Neighbouring cells form groups (second level: the nearest of
  fewer pivots), and a rim vector goes once to another group if some rim there can hold a partner: it must lie
  within eps of the face between the two pivots, (d(v,q)^2 - d(v,p)^2) / (2 d(p,q)) <= eps (which the triangle
  inequality implies the weaker d(v,q) - d(v,p) <= 2 eps of), and within eps of the rim's covering ball,
  d(v,q) <= radius(q) + eps. Of two groups (and of two cores) one is the place of their pairs, so a pair is found once.
* A vector outside a core goes to it only if it is within 3 eps / 2 of its pivot.

A part or group is held in blocks of as many vectors as ``BLOCK_BYTES`` hold, and the vectors that visit it
stream past in batches, so memory does not grow with the data.

Equal vectors are one weighted vector before the join. A block returns link counts and, instead of
links, the edges of a spanning forest of the links of each batch (each vector to the smallest id it
reaches there), so output is linear; components are then found over those edges.

Products are taken in single precision and those near the threshold again in double. Null, zero and
non-finite vectors (or null or non-finite components) link with nothing: n_links 0, a component of
their own, kept. So does a vector of another length than its partners (no cosine). Rows with equal
vec_id count as that many vectors and are one in the answer. Null ids are left out. Empty table: empty. Extra columns are not read.

Isotropic vectors defeat any pivot bound (distances concentrate), and then a rim vector visits most groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import components, lean, new_path, small, table

ROW = "unit int, visit int, id long, w long, v binary"
LINK = "id long, links long, root long"
#: least distance of two pivots; rounding of a squared distance (some 1e-15) over it stays far below the slack of ``eps``
APART = 1e-4
#: more than the rounding of a squared distance, for radii
ROUNDING = 1e-13
#: bytes of the vectors of a held block
BLOCK_BYTES = 16 << 20
#: vectors of one length up to which they are one unit; cells of the pivots beyond
SHORT = 4096
#: products of one matrix, for the memory of a task
PRODUCTS = 4 << 20


def _target(i: np.ndarray, j: int | np.ndarray) -> np.ndarray:
    """Of two cells, the one where their pairs are found; spreads them evenly."""
    return np.where((i + j) % 2 == 0, np.minimum(i, j), np.maximum(i, j))


def _normal(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _thin(pivots: np.ndarray, apart: float = APART) -> np.ndarray:
    """``pivots`` without those nearer than ``apart`` to an earlier one that stays."""
    near = 2 - 2 * pivots @ pivots.T < apart ** 2
    stay = np.zeros(len(pivots), bool)
    for i in range(len(pivots)):
        stay[i] = not (near[i] & stay).any()
    return pivots[stay]


def unit_classes(vectors: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """(id, class) of every usable row; (class, weight, vector) of every distinct vector."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    ok = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"), ok.alias("ok"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.where("ok").withColumn("n2", norm).where((F.col("n2") > 0) & (F.col("n2") < float("inf")))
    # adding 0.0 turns -0.0 into 0.0, so that equal vectors are equal bytes
    rows = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = table(rows.groupBy("v").agg(F.min("id").alias("class"), F.count("*").alias("w")).select("class", "w", "v"), "vec-classes")
    return rows, classes


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vec: str = "embedding", target: int = 1024,
                 max_pivots: int = 1024, block: int | None = None) -> DataFrame:
    """One row per id: ``n_links``, ``component_id`` (smallest id reachable), ``kept``. ``target``: vectors for each pivot;
    ``block``: vectors of a held block (by default as many as ``BLOCK_BYTES`` hold)."""
    rows, classes = unit_classes(vectors, key, vec)
    n = classes.count()
    ids = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    if n == 0:
        return ids.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    m = int(min(max_pivots, max(8, -(-n // target))))
    # one cosine space for each length; at most one length for each ``block`` or ``SHORT`` vectors, or ``BLOCK_BYTES``, is a long one
    limit = F.lit(block) if block else F.least(F.lit(SHORT), F.floor(BLOCK_BYTES / (8 * F.col("d"))))
    long_ = [r["d"] for r in classes.groupBy(F.size("v").alias("d")).count().where(F.col("count") > limit).collect()]
    rest = classes.where(~F.size("v").isin(long_)) if long_ else classes
    path = new_path(vectors.sparkSession, "vec-links")
    _join_short(rest, cosine).write.parquet(path)
    for dim in long_:
        own = classes.where(F.size("v") == dim)
        pivots = np.array([r["v"] for r in own.orderBy(F.xxhash64("class")).limit(m).collect()])  # at most max_pivots rows
        _join(own, _thin(_normal(pivots), max(APART, eps / 2)), cosine, eps, block or max(256, BLOCK_BYTES // (8 * dim))).write.mode("append").parquet(path)
    found_rows = vectors.sparkSession.read.schema(LINK).parquet(path)
    links = found_rows.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found_rows.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = (classes.join(links, classes["class"] == links["id"], "left").join(comp.withColumnRenamed("id", "cid"), classes["class"] == F.col("cid"), "left")
           .select("v", F.col("class"), "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component")))
    one = rows.withColumn("h", F.xxhash64("v")).join(per.withColumn("h", F.xxhash64("v")).withColumnRenamed("v", "pv"), "h").where("v = pv")
    one = one.groupBy("id").agg(F.max(F.col("links") + F.col("w") - 1).alias("n"), F.min("component").alias("component"))
    d = ids.join(one, "id", "left")
    comp_id = F.coalesce("component", "id")
    return d.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                    (F.col("id") == comp_id).alias("kept"))


def _join(classes: DataFrame, pivots: np.ndarray, cosine: float, eps: float, block: int) -> DataFrame:
    """(id, links, root): partial link counts of distinct vectors and forest edges (root null: none)."""
    m = len(pivots)
    pp = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, APART ** 2 / 2))
    # far enough below eps / 2 that rounding can't make a pair of a core miss the threshold
    core_d2 = max(eps / 2 - 1e-6, 0.0) ** 2

    def nearest(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        v = _normal(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        d2 = np.maximum(2 - 2 * v @ pivots.T, 0)
        c = d2.argmin(1)
        return v, d2, c, d2[np.arange(len(c)), c]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for at in range(0, len(big), 2048):
                pdf = big.iloc[at: at + 2048]
                _, _, c, own = nearest(pdf)
                yield pd.DataFrame({"id": pdf["class"], "w": pdf["w"], "cell": c, "d2": own, "core": own <= core_d2})

    placed = table(classes.mapInPandas(lean(cells), "id long, w long, cell int, d2 double, core boolean"), "vec-cells")
    stat = table(placed.groupBy("cell", "core").agg(F.max("d2").alias("r"), F.count("*").alias("n"), F.sum("w").alias("all"), F.min("id").alias("least")),
                 "vec-parts")  # at most two rows for each pivot
    radius = np.full(m, -np.inf)
    rim, core = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for r in stat.collect():
        if r["core"]:
            core[r["cell"]] = r["n"]
        else:
            radius[r["cell"]], rim[r["cell"]] = np.sqrt(r["r"] + ROUNDING), r["n"]
    per = max(1, block // 2)
    n_groups = int(min(m, max(8, -(-rim.sum() // per))))
    group = pp[:, :n_groups].argmin(1)
    group[:n_groups] = np.arange(n_groups)
    by_group = np.argsort(group, kind="stable")
    start = np.searchsorted(group[by_group], np.arange(n_groups))
    rim_blocks = np.maximum(1, -(-np.bincount(group, weights=rim, minlength=n_groups).astype(np.int64) // per))
    core_blocks = np.maximum(1, -(-core // per))
    rim_first = np.r_[0, np.cumsum(rim_blocks)]
    core_first = rim_first[-1] + np.r_[0, np.cumsum(core_blocks)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for at in range(0, len(big), 2048):
                pdf = big.iloc[at: at + 2048]
                v, d2, c, own = nearest(pdf)
                me, is_core = np.arange(len(c)), own <= core_d2
                ids, w = pdf["class"].to_numpy(), pdf["w"].to_numpy()
                g, salt = group[c], ids * 2654435761 >> 7
                sub = salt % np.where(is_core, core_blocks[c], rim_blocks[g])
                units, visits, who = [np.where(is_core, core_first[c], rim_first[g]) + sub], [np.zeros(len(c), np.int64)], [me]

                def visit(first, i):
                    units.append(first)
                    visits.append(np.ones(len(i), np.int64))
                    who.append(i)

                meets = ((d2 - own[:, None]) / (2 * pp[c]) <= eps) & (np.sqrt(d2) <= radius[None, :] + eps) & ~is_core[:, None]
                goes = np.logical_or.reduceat(meets[:, by_group], start, axis=1)
                goes &= _target(np.arange(n_groups)[None, :], g[:, None]) == np.arange(n_groups)[None, :]
                goes[me, g] = False
                for b in range(int(rim_blocks.max())):
                    i, j = np.nonzero(goes & (rim_blocks > b)[None, :])
                    visit(rim_first[j] + b, i)
                    i = np.flatnonzero(~is_core & (sub > b))  # other blocks of the own group
                    visit(rim_first[g[i]] + b, i)
                near = (np.sqrt(d2) <= 1.5 * eps + 1e-6) & (core > 0)[None, :]
                near &= ~is_core[:, None] | (_target(np.arange(m)[None, :], c[:, None]) == np.arange(m)[None, :])
                near[me[is_core], c[is_core]] = False  # counted by weight
                for b in range(int(core_blocks.max())):
                    i, j = np.nonzero(near & (core_blocks > b)[None, :])
                    visit(core_first[j] + b, i)
                who = np.concatenate(who)
                raw = [x.tobytes() for x in v]
                yield pd.DataFrame({"unit": np.concatenate(units), "visit": np.concatenate(visits), "id": ids[who], "w": w[who],
                                    "v": [raw[k] for k in who]})

    whole = stat.where("core and n > 1").select("cell", "all", "least")
    inside = placed.where("core").join(small(whole, 2 * m), "cell").select("id", (F.col("all") - F.col("w")).alias("links"), F.col("least").alias("root"))
    return _in_units(classes.mapInPandas(lean(deal), ROW), cosine, int(core_first[0])).unionByName(inside)


def _join_short(classes: DataFrame, cosine: float) -> DataFrame:
    """As :func:`_join`, for lengths of at most a block of vectors: each length is a unit, all in one job."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [_normal(np.asarray(x, np.float64)[None])[0].tobytes() for x in pdf["v"]]
            yield pd.DataFrame({"unit": pdf["v"].map(len), "visit": 0, "id": pdf["class"], "w": pdf["w"], "v": v})

    return _in_units(classes.mapInPandas(lean(deal), ROW), cosine)


def _in_units(dealt: DataFrame, cosine: float, first_core: int = 1 << 31) -> DataFrame:
    """Links of the vectors of each unit, unless it is of a core (``first_core`` on), and of those that visit it."""
    def held_links(unit: int, rows) -> pd.DataFrame:
        return _within(rows if unit < first_core else (rows[0][:0], rows[1][:0], rows[2][:0]), cosine)

    def unit_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held, done = None, [], False
        for big in batches:
            for u, pdf in big.groupby("unit", sort=False):
                if u != unit:
                    if held and not done:
                        yield held_links(unit, _cat(held))
                    unit, held, done = u, [], False
                own = pdf[pdf["visit"] == 0]
                if len(own):
                    held.append(own)
                guests = pdf[pdf["visit"] == 1]
                if len(guests):
                    if not done:
                        block_rows, done = _cat(held), True
                        if block_rows is not None:
                            yield held_links(unit, block_rows)
                    if block_rows is not None:
                        for lo in range(0, len(guests), 4096):
                            yield _across(block_rows, _cat([guests.iloc[lo: lo + 4096]]), cosine)
        if held and not done:
            yield held_links(unit, _cat(held))

    dealt = dealt.repartition("unit").sortWithinPartitions("unit", "visit")
    return dealt.mapInPandas(lean(unit_join), LINK)


def _cat(parts: list[pd.DataFrame]):
    if not parts:
        return None
    v = np.frombuffer(b"".join(x for p in parts for x in p["v"]), np.float64)
    ids = np.concatenate([p["id"].to_numpy() for p in parts])
    return ids, np.concatenate([p["w"].to_numpy() for p in parts]), v.reshape(len(ids), -1)


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    s = a.astype(np.float32) @ b.astype(np.float32).T
    slack = 1e-5 + 1.2e-7 * a.shape[1]
    mask = s >= cosine - slack
    i, j = np.nonzero(mask)
    if len(i):
        close = s[i, j] < cosine + slack
        i, j = i[close], j[close]
        for lo in range(0, len(i), 1 << 16):
            x, y = i[lo: lo + (1 << 16)], j[lo: lo + (1 << 16)]
            mask[x, y] = (a[x] * b[y]).sum(1) >= cosine
    return mask


def forest(mask: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches over the links of ``mask``."""
    la, lb = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(mask, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(mask, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def _rows(ids, links, roots) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "links": links, "root": pd.array(roots, "Int64")})


def _within(block, cosine: float) -> pd.DataFrame:
    ids, w, v = block
    out = [_rows(ids[:0], w[:0], ids[:0])]
    step = max(64, PRODUCTS // max(1, len(ids)))
    for lo in range(0, len(ids), step):  # rows of the block against the rest of it
        hi = min(lo + step, len(ids))
        mask = _linked(v[lo:hi], v[lo:], cosine)
        mask[np.tril_indices(hi - lo, 0, len(ids) - lo)] = False
        out.append(_masked(mask, ids[lo:hi], w[lo:hi], ids[lo:], w[lo:]))
    return pd.concat(out)


def _across(block, guests, cosine: float) -> pd.DataFrame:
    ids, w, v = block
    gi, gw, gv = guests
    return pd.concat([_masked(_linked(v[lo: lo + 1024], gv, cosine), ids[lo: lo + 1024], w[lo: lo + 1024], gi, gw)
                      for lo in range(0, len(ids), 1024)])


def _masked(mask, ids_a, w_a, ids_b, w_b) -> pd.DataFrame:
    a, b = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    mask = mask[np.ix_(a, b)]
    if not len(a):
        return _rows(ids_a[:0], w_a[:0], ids_a[:0])
    la, lb = forest(mask, ids_a[a], ids_b[b])
    ids = np.concatenate([ids_a[a], ids_b[b]])
    return _rows(ids, np.concatenate([mask @ w_b[b], w_a[a] @ mask]), np.concatenate([la, lb]))
