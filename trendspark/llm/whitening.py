"""Embedding whitening (operator 12): FEAST contour integration.

Each vector's entries become integers floor(scale * c). Mean and covariance (divisor n) are those of the distinct
integer vectors; sums are exact, products are centred before they are made and added up by task. The eigenpairs
of the covariance (dimension x dimension, the only thing that reaches the driver) with the largest eigenvalues come from
FEAST: inertia counts (signs of a symmetric factorisation of V - s I) bracket the wanted eigenvalues and cut
their range into intervals with at most ``per_slice`` of them; for each interval, Gauss-Legendre quadrature of the
complex shifted solves (z I - V)^-1 Y on a circle about the interval projects a block of vectors onto its
eigenspace; Rayleigh-Ritz extracts the eigenpairs, and the block is projected again until their residuals are at
rounding level. The number found must equal the interval's inertia count, else the block grows; at full size it is
the whole space, so none can be missed.

A row's whitened values are its centred vector times each component over the root of its eigenvalue. Their
covariance over the distinct vectors is computed by a further pass and compared with the identity.

Null vectors and those with a null or non-finite entry are dropped, and vectors of another length than the
commonest (ties: the longest), empty ones included, as they have no place in a covariance. Entries beyond a 64-bit
integer are taken at its border. Null and repeated ids stay; equal vectors count once for the fit and get equal
answers. Components without variance (eigenvalue at most 1e-12 of the trace) aren't returned: a table with one
distinct vector gives no row. A deviation beyond a long is null. Extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import table

#: least eigenvalue of a component, as a share of the trace
NO_VARIANCE = 1e-12


# ---- eigenpairs of a symmetric matrix by contour integration


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of symmetric ``a`` exceed ``shift``: positive pivots of a factorisation with 1x1 and 2x2
    pivots of greatest size (Bunch-Parlett)."""
    b = a - shift * np.eye(len(a))
    above, alpha = 0, (1 + 17 ** 0.5) / 8
    while len(b):
        d = np.abs(np.diag(b))
        r = int(d.argmax())
        off = np.abs(b - np.diag(np.diag(b)))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if d[r] == 0 and off[i, j] == 0:
            break  # the rest is zero: eigenvalues at the shift
        if d[r] >= alpha * off[i, j]:
            take = [r]
            above += b[r, r] > 0
        else:
            take = [int(i), int(j)]
            above += 1  # such a block has one positive and one negative eigenvalue
        rest = np.delete(np.arange(len(b)), take)
        c = b[np.ix_(rest, take)]
        b = b[np.ix_(rest, rest)] - c @ np.linalg.solve(b[np.ix_(take, take)], c.T)
        b = (b + b.T) / 2
    return int(above)


def slices(a: np.ndarray, k: int, per_slice: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count), from the top, that hold the ``k`` largest eigenvalues (or more, where some
    beside the border are equal), each at most ``per_slice`` of them unless equal ones are more. Borders
    lie in gaps of the spectrum. ``a`` is scaled to trace 1."""
    n, tiny = len(a), 1e-13
    top = float(np.abs(a).sum(1).max()) * (1 + 1e-9) + tiny

    def border(count: int, high: float) -> tuple[float, int]:
        """A border below ``high`` with ``count`` eigenvalues or a few more above it."""
        if count >= n:
            return -top, n
        low, up = -tiny, high  # bisect to the place of eigenvalue number ``count``
        while up - low > tiny + 1e-5 * abs(up):
            mid = (low + up) / 2
            low, up = (mid, up) if inertia(a, mid) >= count else (low, mid)
        above = max(count, inertia(a, low))
        if above >= n:
            return -top, n
        bottom, ceiling = -top, low  # and to the next one below, for the middle of the gap
        while ceiling - bottom > tiny + 1e-5 * abs(ceiling):
            mid = (bottom + ceiling) / 2
            bottom, ceiling = (mid, ceiling) if inertia(a, mid) > above else (bottom, mid)
        return (low + ceiling) / 2, above

    out, high, done = [], top, 0
    while done < min(k, n):
        low, above = border(min(k, n, done + per_slice), high)
        out.append((low, high, above - done))
        high, done = low, above
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, points: int = 16, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of symmetric ``a`` with eigenvalues in (low, high], largest first."""
    n, rng = len(a), np.random.default_rng(seed)
    centre, radius = (low + high) / 2, (high - low) / 2
    node, weight = np.polynomial.legendre.leggauss(points)
    angle = np.pi * (node + 1) / 2  # the upper half circle; the lower one is its conjugate
    z = centre + radius * np.exp(1j * angle)
    weight = weight * radius * np.exp(1j * angle) / 2
    size = min(n, max(2 * count, count + 8))
    norm = max(np.abs(a).sum(1).max(), 1e-300)
    while True:
        y = rng.standard_normal((n, size))
        best = None
        for _ in range(12):
            q = sum((w * np.linalg.solve(p * np.eye(n) - a, y)).real for w, p in zip(weight, z)) if size < n else y
            q, _ = np.linalg.qr(q)
            value, u = np.linalg.eigh(q.T @ a @ q)  # Rayleigh-Ritz
            x = q @ u
            inside = np.flatnonzero((value > low) & (value <= high))[::-1]
            if len(inside) == count:
                err = np.linalg.norm(a @ x[:, inside] - x[:, inside] * value[inside], axis=0).max() / norm
                if best is not None and err > best[0] / 2 and err < 1e-12:
                    break  # no longer falls: rounding level
                if best is None or err < best[0]:
                    best = (err, value[inside], x[:, inside])
                if err < 1e-16:
                    break
            y = x
            if size == n:
                break
        if best is not None and (best[0] < 1e-12 or size == n):
            return best[1], best[2]
        if size == n:
            raise ArithmeticError(f"{len(inside)} eigenpairs found where the inertia says {count}")
        size = min(n, 2 * size)


def top_eigenpairs(a: np.ndarray, k: int, per_slice: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of positive semidefinite ``a``, and their unit eigenvectors as columns."""
    trace = float(np.trace(a))
    if not len(a) or trace <= 0:
        return np.zeros(0), np.zeros((len(a), 0))
    got = [feast(a / trace, *s) for s in slices(a / trace, k, per_slice)]
    value, x = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got], axis=1)
    use = np.flatnonzero(value[:k] > NO_VARIANCE)
    return value[use] * trace, x[:, use]


# ---- Spark


@dataclass
class Model:
    """``n`` distinct vectors, their exact ``sums``, ``components`` as columns, their ``values`` (falling), the trace of the
    covariance, and the largest departure of the whitened covariance from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # of exact integers, rounded once

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)


def usable(vectors: DataFrame, vec: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows whose vector has only finite entries, with ``_x``, the integer vector."""
    v = F.transform(F.col(vec), lambda c: c.cast("double"))
    d = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    top = float(2 ** 63 - 1024)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), c * F.lit(scale)))).cast("long"))
    return d.withColumn("_x", x)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a dimension and task: the exact sum of the task's entries."""
    total = None
    for pdf in batches:
        x = _matrix(pdf["x"])
        if len(x):
            big = int(np.abs(x.astype(float)).max()) * len(x) >= 1 << 62
            s = [int(v) for v in (x.astype(object) if big else x).sum(0)]
            total = s if total is None else [a + b for a, b in zip(total, s)]
    if total is not None:
        yield pd.DataFrame({"i": range(len(total)), "s": [str(v) for v in total]})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _added(d: DataFrame, block, width: int) -> np.ndarray:
    """The sum over all tasks of ``block``(integer matrix), a width x width matrix; products are added by task, then cell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                total += block(_matrix(pdf["x"]))
        yield pd.DataFrame({"i": range(width), "c": list(total)})

    parts = d.mapInPandas(run, "i int, c array<double>").select("i", F.posexplode("c").alias("j", "c"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # width squared rows
        out[r["i"], r["j"]] = r["c"]
    return (out + out.T) / 2


def fit(rows: DataFrame, components: int = 4, per_slice: int = 16) -> Model | None:
    """From rows of :func:`usable`; None if there are none."""
    x = table(rows.select(F.col("_x").alias("x")).distinct(), "whitening-fit")
    sizes = {r["size"]: r["n"] for r in x.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size"))
             .limit(1).collect()}
    if not sizes:
        return None
    (width, n), = sizes.items()
    x = x.where(F.size("x") == width)
    whole = x.mapInPandas(_sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(whole.collect(), key=lambda r: r["i"])]  # width rows
    mean = np.array([s / n for s in sums])

    def covariance(m: np.ndarray) -> np.ndarray:
        c = m - mean
        return c.T @ c

    v = _added(x, covariance, width) / n
    values, vectors = top_eigenpairs(v, components, per_slice)
    model = Model(n, sums, vectors, values, float(np.trace(v)))
    if len(values):
        model.identity_error = _identity_error(x, model)
    return model


def _identity_error(x: DataFrame, model: Model) -> float:
    """Covariance of the whitened values over the fit list, centred by their mean first, against the identity."""
    k = len(model.values)

    def total(m: np.ndarray) -> np.ndarray:
        return np.diag(model.project(m).sum(0))

    mean = np.diag(_added(x, total, k)) / model.n

    def covariance(m: np.ndarray) -> np.ndarray:
        w = model.project(m) - mean
        return w.T @ w

    return float(np.abs(_added(x, covariance, k) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = 4, scale: float = 256.0,
           per_slice: int = 16) -> DataFrame:
    """One row a usable vector: ``key``, n, deviation, whitened (array, a value for each component), explained (array),
    identity_error."""
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(key), F.col(vec).alias("_v")), "_v", scale)
    model = fit(rows, components, per_slice)
    kind = vectors.schema[key].dataType.simpleString()
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"`{key}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, "
                                         "identity_error double")
    width, n = len(model.sums), model.n
    sums = np.array(model.sums, dtype=object)
    fits = all(abs(s) < 1 << 62 for s in model.sums)

    def deviation(x: np.ndarray) -> list[int | None]:
        reach = max((abs(int(v)) for v in (x.max(), x.min())), default=0) * n + max(abs(s) for s in model.sums)
        if fits and width * reach * reach < 1 << 62:
            d = x * n - sums.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * n - sums
        return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:  # Arrow, as ids pass unchanged
            if rb.num_rows:
                x = rb.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                white = pa.array(list(model.project(x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rb.column("row"), pa.array(deviation(x), pa.int64()), white], names=["row", "deviation", "whitened"])

    d = rows.where(F.size("_x") == width).select(F.col(key).alias("row"), F.col("_x").alias("x"))
    d = d.mapInArrow(run, T.StructType([d.schema["row"], *T._parse_datatype_string("deviation long, whitened array<double>").fields]))
    return d.select(F.col("row").alias(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.array(*[F.lit(float(e / model.trace)) for e in model.values]).alias("explained"),
                    F.lit(model.identity_error).alias("identity_error"))
