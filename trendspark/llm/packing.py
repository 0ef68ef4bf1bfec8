"""Best-fit packing (operator 10): exact-complement hashing.

Texts become token pieces of at most ``capacity`` ids. Only the histogram of piece lengths (at most
``capacity`` rows) is planned: sums of one, two and three available lengths are indexed, and for each
length, longest first, a combination that fills its gap exactly is used as often as its counts allow.
What is left goes, longest first, into the open sequence with the least gap that holds it. The plan
says for each length which ranks go to which sequence and offset; ranks are numbered in parallel
(a count inside the task that encoded the piece plus a running total over tasks).

A longer document is cut so that all its pieces but the first are full. Null text: empty, which is
one piece with the end id alone. Repeated rows and equal ids are packed as rows of their own. Empty
table: no pieces. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import lean, small, table, text_batches
from trendspark.llm.token_files import bpe

PIECE = "doc_id long, piece int, start long, length long, tokens binary, part int, at long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text",
               key: str = "doc_id", most_units: int | None = None) -> DataFrame:
    """Encoded pieces, written to the shared folder. ``most_units`` bounds a worker's table of known units (it changes no
    id). ``at`` counts pieces of one length inside one task (``part``)."""
    text_batches(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        enc = bpe(tokenizer, most_units)
        for pdf in batches:
            ks = [None if pd.isna(x) else int(x) for x in pdf["k"]]
            texts = pdf["t"].tolist()
            for lo in range(0, len(texts), 256):
                rows = []
                for k, ids in zip(ks[lo: lo + 256], enc.encode(texts[lo: lo + 256])):
                    ids += end
                    n, a, p = len(ids) // 4, 0, 0
                    while a < n:
                        b = a + ((n - a - 1) % capacity + 1 if a == 0 else capacity)
                        rows.append((k, p, a, b - a, ids[4 * a: 4 * b], part, seen[b - a]))
                        seen[b - a] += 1
                        a, p = b, p + 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "tokens", "part", "at"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return table(d.mapInPandas(lean(run), PIECE), "pieces")


def plan(counts: dict[int, int], capacity: int = 1024) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence) and how often each is used; covers ``counts`` exactly."""
    have = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        have[n] = c
    out: list[tuple[list[int], int]] = [([capacity], int(have[capacity]))] if have[capacity] else []
    have[capacity] = 0
    rest: dict[int, int] = {}
    for first in range(capacity - 1, 0, -1):
        while have[first] > 0:
            combo = _exact(have, first, capacity - first)
            if combo is None:
                rest[first] = int(have[first])
                have[first] = 0
                break
            need: dict[int, int] = {}
            for n in [first, *combo]:
                need[n] = need.get(n, 0) + 1
            times = min(int(have[n]) // k for n, k in need.items())
            for n, k in need.items():
                have[n] -= times * k
            out.append(([first, *combo], times))
    return out + _best_fit(rest, capacity)


def _exact(have: np.ndarray, first: int, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap`` besides one piece of ``first``."""
    def left(n: int, *used: int) -> int:
        return int(have[n]) - (n == first) - sum(n == u for u in used)

    if left(gap) > 0:
        return [gap]
    there = have[: gap + 1] > 0
    if first <= gap and have[first] < 2:
        there[first] = False

    def pair(total: int, *used: int) -> list[int] | None:
        idx = np.flatnonzero(there[: total + 1])
        for a in idx[there[total - idx] & (idx >= total - idx)][::-1]:
            a, b = int(a), int(total - a)
            if left(a, *used) > 0 and left(b, a, *used) > 0:
                return [a, b]
        return None

    if found := pair(gap):
        return found
    mask = there[:gap].astype(np.float32)
    sums = np.rint(np.convolve(mask, mask))[: gap + 1] > 0 if gap > 1 else np.zeros(gap + 1, bool)  # sums of two
    for a in np.flatnonzero(there)[::-1]:
        a = int(a)
        if a < gap and sums[gap - a] and left(a) > 0 and (found := pair(gap - a, a)):
            return [a, *found]
    return None


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    open_: dict[int, list[tuple[list[int], int]]] = {}  # gap -> (pattern, how many such sequences)
    for n in sorted(rest, reverse=True):
        todo = rest[n]
        while todo:
            gap = min((g for g in open_ if g >= n and open_[g]), default=None)
            if gap is None:
                per = capacity // n
                for fit in ([per] if todo >= per else []) + ([todo % per] if todo % per else []):
                    times = todo // per if fit == per and todo >= per else 1
                    open_.setdefault(capacity - fit * n, []).append(([n] * fit, times))
                todo = 0
                break
            pattern, times = open_[gap].pop()
            used = min(todo, times)
            if used < times:
                open_[gap].append((pattern, times - used))
            open_.setdefault(gap - n, []).append(([*pattern, n], used))
            todo -= used
    return [x for g in open_.values() for x in g]


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of :func:`cut_pieces` (any further columns stay)."""
    spark = pieces.sparkSession
    counts = table(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, sequence of that rank, offset)
    used: dict[int, int] = {}
    base = 0
    for pattern, times in plan(hist, capacity):
        offset = 0
        for n in pattern:
            slots.setdefault(n, []).append((used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    assert used == hist
    look = {n: tuple(np.array(x, np.int64) for x in zip(*s)) for n, s in slots.items()}
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    d = pieces.join(small(before, counts.count()), ["length", "part"])
    d = d.withColumn("sequence_id", F.col("before") + F.col("at")).withColumn("offset", F.lit(0).cast("long")).drop("before", "part", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank, n = pdf["sequence_id"].to_numpy(), pdf["length"].to_numpy()
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for x in np.unique(n):
                first, start, offset = look[int(x)]
                at = n == x
                k = np.searchsorted(first, rank[at], "right") - 1
                seq[at], off[at] = start[k] + rank[at] - first[k], offset[k]
            yield pdf.assign(sequence_id=seq, offset=off)

    return d.mapInPandas(lean(run), d.schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, most_units: int | None = None) -> DataFrame:
    """Pieces with their ``tokens`` (little-endian unsigned 32-bit ids), ``sequence_id`` and ``offset``."""
    return place(cut_pieces(docs, tokenizer, capacity, end_id, most_units=most_units), capacity)
