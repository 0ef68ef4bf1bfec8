"""Suffix-array dedup (operator 1): bytes covered by a string of ``length`` bytes that also starts elsewhere.

The suffix array is built by linear grouping (:func:`suffix_order`): suffixes are grouped by their
Lyndon prefixes, groups are processed in descending order with previous-smaller pointers, and a second
pass emits each group's order; nothing is renamed or sorted again.

One suffix array of a corpus does not fit a task, so suffixes are dealt out first, by content:

1. Each window (string of ``length`` bytes) has an anchor: of its ``gram``-byte grams, the one with the
   least hash, the first of equal ones. Equal windows have equal anchors at equal places, so they can
   only meet in the group of that anchor. Neighbouring windows share anchors; such a run is one row
   (anchor, hash of the run's whole context), about one row in 150 bytes. All texts take part, whole.
2. Contexts that are equal byte for byte are counted before anything is grouped, so copies of any
   number are one context. An anchor with one occurrence has no repeat; one with a single distinct
   context repeats as a whole. Only anchors with two or more distinct contexts need their texts.
3. The contexts of such a group are aligned at the anchor. Neighbouring columns that split the contexts
   into the same classes are one symbol, which keeps every equality of substrings; the suffix array of
   all contexts, with its common-prefix lengths, then tells for every window whether another one in
   the group is equal. Groups of more than ``max_group`` distinct contexts (a third of a corpus
   as edited copies) don't go to one task: their windows are counted by hash instead, exactly the same
   test with partial sums.
4. The windows found are joined back to their documents, and covered bytes are cut out.

Strings are judged on the input. Null text: empty. Texts shorter than ``length`` keep all. Rows with
equal id and text are documents of their own for counting (each repeats the other) and have equal
answers. Null ids are kept. Empty table: empty. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import lean, mix, powers, prefix_hash, small_lists, table, text_batches

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
SEGMENT = 1 << 20
RUN = "k long, h long, s long, span int, off int, a long, c long"


def suffix_order(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol is its only least one, by linear grouping."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, place, end = [0] * n, [0] * n, [0] * (n + 1)
    first = 0
    for i, p in enumerate(order):
        if text[p] != text[order[first]]:
            end[first] = i
            first = i
        group[p], place[p] = first, i
    end[first] = n
    smaller = [-1] * n  # the last position before with a lower group
    top = n
    while top:
        g = group[order[top - 1]]
        members = order[g:top]
        if len(members) > 1:
            members.sort()
        top = g
        hits: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        # positions followed by more of these prefixes are greater: they leave their group first, to its end
        by_count: dict[int, list[int]] = {}
        for p, c in hits.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[c]:
                moved.setdefault(group[p], []).append(p)
            for old, ps in moved.items():
                stop = e = end[old]
                for p in ps:
                    e -= 1
                    q, at = order[e], place[p]
                    order[at], place[q] = q, at
                    order[e], place[p] = p, e
                end[old] = e
                end[e] = stop
                for p in ps:
                    group[p] = e
    out = [-1] * n
    front = list(range(n))
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            done[p] = True
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            p = smaller[p]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each position the longest prefix it shares with a neighbour in the suffix array."""
    n = len(text)
    rank = [0] * n
    for i, p in enumerate(order):
        rank[p] = i
    best, k = [0] * n, 0
    for p in range(n):
        r = rank[p]
        if r == 0:
            k = 0
            continue
        q = order[r - 1]
        while p + k < n and q + k < n and text[p + k] == text[q + k]:
            k += 1
        if k > best[p]:
            best[p] = k
        if k > best[q]:
            best[q] = k
        k = max(0, k - 1)
    return best


def _column_classes(m: np.ndarray) -> np.ndarray:
    """Each cell's class in its column: the first row with the same value."""
    order = np.argsort(m, axis=0, kind="stable")
    v = np.take_along_axis(m, order, 0)
    head = np.ones(m.shape, bool)
    head[1:] = v[1:] != v[:-1]
    at = np.maximum.accumulate(np.where(head, np.arange(len(m))[:, None], 0), axis=0)
    out = np.empty(m.shape, np.int64)
    np.put_along_axis(out, order, np.take_along_axis(order, at, 0), 0)
    return out


def repeated_windows(contexts: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each context (bytes, place of the anchor, last window) which of its windows 0..last equal an
    aligned window of another context of the group."""
    left = max(off for _, off, _ in contexts)
    width = left + max(len(b) - off for b, off, _ in contexts)
    m = np.repeat(256 + np.arange(len(contexts))[:, None], width, 1)
    for i, (b, off, _) in enumerate(contexts):
        m[i, left - off: left - off + len(b)] = np.frombuffer(b, np.uint8)
    cls = _column_classes(m)
    cut = np.r_[True, (cls[:, 1:] != cls[:, :-1]).any(0)]
    run = np.cumsum(cut) - 1
    run_end = np.append(np.flatnonzero(cut)[1:], width)
    text: list[int] = []
    at = []
    n = len(contexts)
    short = cls[:, cut] + np.arange(len(run_end))[None, :] * n + n + 1
    for i, (b, off, _) in enumerate(contexts):
        lo, hi = run[left - off], run[left - off + len(b) - 1]
        at.append((len(text), lo, hi))
        text += short[i, lo: hi + 1].tolist()
        text.append(i + 1)
    text.append(0)
    best = np.array(common_prefixes(text, suffix_order(text)))
    out = []
    for (b, off, last), (t, lo, hi) in zip(contexts, at):
        same = best[t: t + hi - lo + 1]
        runs = np.arange(lo, hi + 1)
        reach = np.where(same > 0, run_end[runs + np.maximum(same, 1) - 1], 0)
        col = left - off + np.arange(last + 1)
        out.append(reach[run[col] - lo] >= col + length)
    return out


def anchor_runs(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``b`` that share an anchor: first window, last minus first, anchor minus first,
    hash of the anchor's gram, hash of the context."""
    out = []
    p, inv = prefix_hash(b), powers(len(b) + 1)[1]
    w = length - gram + 1
    for lo in range(0, len(b) - length + 1, SEGMENT):
        hi = min(lo + SEGMENT, len(b) - length + 1)  # windows lo .. hi-1
        n = hi - lo + w - 1  # grams lo .. lo+n-1
        h = mix((p[lo + gram: lo + gram + n] - p[lo: lo + n]) * inv[lo: lo + n])
        x = (h & ~_LOW) | np.arange(n, dtype=np.uint64)  # the least hash, the first of equal ones
        rows = -(-n // w)
        pad = np.full(rows * w, np.iinfo(np.uint64).max)
        pad[:n] = x
        pad = pad.reshape(rows, w)
        ahead = np.minimum.accumulate(pad, 1).ravel()
        behind = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: hi - lo], ahead[w - 1: w - 1 + hi - lo])
        s = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        e = np.append(s[1:], hi - lo) - 1
        pos = (least[s] & _LOW).astype(np.int64)
        ctx = (p[lo + e + length] - p[lo + s]) * inv[lo + s]
        tag = ((e - s) << 20 | (pos - s)).astype(np.uint64)
        out.append((lo + s, e - s, pos - s, h[pos], mix(mix(ctx) + tag * _ODD)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"),
                       F.xxhash64(t).alias("h"), t.cast("binary").alias("t"))


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 96, max_group: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans`` and the ``kept`` bytes."""
    text_batches(docs.sparkSession)
    src = _source(docs, text, key)
    found = repeated(src, length, gram, max_group)
    ranges = found.distinct().groupBy("k", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).toDF("rk", "rh", "ranges")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, rs in zip(pdf["id"], pdf["t"], pdf["ranges"]):
                rows.append((i, len(t), *_cut(t, rs, length)))
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])
            out["id"] = out["id"].astype("Int64")
            yield out

    d = src.join(ranges, (src["k"] == F.col("rk")) & (src["h"] == F.col("rh")), "left").select("id", "t", "ranges")
    d = d.mapInPandas(lean(cut), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return d.withColumnRenamed("id", key)


def _cut(t: bytes, ranges, length: int) -> tuple[int, int, bytes]:
    if ranges is None or not len(ranges):
        return 0, 0, t
    step = np.zeros(len(t) + 1, np.int32)
    np.add.at(step, [r["lo"] for r in ranges], 1)
    np.add.at(step, [r["hi"] + length for r in ranges], -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()


def repeated(src: DataFrame, length: int, gram: int, max_group: int) -> DataFrame:
    """Ranges (k, h, lo..hi) of windows that also stand elsewhere."""
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at: at + 128]
                part = part[part["t"].map(len) >= length]
                if not len(part):
                    continue
                got = [anchor_runs(np.frombuffer(t, np.uint8), length, gram) for t in part["t"]]
                n = [len(g[0]) for g in got]
                s, span, off, a, c = (np.concatenate(x) for x in zip(*got))
                yield pd.DataFrame({"k": np.repeat(part["k"].to_numpy(), n), "h": np.repeat(part["h"].to_numpy(), n), "s": s, "span": span,
                                    "off": off, "a": a.view(np.int64), "c": c.view(np.int64)})

    everything = table(src.select("k", "h", "t").mapInPandas(lean(runs), RUN), "anchors")
    often = everything.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    # written, as a join with an aggregate in its stage isn't split where one anchor has most rows
    often = table(often.select("a", (F.col("c0") != F.col("c1")).alias("mixed")), "anchor-counts")
    seen = table(everything.join(often, "a"), "repeated-anchors")
    contexts = seen.groupBy("a", "c", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "s", "span", "off")).alias("x"))
    contexts = table(contexts.select("a", "c", "mixed", "n", "x.*"), "contexts")
    whole = contexts.where("n > 1").select("a", "c", F.lit(0).alias("from"), F.col("span").alias("to"))
    parts = _mixed(src, contexts.where("mixed"), length, max_group)
    spans = table(whole.union(parts), "window-ranges")
    return seen.join(spans, ["a", "c"]).select("k", "h", (F.col("s") + F.col("from")).alias("lo"), (F.col("s") + F.col("to")).alias("hi"))


def _mixed(src: DataFrame, contexts: DataFrame, length: int, max_group: int) -> DataFrame:
    """Ranges (a, c, from..to) of repeated windows of contexts that stand once, in anchors with several contexts."""
    size = contexts.groupBy("a").agg(F.count("*").alias("m"))
    wanted = contexts.join(size, "a").groupBy("k", "h").agg(F.collect_list(F.struct("a", "c", "s", "span", "off", "n", "m")).alias("xs"))
    wanted = table(wanted, "wanted-contexts")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(x["a"], x["c"], x["n"], x["m"], x["off"], x["span"], t[x["s"]: x["s"] + x["span"] + length])
                    for t, xs in zip(pdf["t"], pdf["xs"]) for x in xs]
            for lo in range(0, len(rows), 5000):
                yield pd.DataFrame(rows[lo: lo + 5000], columns=["a", "c", "n", "m", "off", "span", "b"])

    # one of repeated rows: the others have the same contexts
    got = src.select("k", "h", "t").join(small_lists(wanted, "xs", 72), ["k", "h"]).dropDuplicates(["k", "h"]).mapInPandas(lean(fetch), "a long, c long, n long, m long, off int, span int, b binary")
    got = table(got, "context-bytes")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, anchor, done = [], None, []
        for pdf in batches:
            for row in zip(pdf["a"], pdf["c"], pdf["n"], pdf["b"], pdf["off"], pdf["span"]):
                if row[0] != anchor:
                    done += _group(held, length)
                    held, anchor = [], row[0]
                held.append(row)
            if len(done) > 2000:
                yield _frame(done)
                done = []
        yield _frame(done + _group(held, length))

    groups = got.where(F.col("m") <= max_group).repartition("a").sortWithinPartitions("a", "c")
    out = groups.mapInPandas(lean(sort), "a long, c long, from int, to int")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, c, n, b, off, span in zip(pdf["a"], pdf["c"], pdf["n"], pdf["b"], pdf["off"], pdf["span"]):
                b = np.frombuffer(b, np.uint8)
                p, inv = prefix_hash(b), powers(len(b) + 1)[1]
                i = np.arange(span + 1)
                x = mix(mix((p[i + length] - p[i]) * inv[i]) + (off - i).astype(np.uint64) * _ODD + np.uint64(a & (2**64 - 1)))
                yield pd.DataFrame({"a": a, "c": c, "n": n, "i": i, "w": x.view(np.int64)})

    big = got.where(F.col("m") > max_group).mapInPandas(lean(windows), "a long, c long, n long, i int, w long")
    big = table(big, "windows")
    # the window's hash has the anchor in it, so a hot anchor's windows are spread
    twice = big.groupBy("w").agg(F.count("*").alias("d")).where("d > 1")
    more = big.where("n = 1").join(twice, "w", "left_semi").select("a", "c", F.col("i").alias("from"), F.col("i").alias("to"))
    return out.union(more)


def _group(held: list[tuple], length: int) -> list[tuple]:
    """Ranges of the contexts of one anchor; those that stand more than once are known already."""
    if len(held) < 2:
        return []
    out = []
    for (a, c, n, *_), hit in zip(held, repeated_windows([(b, off, span) for _, _, _, b, off, span in held], length)):
        if n == 1 and hit.any():
            edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
            out += [(a, c, int(i), int(j) - 1) for i, j in zip(edge[::2], edge[1::2])]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["a", "c", "from", "to"])
