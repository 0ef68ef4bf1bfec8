"""Operators 11 to 13 against brute force, held-out labels and odd inputs."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.llm import merkle, quality_fm, queries, whitening

SF = "/root/testdata/sf0.001"
SF_HELD = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- 11 factorisation machine


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    r = np.sort(rng.integers(0, 5, 60))
    r[:5] = np.arange(5)
    r.sort()
    i, x = rng.integers(0, 40, 60), rng.standard_normal(60)
    w, v = rng.standard_normal(40), rng.standard_normal((40, 3))
    got, _ = quality_fm._forward(r, i, x, 5, 0.3, w, v)
    for t in range(5):
        at = np.flatnonzero(r == t)
        want = 0.3 + (w[i[at]] * x[at]).sum() + sum(v[i[a]] @ v[i[b]] * x[a] * x[b] for a, b in itertools.combinations(at, 2))
        assert abs(want - got[t]) < 1e-9


def test_machine_learns_a_pair():
    """Labels that only an interaction can tell: 1 where both or none of two words are there."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 1200), rng.integers(0, 2, 1200)
    rows = [(np.array([3 + p, 7 + q], np.int64), np.array([0.7, 0.7])) for p, q in zip(a, b)]
    y = (a == b).astype(np.int64)
    m = quality_fm.train(rows, np.zeros((1200, 0)), y, epochs=30)
    f = m.margin(*quality_fm._packed(rows), np.zeros((1200, 0)))
    assert ((1 / (1 + np.exp(-(f + m.shift))) >= 0.7) == (y == 1)).all()


def test_features_of_whole_texts(monkeypatch):
    text = "The cat!! The cat, a|b # 12\nzwölf cat"
    (row, bucket, value, stats), = quality_fm.features([text, None, ""])
    s = dict(zip(quality_fm.STATS, stats[0]))
    n, size = len(text.split()), len(text.encode())
    assert s["log_words"] == np.log2(1 + n) and s["bangs_per_word"] == 2 / n and s["pipes_per_word"] == 1 / n and s["symbols_per_word"] == 1 / n
    assert s["lines_per_word"] == 1 / n and s["stops_per_word"] == 1 / n and s["digits_per_byte"] == 2 / size and s["other_bytes_per_byte"] == 2 / size
    assert s["words_without_letter"] == 2 / n and s["commonest_word"] == 2 / n and s["distinct_words"] == 8 / n and s["neighbour_repeats"] == 0
    assert abs((value * value).sum() - 1) < 1e-12 and set(row) == {0}
    assert stats[1][0] == 0 and np.isnan(stats[1][1:]).all()
    # the same in blocks of any size
    texts = [text * k for k in range(6)] + [None, "x " * 500]
    whole = [x for f in quality_fm.features(texts) for x in f[3].tolist()]
    monkeypatch.setattr(quality_fm, "CHUNK", 90)
    assert np.array_equal(np.array(whole), np.array([x for f in quality_fm.features(texts) for x in f[3].tolist()]), equal_nan=True)


def test_quality_classifier_held_out(spark):
    d = queries.op11_quality_classifier(spark, SF_HELD)
    assert d.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in d.collect()}
    docs = spark.read.parquet(f"{SF_HELD}/documents.parquet")
    assert set(got) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    wrong, total = [0, 0], [0, 0]
    for r in spark.read.parquet(f"{SF_HELD}/labels.parquet").collect():
        x = got[r["doc_id"]]
        assert x["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1
        assert x["predicted"] == (x["score"] >= 0.7)
        if x["held_out"]:
            total[r["quality"]] += 1
            wrong[r["quality"]] += x["predicted"] != r["quality"]
    assert wrong[0] <= 0.1 * total[0] and wrong[1] <= 0.05 * total[1] and min(total) > 10


def test_quality_classifier_odd(spark, docs, odd_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd_labels = labels.select("doc_id", "quality").union(spark.createDataFrame(
        [(None, 1), (0, None), (1, 1), (1, 0), (2, 7), (10**9, 0)], "doc_id long, quality int"))
    model = quality_fm.fit(docs, odd_labels, meta=("n_chars",), per_class=50)
    odd = odd_docs.withColumn("predicted", F.lit("x")).withColumn("big", F.lit(2**62 + 1))
    got = quality_fm.predict(odd, model, meta=("n_chars",)).collect()
    assert len(got) == odd.count() and {r["big"] for r in got} == {2**62 + 1}
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert quality_fm.predict(no_docs, model, meta=("n_chars",)).count() == 0
    for lab, want in ((odd_labels.limit(0), 0), (odd_labels.where("quality = 1"), 1)):
        m = quality_fm.fit(docs, lab)
        assert {r["predicted"] for r in quality_fm.predict(docs.limit(5), m).collect()} == {want}
    # one id with a third of all rows teaches one text
    hot = docs.union(docs.where("doc_id = 4").crossJoin(spark.range(100)).select(docs.columns))
    assert quality_fm.fit(hot, labels).w0 == quality_fm.fit(docs, labels).w0


# ---- 12 whitening


def test_eigenpairs_are_all_found():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n = int(rng.integers(1, 30))
        a = rng.standard_normal((n, int(rng.integers(1, 2 * n + 1)))) * rng.random() ** 3
        v = a @ a.T
        if trial % 4 == 0:  # equal eigenvalues
            q, _ = np.linalg.qr(rng.standard_normal((n, n)))
            v = (q * rng.integers(0, 4, n)) @ q.T
        v = (v + v.T) / 2
        e, k = np.linalg.eigvalsh(v)[::-1], int(rng.integers(1, n + 3))
        shift = rng.random() * max(e.max(), 0)
        assert whitening.inertia(v, shift) == (e > shift).sum()
        value, x = whitening.top_eigenpairs(v, k, per_slice=int(rng.integers(1, 9)))
        want = e[:k][e[:k] > 1e-12 * max(np.trace(v), 1e-300)]
        assert len(value) == len(want)
        if len(value):
            assert np.allclose(value, want, rtol=1e-9, atol=1e-12 * e[0])
            assert np.abs(x.T @ x - np.eye(len(value))).max() < 1e-8 and np.abs(v @ x - x * value).max() < 1e-11 * e[0]


def brute_whitening(vectors, k=4):
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in vectors}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(0)
    c = (fit - s / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    dev = {i: sum((n * a - int(b)) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    return n, dev, e, {i: (np.array(v) - (s / n).astype(float)) @ u[:, :k] / np.sqrt(e[:k]) for i, v in x.items()}


def check_whitening(vectors, rows, k=4):
    n, dev, e, white = brute_whitening(vectors, k)
    sign = {}
    for r in rows:
        j = r["component"]
        w = white[r["vec_id"]][j - 1]
        if j not in sign and abs(w) > 0.1:
            sign[j] = np.sign(w * r["whitened"])
        assert r["n"] == n and r["deviation"] == dev[r["vec_id"]] and abs(r["explained"] / (e[j - 1] / e.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    assert all(abs(r["whitened"] - sign[r["component"]] * white[r["vec_id"]][r["component"] - 1]) < 1e-6 for r in rows)


def test_whitening(spark):
    got = queries.op12_embedding_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = got.collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, j) for i, _ in vectors for j in range(1, 5))
    check_whitening(vectors, rows)


def test_whitening_odd(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    hot = [(100 + i, good[0][1]) for i in range(60)]  # one vector holds more than half of all rows
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    odd = [(None, good[1][1]), (3, good[3][1]), (2**60 + 1, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in good + hot + bad + odd], "vec_id long, embedding array<double>, _x string, n int")
    got = whitening.whiten(df, components=4).collect()
    assert len(got) == 40 + 60 + 3
    per = [{"vec_id": r["vec_id"], "component": j + 1, "n": r["n"], "deviation": r["deviation"], "whitened": r["whitened"][j],
            "explained": r["explained"][j], "identity_error": r["identity_error"]} for r in got for j in range(4) if r["vec_id"] is not None]
    check_whitening([(i, v) for i, v in good + hot + [odd[2]]], per)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 200 and vec_id < 210 or vec_id is null")).count() == 0
    # two distinct vectors have one component, and huge entries give a null deviation instead of a wrong one
    two = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1e30, 0.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(two).collect()
    assert [len(r["whitened"]) for r in got] == [1] * 3 and {r["deviation"] for r in got} == {None}
    assert {round(abs(r["whitened"][0]), 9) for r in got} == {1.0}


# ---- 13 Merkle manifest


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i: i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_path(levels, at):
    out = []
    for level in levels[:-1]:
        lo = at - at % 3
        out.append((level[lo:at], level[at + 1: lo + 3]))
        at //= 3
    return out


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    trees = []
    for g in sorted(groups):
        some = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"])))
        trees.append((some, brute_levels([brute_leaf(r, r["text"]) for r in some])))
    top = brute_levels([levels[-1][0] for _, levels in trees])
    root, out = top[-1][0], []
    for t, (some, levels) in enumerate(trees):
        for i, r in enumerate(some):
            path = brute_path(levels, i) + brute_path(top, t)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            folded = brute_leaf(r, r["text"].replace("\n", "") if bad else r["text"])
            for left, right in path:
                folded = h("".join([*left, folded, *right]))
            out.append((r["doc_id"], levels[0][i], levels[-1][0], root, h("".join(x for p in path for s in p for x in s)), folded, folded == root))
    return sorted(out, key=str)


def test_merkle_manifest(spark, docs):
    got = queries.op13_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute_manifest(docs.collect()) and {r[6] for r in rows} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_merkle_blocks_and_odd_rows(spark, docs, odd_docs, no_docs, levels):
    """Blocks of 3 and 9 nodes: many rounds. A hot source, a hot id of repeated rows, and many sources of one row."""
    rng = np.random.default_rng(6)
    rows = [(int(i), f"a{i}\nb" if i % 3 else None, "en", "hot", 1) for i in rng.permutation(120)]
    rows += [(7, "same\n", None, "hot", None)] * 70 + [(i, "x\ny", "de", f"s{i}", 0) for i in range(40)] + [(500, "ü\n", "é", "", 2)]
    some = spark.createDataFrame(rows, DOCS).union(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    d = some.withColumn("row", F.lit("clash")).withColumn("leaf", F.lit(1)).withColumn("k", F.lit(2)).repartition(5)
    got = merkle.verify(d, levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(some.collect())
    assert merkle.verify(no_docs).count() == 0
    one = some.limit(1)
    assert sorted(map(tuple, merkle.verify(one, levels=levels).collect()), key=str) == brute_manifest(one.collect())
