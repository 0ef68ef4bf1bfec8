"""The numbered operators against brute force, round trips and odd inputs."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendspark.llm import (embed_dedup, langid, line_dedup, minhash, mixing, packing, quality, queries, suffix_dedup, token_counts,
                            token_files, units)
from trendspark.llm import common
from trendspark.llm.common import components, new_path, running_total

SF = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def pdf(df, key="doc_id"):
    return df.toPandas().sort_values(key).reset_index(drop=True)


# ---- helpers


def test_running_total_and_components(spark):
    rows = [(k * 3, k % 5) for k in range(50)]
    got = {r["k"]: r["t"] for r in running_total(spark.createDataFrame(rows, "k long, v long"), "k", "v", "t", 8).collect()}
    want, s = {}, 0
    for k, v in rows:
        want[k] = s
        s += v
    assert got == want
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, x) for x in range(1001, 1100)]
    label = {x: x for e in edges for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got}
    assert all(x in got for a, b in edges if a != b for x in (a, b))


def test_broadcast_bound_counts_items(spark, monkeypatch):
    df = spark.range(3).select("id", F.expr("sequence(1, 1000)").alias("xs"))

    def broadcast(x):
        return "Hint" in x._jdf.queryExecution().logical().toString()

    monkeypatch.setattr(common, "BROADCAST_BYTES", 3 * 64 + 3000 * 72)
    assert broadcast(common.small_lists(df, "xs", 72))
    assert not broadcast(common.small_lists(df, "xs", 73))  # three rows, but too many bytes in their arrays
    assert broadcast(common.small_lists(df.limit(0), "xs", 72))
    rows = [(i, "one two three four five six seven eight nine ten " * 12 + f"end{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [sorted(map(tuple, f().collect())) for f in (lambda: suffix_dedup.suffix_dedup(docs, 40, 10), lambda: line_dedup.line_dedup(docs))]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert [sorted(map(tuple, f().collect())) for f in (lambda: suffix_dedup.suffix_dedup(docs, 40, 10), lambda: line_dedup.line_dedup(docs))] == want


# ---- 1 suffix-array dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order(t):
    t = t + [0]
    order = suffix_dedup.suffix_order(t)
    assert order == sorted(range(len(t)), key=lambda i: t[i:])
    best = suffix_dedup.common_prefixes(t, order)
    for i in range(len(t)):
        def same(j):
            return next((k for k, (x, y) in enumerate(zip(t[i:], t[j:])) if x != y), min(len(t) - i, len(t) - j))
        assert best[i] == max([same(j) for j in range(len(t)) if j != i], default=0)


def brute_repeats(texts: list[bytes], length: int):
    seen = collections.Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) > 0).sum())
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def check_repeats(spark, texts, length, gram, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pdf(suffix_dedup.suffix_dedup(df, length, gram, **kw))
    rows = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.itertuples()]
    assert rows == brute_repeats([(t or "").encode() for t in texts], length)


@pytest.mark.parametrize("max_group", [512, 2])
def test_suffix_dedup_brute(spark, max_group):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd éß") for _ in range(rng.randrange(0, 160))) for _ in range(12)]
    texts = []
    for _ in range(60):
        t = "".join(b[rng.randrange(len(b) + 1):] for b in rng.sample(base, 2))
        if t and rng.random() < 0.5:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("xyz") + t[i + 1:]
        texts.append(t)
    texts += [None, "", "a" * 200, "ab" * 90, "a" * 21, texts[0], texts[0]]
    check_repeats(spark, texts, 20, 6, max_group=max_group)


def test_suffix_dedup_documents(spark, docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    check_repeats(spark, texts, 400, 96)


def test_suffix_dedup_repeated_rows(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    edited = text[:150] + "#" + text[151:]
    real = suffix_dedup._group

    def group(rows, length):  # goes to the workers in place of the real one
        if len(rows) > 2:
            raise ValueError(f"{len(rows)} contexts held")
        return real(rows, length)

    want = brute_repeats([text.encode()] * 2 + [edited.encode()], 40)
    monkeypatch.setattr(suffix_dedup, "_group", group)
    for i in (1, None):
        df = spark.createDataFrame([(i, text)] * 300 + [(2, edited)], "doc_id long, text string")
        got = suffix_dedup.suffix_dedup(df, 40, 10).collect()
        assert len(got) == 301
        for r in got:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[2 if r["doc_id"] == 2 else 0]


def test_suffix_dedup_odd(odd_docs, no_docs):
    got = suffix_dedup.suffix_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_removed"] == by[5]["n_bytes"] == by[6]["n_removed"]
    assert by[7]["n_removed"] == 1200 and by[2]["n_bytes"] == 0 and by[1]["n_removed"] == 0
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_anchor_segments(monkeypatch):
    rng = np.random.default_rng(3)
    b = rng.integers(0, 4, 5000).astype(np.uint8)
    whole = suffix_dedup.anchor_runs(b, 60, 10)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = suffix_dedup.anchor_runs(b, 60, 10)

    def anchors(r):  # window -> anchor place
        return {w: s + off for s, span, off, *_ in zip(*r) for w in range(s, s + span + 1)}

    assert anchors(whole) == anchors(parts)


# ---- 2 embedding near-dedup


def brute_vectors(rows, cosine=0.95):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, float) / np.linalg.norm(np.array(v, float)))
    flat = [(i, v) for i, vs in ok.items() for v in vs]
    links, label = collections.Counter(), {i: i for i, _ in rows if i is not None}
    pairs = [(a, b) for a, (i, v) in enumerate(flat) for b, (j, w) in enumerate(flat) if a != b and len(v) == len(w) and v @ w >= cosine]
    for a, _ in pairs:
        links[a] += 1
    for _ in range(len(flat)):
        for a, b in pairs:
            i, j = flat[a][0], flat[b][0]
            label[i] = label[j] = min(label[i], label[j])
    return {i: (max([links[a] for a, (k, _) in enumerate(flat) if k == i], default=0), label[i], label[i] == i) for i in label}


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(int(100 + 20 * c + i), (centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25])).tolist()) for i in range(12)]
    rows += [(1, rows[0][1]), (2, rows[0][1]), (3, None), (4, [0.0] * 16), (5, [float("nan")] + [1.0] * 15), (6, [None] + [1.0] * 15),
             (7, []), (None, rows[0][1]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [float("inf")] * 16)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    for kw in ({}, {"target": 16, "block": 8}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df, **kw).collect()}
        assert got == brute_vectors(rows)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_many_lengths(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in range(1, 71):
        centre = rng.normal(size=d)
        rows += [(10 * d + i, (centre + rng.normal(size=d) * 0.02).tolist()) for i in range(2 + d % 3)]
    wide = [rng.normal(size=71) for _ in range(3)]
    rows += [(1000 + i, (wide[i % 3] + rng.normal(size=71) * 0.1).tolist()) for i in range(24)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")
    want = brute_vectors(rows)
    for kw in ({}, {"target": 4, "block": 8}):  # one unit for each length; cells for the length of 24 vectors
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df, **kw).collect()}
        assert got == want
    assert sum(want[i][0] > 0 for i in want) > 200


def test_near_vectors_pivot_copies(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=16).astype(np.float32)
    rows = []
    for i in range(90):  # one direction: one-bit and rescaled copies
        v = base.copy()
        if i % 2:
            k = rng.integers(16)
            v[k] = np.nextafter(v[k], np.float32(9))
        rows.append((i, (v.astype(float) * (1 + i // 32 * 0.37)).tolist()))
    unit = base / np.linalg.norm(base)
    for i in range(180):  # around the threshold of a link with them, and of links among each other
        side = rng.normal(size=16)
        side -= side @ unit * unit
        c = rng.uniform(0.93, 0.98)
        rows.append((100 + i, (c * unit + np.sqrt(1 - c * c) * side / np.linalg.norm(side)).tolist()))
    pivots = embed_dedup._thin(embed_dedup._normal(np.array([v for _, v in rows])))
    gaps = np.linalg.norm(pivots[:, None] - pivots[None], axis=2) + np.eye(len(pivots))
    assert len(pivots) == 181 and gaps.min() >= 1e-4
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")
    want = brute_vectors(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df, target=4, block=16).collect()}
    assert got == want


def test_near_vectors_dense_group(spark):
    """A third of the rows near one direction: their links are counted by weight, those of the shell by products."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=24)
    centre /= np.linalg.norm(centre)
    rows = []
    for i in range(240):
        side = rng.normal(size=24)
        side -= side @ centre * centre
        side /= np.linalg.norm(side)
        far = rng.uniform(0, 0.1) if i < 120 else rng.uniform(0.05, 0.6)
        rows.append((i, (np.cos(far) * centre + np.sin(far) * side).tolist()))
    rows += [(300 + i, rng.normal(size=24).tolist()) for i in range(120)] + [(500, rows[3][1]), (501, rows[3][1]), (502, rows[200][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")
    want = brute_vectors(rows)
    for kw in ({"target": 8, "block": 16}, {"target": 64, "block": 32}, {"target": 2, "block": 8, "max_pivots": 40}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df, **kw).collect()}
        assert got == want
    assert sum(n > 100 for n, _, _ in want.values()) > 100


# ---- 3 quality rules


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), \
        len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality(docs, odd_docs, no_docs):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for d in (docs, odd_docs):
        got = quality.quality(d.select("*", F.col("text").alias("copy"))).collect()
        assert len(got) == d.count()
        for r in got:
            assert tuple(r[c] for c in cols) == brute_quality(r["copy"])
            assert not (r["kept"] and r["base_failed"])
    clash = odd_docs.withColumn("N_words", F.lit(-1)).withColumn("kept", F.lit("x")).withColumn("_w", F.lit(1))
    assert quality.quality(clash).select("n_words", "kept").orderBy("n_words").collect() == \
        quality.quality(odd_docs).select("n_words", "kept").orderBy("n_words").collect()
    assert quality.quality(no_docs).count() == 0


def test_quality_keeps_clean(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality(docs).join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0
    assert got.where("quality = 0 and kept").count() <= 0.05 * max(1, got.where("quality = 0").count())


# ---- tokenizer units, 4 token counts


TEXT = st.text(st.sampled_from("ab c'sé\n\t .,1 　▁<|>endoftxt😀\u0085\x1c"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_units_give_the_library_tokens(texts):
    global _BPE, _PIECE
    if "_BPE" not in globals():
        _BPE, _PIECE = units.ByteBpe(BYTE), units.PieceCounter(PIECE)
    whole = [np.array(e.ids, "<u4").tobytes() for e in _BPE.tk.encode_batch(texts, add_special_tokens=False)]
    assert _BPE.encode(texts) == whole
    assert _PIECE.count(texts) == [len(x) for x in _PIECE.sp.encode(texts)]


def test_units_special_strings():
    bpe = units.ByteBpe(BYTE)
    for t in ("a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>  x", "it 's  can't\n we'll", "a  \n b", " a", "a "):
        assert bpe.encode([t])[0] == np.array(bpe.tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_unit_table(monkeypatch):
    """A full table is emptied, equal hashes go to the library, and blocks end anywhere."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "Zé", " ", "  ", "\n", "\t", ".", "'s", "'", "7", "\u2003", "ñ", "日本", "\x1c", "<|endoftext|>"][: 4 + k % 13])
                     for _ in range(rng.randrange(60))) for k in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in units.ByteBpe(BYTE).tk.encode_batch_fast(texts, add_special_tokens=False)]
    bpe = units.ByteBpe(BYTE)
    assert bpe.encode(texts) == want and bpe.encode(texts[::-1]) == want[::-1]
    monkeypatch.setattr(units, "BLOCK", 300)
    monkeypatch.setattr(units, "KEPT_UNITS", 50)
    assert units.ByteBpe(BYTE).encode(texts) == want
    monkeypatch.setattr(units, "mix", lambda h: h % np.uint64(64) << np.uint64(58))
    assert units.ByteBpe(BYTE).encode(texts[:300]) == want[:300]


def test_token_counts_cache(spark, docs, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = new_path(spark, "cache-test")
    half = docs.where("doc_id % 2 = 0")
    for d in (half, docs, odd_docs, no_docs):
        before = spark.read.parquet(cache) if d is not half else None
        n0 = before.count() if before is not None else 0
        got = token_counts.token_counts(d.select("*", F.col("text").alias("copy")), PIECE, cache).collect()
        assert len(got) == d.count()
        for r in got:
            assert (r["n_bytes"], r["n_tokens"]) == (len((r["copy"] or "").encode()), len(sp.encode(r["copy"] or "")))
        after = spark.read.parquet(cache)
        assert after.count() == after.select("_tc_digest").distinct().count()  # only distinct misses are appended
        assert after.count() >= n0
    n = spark.read.parquet(cache).count()
    token_counts.token_counts(docs, PIECE, cache).collect()
    clash = docs.withColumn("n_bytes", F.lit("x")).withColumn("N_TOKENS", F.lit(-1))
    assert sorted(map(tuple, token_counts.token_counts(clash, PIECE, cache).select("doc_id", "n_bytes", "n_tokens").collect())) == \
        sorted(map(tuple, token_counts.token_counts(docs, PIECE, cache).select("doc_id", "n_bytes", "n_tokens").collect()))
    assert spark.read.parquet(cache).count() == n


# ---- 5 token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.data())
def test_codes_round_trip(ids, data):
    raw = np.array(ids, "<u4").tobytes()
    r = token_files.Reader(token_files.shard_bytes(3, 9, [7, None], [raw, b""]))
    assert r.ids(0, r.n_ids).tolist() == ids and (r.part, r.shard) == (3, 9)
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        assert r[i] == ids[i]
        j = data.draw(st.integers(i, len(ids)))
        assert r.ids(i, j).tolist() == ids[i:j]


def test_token_output(spark, docs, odd_docs, no_docs):
    tk = units.ByteBpe(BYTE).tk
    for d in (docs, odd_docs):
        rows = d.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("t")).collect()
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1 << 63, r["t"], r["doc_id"]) for r in rows), key=lambda r: (r[0], r[1].encode()))
        want, at = [], 0
        for _, t, i in rows:
            ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = token_files.token_output(d, BYTE).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("c")).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_files.token_output(no_docs, BYTE).count() == 0


def test_token_files_spread_one_key(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = [(None if i % 2 else 7, " ".join(rng.choice(words) for _ in range(20))) for i in range(2000)] + [(1, "a"), (9, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = common.new_path(spark, "tokens")
        manifest = token_files.write_token_files(d, BYTE, folder).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n_docs"] for r in manifest) == len(rows)
    assert len({r["part"] for r in manifest}) >= 6 and max(r["n_docs"] for r in manifest) < 700


# ---- 6 DartMinHash


def test_dart_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(2)
    for share, weight in ((0.8, 1), (0.5, 3), (0.2, 7)):
        n = 400
        common = rng.integers(1, 2**63, int(n * share), dtype=np.uint64)
        sets = []
        for _ in range(2):
            e = np.unique(np.r_[common, rng.integers(1, 2**63, n - len(common), dtype=np.uint64)])
            sets.append((e, np.where(np.isin(e, common), weight, 1).astype(np.int64)))
        s = minhash.signatures(sets, 4000)
        assert abs((s[0] == s[1]).mean() - minhash.similarity(*sets)) < 0.04
    one = minhash.signatures([(np.array([5], np.uint64), np.array([1]))], 96)
    assert (one != 0).all()


def test_dart_weights_of_any_size():
    """Agreement of heavy elements, next to light ones, at the cost of some doubling regions."""
    for a, b in ((1_000_000, 900_000), (70_000, 65_537), (300, 100), (17, 16), (2, 1)):
        e = np.array([11, 12, 13], np.uint64)
        sets = [(e, np.array([a, 3, 5], np.int64)), (e, np.array([b, 3, 1], np.int64))]
        s = minhash.signatures(sets, 3000)
        assert abs((s[0] == s[1]).mean() - minhash.similarity(*sets)) < 0.04
        of, strip, height, share = minhash.regions(e, sets[0][1])
        assert len(strip) < 70 and len(set(strip.tolist())) == len(strip)
        assert np.bincount(of, weights=height * share).tolist() == [a, 3, 5]


def test_near_documents_heavy_shingles(spark):
    rng = random.Random(9)
    tail = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))
    rows = [(i, "x " * n + tail) for i, n in enumerate((1_000_000, 900_000, 700_000, 560_000, 300, 290, 30))]
    rows += [(20, "a b " * 5000), (21, "b a " * 4500), (22, "a b " * 3000), (23, "a c " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kw in ({}, {"block": 2}):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_documents(df, **kw).collect()}
        assert got == brute_classes(rows)
    assert got[1] == 0 and got[2] != 0 and got[3] == 2 and got[5] == 4 and got[21] == 20 and got[22] != 20


def brute_classes(rows, threshold=0.8):
    sets = [(i, collections.Counter()) for i, _ in rows]
    for (_, c), (_, t) in zip(sets, rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(max(1, len(w) - 4) if w else 0):
            c[tuple(w[k: k + 5])] += 1
    label = {i: i for i, _ in rows}
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a]
             if x and y and (m := sum((x & y).values())) >= threshold * (sum(x.values()) + sum(y.values()) - m)]
    for _ in range(len(rows)):
        new = dict(label)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            break
        label = new
    return label


def test_near_documents(spark, docs, odd_docs, no_docs):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = [f"w{i}" for i in range(3000)]
    for g in range(6):  # groups of edited copies: links between copies differ from links to the first
        base = [rng.choice(words) for _ in range(rng.choice([60, 200, 400]))]
        for k in range(25):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 50)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((10_000 + 100 * g + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kw in ({}, {"block": 4}):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_documents(df, **kw).collect()}
        assert got == brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_documents(odd_docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 1, 10: 10, 11: 11}
    assert minhash.near_documents(no_docs).count() == 0


# ---- 7 mixing


def test_mix_budgets(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "a", 50), ("books", "en", "c", 20)],
                                   "domain string, language string, source string, cap long")
    w = {"domain": {"web": 0.5, "books": 0.5}, "language": {"en": 0.5, "de": 0.5}, "source": {}}
    got = {(r["domain"], r["language"], r["source"]): r["budget"] for r in mixing.leaf_budgets(leaves, 600, w).collect()}
    # books has 20 only, so web gets 580: de is short too, its sibling en gets the rest, and a's shortage goes to b
    assert got == {("books", "en", "c"): 20, ("web", "de", "a"): 50, ("web", "en", "a"): 100, ("web", "en", "b"): 430}
    full = mixing.leaf_budgets(leaves, 10_000, w).agg(F.sum("budget")).first()[0]
    assert full == 1170


def test_mix_documents(docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        for fraction, epochs in ((0.5, 1), (0.8, 2), (5.0, 3)):
            out = mixing.mix(d, fraction, epochs).collect()
            n = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in d.collect()}
            total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in d.collect())
            used = sum(r["mix_tokens"] * r["mix_copies"] for r in out)
            assert used <= fraction * total + 1e-6 and all(1 <= r["mix_copies"] <= epochs for r in out)
            assert all(r["mix_tokens"] == n[r["doc_id"]] for r in out if r["doc_id"] not in (None, 1))
            if fraction == 5.0:
                assert used == total * epochs
    a = {(r["doc_id"], r["mix_copies"]) for r in mixing.mix(docs).collect()}
    assert a == {(r["doc_id"], r["mix_copies"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert mixing.mix(no_docs).count() == 0


def test_mix_takes_the_prefix(docs):
    """Each leaf's partial epoch is the longest prefix, by the seeded hash, within its budget."""
    out = mixing.mix(docs, 0.5, 1)
    rows = docs.select("doc_id", "lang", "source", F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text").alias("h"),
                       mixing.word_count(F.col("text")).alias("n")).collect()
    taken = {r["doc_id"] for r in out.collect()}
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[r["lang"], r["source"]].append((r["h"], r["n"], r["doc_id"] in taken))
    for leaf in leaves.values():
        flags = [t for _, _, t in sorted(leaf)]
        assert flags == sorted(flags, reverse=True)


# ---- 8 line dedup


def brute_lines(rows, min_words):
    rows = sorted(rows, key=lambda r: r[0])
    lines = [(i, j, x) for i, t in rows for j, x in enumerate((t or "").split("\n")) if line_dedup._tokens(x)]
    seen, near, exact, known = set(), set(), set(), []
    for i, j, x in lines:
        if x in seen:
            exact.add((i, j))
            continue
        seen.add(x)
        w = line_dedup._tokens(x)
        if len(w) >= min_words and any(line_dedup.within_one(v, w) for v in known):
            near.add((i, j))
        if len(w) >= min_words:
            known.append(w)
    out = {}
    for i, t in rows:
        ls = (t or "").split("\n")
        full = [bool(line_dedup._tokens(x)) for x in ls]
        keep = [x for j, x in enumerate(ls) if (i, j) not in exact | near]
        text = "\n".join(keep) if any(line_dedup._tokens(x) for x in keep) or not any(full) else ""
        out[i] = (None if t is None else text, sum(full), sum((i, j) in exact for j in range(len(ls))), sum((i, j) in near for j in range(len(ls))))
    return out


def test_line_dedup(spark, docs):
    rng = random.Random(3)
    rows = [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in docs.limit(60).collect())]
    words = ["a", "b", "c", "dé", "e"]
    for i in range(150):
        text = []
        for _ in range(rng.randrange(0, 6)):
            text.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 6, 7]))) + rng.choice(["", " "]))
        rows.append((5000 + i, "\n".join(text)))
    rows += [(9000, None), (9001, ""), (9002, "\n \n"), (9003, "one two three four five six"), (9004, "one two 3 four five six\n\nx"),
             (9005, "one two three four five six seven")]
    df = spark.createDataFrame([(i, t, "z", 4) for i, t in rows], "doc_id long, text string, k string, line int")
    for m in (4, 6):
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in line_dedup.line_dedup(df, min_words=m).collect()}
        assert got == brute_lines(rows, m)


def test_line_dedup_odd(odd_docs, no_docs):
    got = line_dedup.line_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count() and got[0]["k"] == "k"
    by = {r["doc_id"]: r for r in got}
    assert by[6]["text"] == "" and by[9]["n_near"] == 1 and by[2]["text"] is None and by[4]["text"] == " \n\t \n"
    assert line_dedup.line_dedup(no_docs).count() == 0


# ---- 9 language ID


def test_language_id(spark, docs, odd_docs, no_docs):
    got = queries.op9_language_id(spark, SF).join(docs.select("doc_id", "lang", F.length("text").alias("len")), "doc_id")
    held = got.where("held_out and len > 40")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.where("score < 0 or score > 1").count() == 0
    model = langid.fit(docs)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd_docs.withColumn("Lang_pred", F.lit(1)), model).collect()}
    assert odd[2] == odd[3] == odd[4] == odd[8] == "und" and odd[1] == odd[9] == "en"
    assert langid.predict(no_docs, model).count() == 0
    none = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_language_ridge_is_kernel_ridge(spark):
    """The folded weights score as the kernel regression does that they come from."""
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list("abcdefgh " if i % 2 else "fghijkl "), 60)), "xy"[i % 2]) for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20, per_lang_landmarks=20, ridge=0.05)
    sets = [langid.distinct_grams(t) for _, t, _ in rows]

    def kernel(a, b):
        return np.mean([len(np.intersect1d(x, y)) / np.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(a, b)])

    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if r[2] == x else -1.0 for x in model.langs] for r in rows])
    share = 1 / 20
    alpha = np.linalg.solve(share * k.T @ k + 0.05 * k + 1e-8 * np.eye(40), share * k.T @ y)  # every text is a landmark
    new = ["abc def gh", "jkl fgh", rows[3][1]]
    want = np.array([[kernel(langid.distinct_grams(t), s) for s in sets] for t in new]) @ alpha
    assert np.abs(model.score(new) - want).max() < 1e-3


def test_many_labels(spark):
    """More labels than the model holds: those with the most texts teach, and every text is answered."""
    rows = [(i, f"word{i % 7} text of label {'abcdefg'[i % 7] * 5}", f"l{i % 7}" if i < 70 else f"noise{i}") for i in range(400)] + [(None, "no id here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_langs=7, max_texts=35, max_landmarks=14)
    assert model.langs == [f"l{k}" for k in range(7)]
    got = langid.predict(docs, model).collect()
    assert len(got) == 401 and {r["lang_pred"] for r in got} <= set(model.langs)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] and r["lang"].startswith("l"))


def test_language_kernel_is_exact():
    texts = ["the cat and the dog", "la maison et le chat", "x"]
    sets = [langid.distinct_grams(t) for t in texts]
    for t, s in zip(texts, sets):
        b = t.encode()
        for n, codes in zip(langid.ORDERS, s):
            want = {int.from_bytes(b[i: i + n], "big") for i in range(len(b) - n + 1)}
            assert set(codes.tolist()) == want and len(codes) == len(want)


# ---- 10 packing


@settings(max_examples=80, deadline=None)
@example({33: 9})
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_covers_counts(counts):
    used = collections.Counter()
    n = 0
    for pattern, times in packing.plan(counts, 64):
        assert sum(pattern) <= 64 and times > 0
        n += times
        for x in pattern:
            used[x] += times
    assert used == collections.Counter(counts)
    total = sum(k * v for k, v in counts.items())
    least = max(-(-total // 64), sum(v for k, v in counts.items() if k > 32))  # no two pieces over half share a sequence
    assert n <= 1.5 * least + 1


def test_packing(docs, odd_docs, no_docs):
    tk = units.ByteBpe(BYTE).tk
    for d in (docs, odd_docs):
        got = packing.pack(d, BYTE, 1024, 2).toPandas()
        assert got.length.between(1, 1024).all()
        g = got.sort_values(["sequence_id", "offset"])
        end = g.offset + g.length
        assert (end.groupby(g.sequence_id).shift(fill_value=0) == g.offset).all() and end.max() <= 1024
        whole = collections.Counter(bytes(np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in d.collect())
        texts = collections.Counter()
        for i, rows in got[got.doc_id.notna()].groupby("doc_id"):
            if rows.piece.duplicated().any():  # repeated rows
                continue
            rows = rows.sort_values("piece")
            assert (rows.start.tolist() == np.r_[0, rows.length.cumsum()[:-1]]).all() and (rows.length[1:] == 1024).all()
            texts[b"".join(map(bytes, rows.tokens))] += 1
        assert not texts - whole
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.02 + 1
    assert packing.pack(no_docs, BYTE).count() == 0


def test_query_columns(spark):
    want = {"op1_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256 repeated", "op2_embedding_near_dedup": "vec_id n_links component_id kept",
            "op4_token_counts": "doc_id n_bytes n_tokens over_limit", "op5_token_output": "doc_id start n_tokens ids_crc32",
            "op6_minhash_near_dedup": "doc_id class_id kept", "op8_line_dedup": "doc_id n_lines n_exact n_near text_sha256",
            "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset"}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns == cols.split()
        if name not in ("op2_embedding_near_dedup", "op10_best_fit_packing"):
            assert df.count() == n
