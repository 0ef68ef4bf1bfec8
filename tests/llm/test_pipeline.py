"""The pipeline's stages and run() against brute force on a small table."""

import collections

import numpy as np
import pytest

import corpus_pipeline as C
from test_operators import brute_classes, brute_lines
from trendspark.llm.common import table
from trendspark.llm.units import ByteBpe

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [("documents", docs)]
    for name, f in C.STAGES:
        docs = table(f(spark, docs, "/root/testdata/sf0.001"), name)
        out.append((name, docs))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["language_id", "line_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    for _, df in stages[:-1]:
        assert df.columns == COLS


def test_language_stage_keeps_clean(spark, stages):
    before, after = rows(stages[0][1]), rows(stages[1][1])
    for i, r in before.items():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (i in after) == letters


def test_language_stage_rejects_unknown(spark, docs):
    rng = np.random.default_rng(3)

    def noise(letters, n):
        return "".join(rng.choice(list(letters), n))

    bad = ["我们今天去公园散步然后回家吃饭看电视学习中文和数学", "Сегодня мы пошли в парк и потом вернулись домой ужинать", "我们",
           "Σήμερα πήγαμε στο πάρκο και μετά γυρίσαμε σπίτι", "dzisiaj poszliśmy do parku a potem wróciliśmy do domu na obiad",
           noise("bcdfghjklmnpqrstvwxz ", 400), noise("0123456789abcdef", 400), noise("abcdefghijklmnopqrstuvwxyz    ", 800), "x" * 500]
    clean = ["the cat sat on the mat and the dog lay by the door", "hello there", "Von.", "der Hund lag vor der Tür", "the",
             'The cat and the token = "d79b4bd5ac35c6fd4765f3c195ae8bf92c95a355" on the mat']
    rows = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(clean + bad)]
    got = C.language_id(spark, docs.union(spark.createDataFrame(rows, docs.schema)), "")
    got = {r["doc_id"]: r["lang"] for r in got.where("doc_id >= 1000000").collect()}
    assert set(got) == set(range(10**6, 10**6 + len(clean))) and got[10**6] == "en"


def test_line_stage(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    want = brute_lines([(i, r["text"]) for i, r in before.items()], 8)
    for i, (text, n, exact, near) in want.items():
        assert (i in after) == (n == 0 or exact + near < n)
        if i in after:
            assert after[i]["text"] == text and after[i]["n_chars"] == len(text)


def test_near_duplicate_stage(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    label = brute_classes([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i, c in label.items() if i == c}


def test_near_duplicates_of_equal_and_null_ids(spark):
    rng = np.random.default_rng(4)

    def words(n=60):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))

    a, b, c, d = words(), words(), words(), words()
    near = a + " end"
    hot = [(7, words(), "en", f"s{i % 3}", i) for i in range(40)]  # one id, forty texts
    lines = [*hot, (7, hot[0][1], "en", "s0", 0), (1, a, "en", "s", 1), (7, near, "en", "s", 2), (2, b, "en", "s", 3), (None, b, "en", "s", 4),
             (None, c, "en", "s", 5), (None, c, "en", "s", 5), (None, c + " end", "en", "s", 6), (None, d, "en", "s", 7), (3, None, "en", "s", 8)]
    docs = spark.createDataFrame(lines, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs, "").collect())
    assert set(got.values()) == {1}
    want = {(7, r[1]) for r in hot} | {(1, a), (2, b), (None, d), (3, None)}
    rest = set(got) - want
    assert want <= set(got) and len(rest) == 1 and rest < {(None, c), (None, c + " end")}


def test_mixing_stage(stages):
    before, after = rows(stages[3][1]), rows(stages[4][1])
    assert set(after) <= set(before) and stages[4][1].count() == len(after)
    n = {i: len((r["text"] or "").split()) for i, r in before.items()}
    assert sum(n[i] for i in after) <= 0.9 * sum(n.values())


def test_packing_stage(stages):
    docs, got = rows(stages[4][1]), stages[5][1].toPandas()
    tk = ByteBpe(C.TOKENIZER).tk
    for i, r in docs.items():
        p = got[got.doc_id == i].sort_values("piece")
        assert b"".join(map(bytes, p.tokens)) == np.array([*tk.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert set(got.doc_id) == set(docs) and got.groupby("sequence_id").length.sum().max() <= 1024


def test_run_equals_stages(spark, stages):
    got = C.run(spark, "/root/testdata/sf0.001").select("doc_id", "piece", "start", "length", "tokens").collect()
    want = stages[5][1].select("doc_id", "piece", "start", "length", "tokens").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs
    for _, f in C.STAGES[:-1]:
        docs = f(spark, docs, "")
    ids = [r["doc_id"] for r in docs.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    docs = no_docs
    for _, f in C.STAGES:
        docs = f(spark, docs, "")
        assert docs.count() == 0
