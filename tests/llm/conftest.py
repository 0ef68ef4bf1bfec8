import os
import sys

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from trendspark.session import local_session

    return local_session("*", 8, app="trendspark-tests")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing extra columns."""
    long_text = " ".join(f"word{i % 977} and the of{i}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door of the old house today", "en", "src1", 10),
        (1, "the cat sat on the mat and the dog lay by the door of the old house today", "en", "src1", 10),
        (2, None, "en", None, None), (3, "", None, "src1", 0), (4, " \n\t \n", "en", "src2", 5),
        (None, "a line without any id but with words in it for the test", "en", "src1", 4),
        (5, long_text, "en", "src1", len(long_text)), (6, long_text, "en", "src9", len(long_text)),
        (7, "aaaa" * 300, "de", "src3", 1200), (8, "12345 67890\n!!! ???", "fr", "src4", 19),
        (9, "the cat sat on the mat and the dog lay by the door of the old house yesterday", None, "src1", 10),
        (10, "emoji 😀 and <|endoftext|> inside﻿  two blanks ", "es", "src5", 30),
        (11, "x" * 50_000, "en", "src0", 50_000),
    ]
    return spark.createDataFrame([r + (0, "k", 1.0, -7) for r in rows], DOCS + ", n int, k string, score double, part int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
