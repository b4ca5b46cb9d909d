from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "Some plain words here and there", "en", "a", 1), (2, "some PLAIN words here and there", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 3),
        (None, "no id at all", "en", "a", 2), (6, "x" * 30_000, "en", "c", 3), (7, "word " * 20_000, "fr", "c", 4), (7, "word " * 20_000, "fr", "c", 4), (8, "É Ü ſ ß 中文 😀 <|endoftext|> \x1c 　 \u0085z", "fr", "é", 5),
        (9, "some plain words here and there", "en", None, 6),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "norm", "sha", "salt", "size", "kept", "t", "fp", "component", "label_id", "held", "key", "range", "features", "meta.url"):
        df = df.withColumn(name, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")
