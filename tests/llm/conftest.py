from __future__ import annotations

import re

import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long and repeated texts, and columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "word " * 30_000), (5, "a" * 50_000), (6, "x y z"),
        (6, "x y z"), (7, "x y z"), (None, "x y z"), (None, None), (8, "▁é 日本 \x1c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["row", "words", "_text", "text_key", "band", "label", "number", "score"]
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.lit(None).cast("string") for n in names})
