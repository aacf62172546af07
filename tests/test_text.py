from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gripelens.functions import text as T


def apply(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r["o"] for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


CASES = [
    (
        "VIN: WDB9483D9H8FH9C41 mail a.b@x.org  call 555-123-4567",
        "VIN: mail call",
    ),
    ("(555) 123-4567", "("),
    ("a b", "a b"),
    ("é1HGCM82633A004352", "é1HGCM82633A004352"),
    ("order 12345678", "order"),
    ("<p>X</p>", "<p>X</p>"),
    ("a\x1cb", "a b"),
    ("vin wdb9483d9h8fh9c41 in lower case", "vin in lower case"),
    ("x 1@a.co22 3456 y", "x 22 3456 y"),
    ("+49 555 1234567 end", "+49 end"),
    ("　 padded \t\n text  ", "padded text"),
    ("", ""),
    (None, ""),
]


def test_clean_cases(spark):
    assert apply(spark, T.clean_text, [c[0] for c in CASES]) == [c[1] for c in CASES]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), min_size=30, max_size=30))
def test_clean_has_no_extra_blanks(spark, texts):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    for before, after in zip(texts, apply(spark, T.clean_text, texts)):
        assert after == after.strip(" ") and "  " not in after
        if "@" not in before and not re.search(r"[0-9]", before):
            if not re.search(r"[A-Za-zſK]{17}", before):
                assert after == " ".join(re.split(r"\s+", before)).strip()


def test_invalid_bytes_are_dropped(spark):
    df = spark.range(1).select(F.unhex(F.lit("61FF62")).cast("string").alias("t"))
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "ab"


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    got = apply(spark, lambda c: T.tokens(c, ["the"]), ["The gear, the GEAR a über_1 x"])
    assert got == [["gear", "gear", "über_1"]]


@pytest.mark.parametrize(
    "needle, text, hit",
    [
        ("OIL", "engine oil leak", True),
        ("o_l", "engine OIL leak", True),
        ("e%k", "engine oil leak", True),
        ("É", "été", False),
        ("a\\b", "xa\\by", True),
        ("gear", "engine", False),
    ],
)
def test_contains_like(spark, needle, text, hit):
    assert apply(spark, lambda c: T.contains_like(c, needle), [text]) == [hit]


def test_display(spark):
    row = spark.range(1).select(
        T.percent_text(F.lit(0.85)).alias("p"), T.display_text(F.lit("x" * 400)).alias("d")
    ).first()
    assert row["p"] == "85.00%" and len(row["d"]) == 300
