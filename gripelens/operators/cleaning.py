"""Duplicate removal, null removal, text clean-up and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gripelens.functions.text import clean_text

CRITICAL_COLUMNS = ("feedback_id", "customer_feedback", "language", "vehicle_model")


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]):
    """Keep the first row of every key group, by ``order``.

    The rank filter lets Spark keep one row per group and map task before the
    shuffle, so a group of copies that holds much of the table stays small.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def drop_duplicate_texts(
    df: DataFrame, text: str = "customer_feedback", order: str | Column = "feedback_id"
) -> DataFrame:
    """Keep the first row per exact text; nulls equal each other.

    The hash leads the key so that sorting and hashing seldom touch long texts.
    """
    return first_per_key(df, [F.xxhash64(text), F.col(text)], [order])


def drop_null_rows(df: DataFrame, columns: Sequence[str] = CRITICAL_COLUMNS) -> DataFrame:
    return df.dropna(subset=list(columns))


def clean_feedback(
    df: DataFrame, text: str = "customer_feedback", order: str | Column = "feedback_id"
) -> DataFrame:
    """Dedupe on raw text, then drop null rows, then clean the text.

    If the first copy of a text has a null model, all its copies go; texts that
    become equal only by cleaning all stay.
    """
    kept = drop_null_rows(drop_duplicate_texts(df, text, order))
    return kept.withColumn(text, clean_text(F.col(text)))


def cleaning_statistics(
    df: DataFrame,
    text: str = "customer_feedback",
    order: str = "feedback_id",
    critical: Sequence[str] = CRITICAL_COLUMNS,
) -> DataFrame:
    """One row: rows before and after, removed as duplicates, removed as null.

    Counts come from one grouping by text with map-side combining; no row other
    than the partial sums crosses the shuffle twice.
    """
    is_null = F.lit(False)
    for name in critical:
        is_null = is_null | F.col(name).isNull()
    groups = df.groupBy(F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).agg(
        F.count("*").alias("copies"), F.min_by(is_null, F.col(order)).alias("first_is_null")
    )
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("initial_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count_if("first_is_null").alias("null_rows"),
        F.count_if(~F.col("first_is_null")).alias("final_rows"),
    ).withColumn("removed_rows", F.col("initial_rows") - F.col("final_rows"))


def scrub_counts(df: DataFrame, text: str = "customer_feedback") -> DataFrame:
    """How many texts each personal-data pattern matches, in one pass."""
    from gripelens.functions import text as T

    patterns = {
        "vin": T.VIN_PATTERN,
        "email": T.EMAIL_PATTERN,
        "phone": T.PHONE_PATTERN,
        "long_number": T.LONG_NUMBER_PATTERN,
    }
    return df.agg(
        F.count("*").alias("rows_seen"),
        *[F.count_if(F.col(text).rlike(p)).alias(f"{n}_rows") for n, p in patterns.items()],
    )
