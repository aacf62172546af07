"""Stage tables: insert-or-ignore, resume, counts and parameterised queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gripelens.operators.cleaning import first_per_key
from gripelens.schemas import RAW_FEEDBACK, TABLES
from gripelens.session import path_exists
from gripelens.sources.csv import read_csv, rename_present
from gripelens.sources.files import latest_drop

# Foreign column names and the names used here.
FOREIGN_NAMES = {
    "complaint_id": "feedback_id",
    "complaint_text": "customer_feedback",
    "mileage_km": "mileage",
}


def default_column(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column only when the frame lacks it."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def coerce_records(df: DataFrame, names: Mapping[str, str] = FOREIGN_NAMES) -> DataFrame:
    """Rename foreign columns and cast to the raw-feedback schema.

    Missing text columns and null texts stay null; a missing, null or unreadable
    mileage is 0.
    """
    df = default_column(rename_present(df, names), "mileage", 0)
    present = set(df.columns)

    def column(name: str) -> Column:
        if name == "mileage":
            return F.coalesce(F.col(name).try_cast("double").try_cast("long"), F.lit(0))
        return (F.col(name) if name in present else F.lit(None)).cast("string")

    return df.select(*[column(f.name).alias(f.name) for f in RAW_FEEDBACK.fields])


def new_rows(
    batch: DataFrame,
    stored: DataFrame | None,
    key: str = "feedback_id",
    required: Sequence[str] = TABLES["raw_feedback"].required,
    order: Column | str | None = None,
) -> DataFrame:
    """Rows of ``batch`` that an insert-or-ignore would add.

    Rows with a null in a required column are skipped, the first row of a
    repeated key wins (by ``order``, else by its columns from left to right, since
    files have no order in Spark), and keys already stored are left out.  The stored keys are first cut to those of the batch, so
    a small batch is broadcast and a large table not shuffled.
    """
    valid = batch.dropna(subset=[c for c in required if c in batch.columns])
    firsts = first_per_key(valid, [key], valid.columns if order is None else [order])
    if stored is None:
        return firsts
    known = stored.select(key).join(batch.select(key), key, "left_semi")
    return firsts.join(known, key, "left_anti").select(*batch.columns)


def insert_or_ignore(
    batch: DataFrame,
    path: str,
    key: str = "feedback_id",
    required: Sequence[str] = TABLES["raw_feedback"].required,
    order: Column | str | None = None,
) -> int:
    """Append the new rows of ``batch`` to the Parquet table; return how many.

    Running the same batch again adds nothing, so a retried batch is harmless.
    The count is taken by an observation during the write, not by a second job.
    """
    from pyspark.sql import Observation

    spark = batch.sparkSession
    stored = spark.read.parquet(path) if path_exists(spark, path) else None
    seen = Observation()
    rows = new_rows(batch, stored, key, required, order).observe(seen, F.count("*").alias("n"))
    rows.write.mode("append").parquet(path)
    return seen.get["n"]


def upload(
    spark: SparkSession,
    csv_path: str | list[str],
    table_path: str,
    names: Mapping[str, str] = FOREIGN_NAMES,
) -> int:
    """Read landed CSV files and insert them into the raw table."""
    return insert_or_ignore(coerce_records(read_csv(spark, csv_path), names), table_path)


def load_latest(
    spark: SparkSession,
    directory: str,
    table_path: str,
    pattern: str = "*.csv",
    names: Mapping[str, str] = FOREIGN_NAMES,
) -> int | None:
    """Insert all files of the newest matching drop; None when there is no file."""
    paths = latest_drop(spark, directory, pattern)
    return upload(spark, paths, table_path, names) if paths else None


def table_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("count"))


def run_query(spark: SparkSession, sql: str, args: Mapping | list, **tables: DataFrame) -> DataFrame:
    """SQL with bound parameters over frames, named in the text as ``{name}``."""
    return spark.sql(sql, args=args, **tables)


def stage(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    resume: bool = True,
    key: str = "",
) -> DataFrame:
    """Write a stage table unless a finished one exists, then read it back.

    The success marker decides, so a half-written table of a broken run is
    written again.  ``key`` (see ``fingerprint``) names the input the table is made
    from: another input is another table.
    """
    path = f"{path}/{key}" if key else path
    if not (resume and path_exists(spark, f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(df: DataFrame | None, *settings) -> str:
    """A short digest of all rows of ``df``, in any order, and of some settings."""
    facts = None
    if df is not None:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        facts = tuple(
            df.select(row.alias("h"))
            .agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(20,0)")))
            .first()
        )
    names = df.columns if df is not None else None
    return hashlib.sha256(repr((facts, names, settings)).encode()).hexdigest()[:20]


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Store vectors next to their key."""
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
