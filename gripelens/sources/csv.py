"""CSV reading and writing with one quoting convention for both."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Cell texts that mean "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_FORMAT = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Replace the null tokens in every string column by null."""
    return df.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(*NULL_TOKENS), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The paths of the files, grouped by equal first line."""
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        place.alias("place"),
    )
    heads = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("head"))
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list(plain)).alias("files"))
    return [r["files"] for r in groups.orderBy("head").collect()]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = None,
    null_tokens: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read CSV with a header; values may hold quotes and line breaks.

    Columns are matched by name to each file's own header, so a file may hold them
    in any order, hold more or hold fewer; headers are found in a pass over the first
    lines.  ``multi_line=False`` lets Spark split large files whose values have no
    line breaks.
    """
    reader = spark.read.options(**_FORMAT, multiLine=str(multi_line).lower())
    groups = files_by_header(spark, path)
    df = reader.csv(path) if len(groups) < 2 else reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [reader.csv(g) for g in groups]
    )
    if null_tokens:
        df = null_tokens_to_null(df)
    if schema is None:
        return df
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in schema.fields
        ]
    )


def text_schema(*names: str) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write CSV part files with a header; blanks at value ends are kept."""
    (
        df.write.mode(mode)
        .options(
            **_FORMAT,
            ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
        )
        .csv(path)
    )


def export_report(labels: DataFrame, path: str) -> None:
    """Write the label report as CSV part files, each a sorted range of cluster ids.

    The part files, in order of their names, are in cluster order.
    """
    write_csv(labels.orderBy("cluster_id"), path)


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename those columns that exist."""
    return df.withColumnsRenamed(dict(mapping))
