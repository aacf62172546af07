"""Finding the newest file or drop of a landing folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_file(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """The newest entry that matches a glob, or no row: (path, modified, length).

    An entry is a file, or a folder of part files as Spark writes them, which is dated by
    its newest file and as long as all together.  Object stores keep no creation time, so
    the modification time decides; equal times are settled by the greater path.  File
    contents are not read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(directory)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    entry = F.split_part(F.substring("path", len(root) + 2, 1 << 30), F.lit("/"), F.lit(1))
    matching = entry.rlike(rf"(?s)\A(?:{hadoop.GlobPattern.compile(pattern).toString()})\z")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .filter(matching)
        .groupBy(F.concat(F.lit(f"{root}/"), entry).alias("path"))
        .agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("length"))
    )
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)


def latest_path(spark: SparkSession, directory: str, pattern: str) -> str | None:
    found = latest_file(spark, directory, pattern).select("path").first()
    return found["path"] if found else None


def latest_drop(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """All files of the newest drop, or an empty list.

    A drop is what arrived together: the matching files of one sub-folder, the part
    files of one Spark write, or a single other file.  Its newest file dates it.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", F.col("modificationTime").alias("modified"))
    )
    inside = F.element_at(F.split("path", f"/{re.escape(directory.rstrip('/').rsplit('/', 1)[-1])}/", 2), 2)
    write = F.regexp_extract(inside, r"^part-\d+-([0-9a-f-]{36})", 1)
    name = F.when(inside.contains("/"), F.split_part(inside, F.lit("/"), F.lit(1))).when(write != "", write)
    files = files.withColumn("drop", F.coalesce(name, inside))
    newest = files.groupBy("drop").agg(F.max(F.struct("modified", "path")).alias("at"))
    newest = newest.orderBy(F.desc("at")).limit(1).select("drop")
    return sorted(r["path"] for r in files.join(newest, "drop", "left_semi").select("path").collect())
