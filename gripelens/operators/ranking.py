"""Global and per-group positions without ranking everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gripelens.session import materialise

_LOW_BITS = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Sort across partitions and keep (range number, position in range).

    The table is written once: range limits come from sampling, and a second
    evaluation might cut the data elsewhere.
    """
    return materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))),
        "ranged",
    )


def with_row_index(df: DataFrame, order: list[str | Column], name: str = "row_index") -> DataFrame:
    """Running index from 0 in ``order``.

    Each range is counted, the counts (one row per range) are summed
    up to range offsets, and the offsets are joined back.
    """
    ranged = _ranged(df, order)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_from") + F.col("_at"))
        .drop("_range", "_at", "_from")
    )


def with_group_position(df: DataFrame, group: str, order: str) -> DataFrame:
    """Add ``position`` (from 0, by ``order``) and ``group_size`` per group.

    Rows are sorted by (group, order) across ranges, so one large group spreads
    over many tasks.  A group's first index is subtracted from the global index.
    """
    indexed = with_row_index(df, [group, order], "_index")
    bounds = indexed.groupBy(group).agg(
        F.min("_index").alias("_first"), F.count("*").alias("group_size")
    )
    return (
        indexed.join(bounds, group)
        .withColumn("position", F.col("_index") - F.col("_first"))
        .drop("_index", "_first")
    )
