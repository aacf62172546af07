"""Shards of bounded size by extendible hashing, in DataFrame functions only.

A document's address is a string of hash bits: 60 bits of its id's digest, then 60
bits drawn for its row, which split rows of one id.  The directory starts with one
bucket; a bucket over the byte limit is split on its next bit, the others stay, until
every bucket fits.  Sizes are summed per address prefix, twelve bits at a time, so a
round looks at a table of prefixes and only the rows of oversized buckets go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.session import materialise

SHARD_BYTES = 1 << 20
STEP = 12
BITS = 60


def _bits(digest: Column) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversized) for each row.

    ``shard`` is the bucket's address prefix ('' if all fits into one shard) and
    ``depth`` its length.  A null text has no bytes; a null id has the address of an
    empty one.  Rows that repeat an id share their first 60 bits and are split on the
    bits of their rows.  A single row over the limit cannot be split: it is a shard of
    its own, marked ``oversized``.  Other columns are not read.
    """
    rows = materialise(
        docs.select(
            docs["doc_id"],
            F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"),
            F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).alias("own"),
            F.md5(F.monotonically_increasing_id().cast("string")).alias("drawn"),
        ),
        "addresses",
    )
    rows = rows.withColumn("address", F.concat(_bits(F.col("own")), _bits(F.col("drawn"))))
    rows = rows.select("doc_id", "n_bytes", "address")
    total = rows.agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    done: list[DataFrame] = []
    if not total["n"] or total["bytes"] <= limit:
        done.append(rows.withColumns({"shard": F.lit(""), "shard_bytes": F.lit(total["bytes"] or 0).cast("long")}))
    else:
        for depth in range(0, 2 * BITS, STEP):
            placed, rows, more = _split(rows, depth, limit)
            done.append(placed)
            if not more:
                break
        else:  # equal bits to the last: single rows, or rows that nothing tells apart
            done.append(rows.select("doc_id", "n_bytes", "address", F.col("address").alias("shard"), F.col("n_bytes").alias("shard_bytes")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        "doc_id",
        "n_bytes",
        "shard",
        F.length("shard").cast("long").alias("depth"),
        F.col("shard_bytes").cast("long").alias("shard_bytes"),
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def _split(rows: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame, bool]:
    """Twelve more bits for buckets that all are over the limit.

    Returns the rows whose bucket now fits (or holds one row), the others, and
    whether there are others.
    """
    end = depth + STEP
    cell = F.substring("address", 1, end)
    cells = materialise(
        rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")),
        "cells",
    )
    at = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(depth + 1), F.lit(end))).alias("d"))
    buckets = (
        at.select("bytes", "n", F.substring("cell", F.lit(1), F.col("d")).alias("bucket"))
        .groupBy("bucket")
        .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n"))
    )
    fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("n") == 1))
    # a cell's shard is the shortest prefix that fits: its longer ones fit as well
    shard = (
        at.select("cell", F.substring("cell", F.lit(1), F.col("d")).alias("bucket"))
        .join(fits, "bucket")
        .groupBy("cell")
        .agg(F.min(F.struct(F.length("bucket").alias("d"), F.col("bucket").alias("shard"), "shard_bytes")).alias("s"))
    )
    found = materialise(
        cells.select("cell").join(shard, "cell", "left").select("cell", "s.shard", "s.shard_bytes"), "directory"
    )
    more = found.filter("shard IS NULL").limit(1).count() > 0
    joined = rows.withColumn("cell", cell).join(found, "cell").drop("cell")
    left = joined.filter("shard IS NULL").select("doc_id", "n_bytes", "address")
    return joined.filter("shard IS NOT NULL"), materialise(left, "oversized") if more else left, more


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, text: str = "text") -> None:
    """Write ``docs`` with one folder for each shard, all columns unchanged.

    The folders are named by a column that ``docs`` lacks: ``shard``, else ``shard_1`` and
    so on.  Rows of one id are in one shard, the first that any of them is assigned to.
    """
    name, n = "shard", 0
    while name in docs.columns:
        n += 1
        name = f"shard_{n}"
    shards = assign_shards(docs, limit, text).groupBy(F.col("doc_id").alias("id")).agg(F.min("shard").alias("to"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own"))
    joined = rows.join(shards, F.col("own").eqNullSafe(F.col("id"))).select("row.*", F.col("to").alias(name))
    joined.repartition(name).write.partitionBy(name).parquet(path)
