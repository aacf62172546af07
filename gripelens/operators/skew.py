"""Joins whose left side may have a key that holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is large if it has so many rows and a thousandth of all; so there are at most
# a thousand large keys, whatever the input.
LARGE = 1 << 16


def large_keys(counts: DataFrame, key: str, total: int, count: str = "n") -> list:
    """The large keys of a table of counts (key, count), at most a thousand."""
    bound = max(LARGE, total // 1000)
    return [r[key] for r in counts.filter(F.col(count) > bound).select(key).collect()]


def spread_join(df: DataFrame, facts: DataFrame, key: str, large: list) -> DataFrame:
    """Left join of ``df`` with ``facts``, which has one row for each key.

    The facts of the ``large`` keys, at most a thousand rows, go to all tasks; what is
    shuffled has no key that many rows share.
    """
    if not large:
        return df.join(facts, key, "left")
    hot = F.coalesce(F.col(key).isin(large), F.lit(False))
    few = df.filter(hot).join(F.broadcast(facts.filter(hot)), key, "left")
    return few.unionByName(df.filter(~hot).join(facts.filter(~hot), key, "left"))
