"""Connected components of a link table, by Spark joins alone.

Alternating large-star and small-star steps: a node's larger neighbours are linked
to its smallest neighbour, then all its smaller neighbours are.  The links of a
component become a star around its smallest node within about log^2 n rounds,
whatever the shape.  Rounds are written to the shared scratch folder; nothing is
collected, and sums per node combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.session import materialise, materialise_with, release


def _star(links: DataFrame, all_neighbours: bool) -> DataFrame:
    """One step over links (node > label): each node's links go to its smallest."""
    if all_neighbours:
        turned = links.select(F.col("label").alias("node"), F.col("node").alias("label"))
        around = links.union(turned)
        moved = turned  # the larger neighbours
    else:
        around = moved = links
    least = around.groupBy("node").agg(F.min("label").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    ends = moved.join(least, "node").select(F.col("label").alias("node"), "least")
    if not all_neighbours:
        ends = ends.union(least)
    return ends.filter("node <> least").select("node", F.col("least").alias("label")).distinct()


def _ends(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label) with node > label of each link, once."""
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    return (
        ends.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
        .distinct()
    )


def shortened(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label): links with the same components after one round, without a check.

    A node is connected to each of its labels; it may still have several.
    """
    first = materialise(_ends(links, left, right), "links")
    star = materialise(_star(_star(first, True), False), "star")
    release(first)
    return star


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the component.

    ``links`` has two columns of one orderable type.  Self links and repeated links
    change nothing; rows with a null are not links; no links give no rows.
    """
    star = _ends(links, left, right)
    digest = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("node", "label"))}
    star, last = materialise_with(star, "links", **digest)
    while last["n"]:
        before = star
        star, seen = materialise_with(_star(_star(star, True), False), "star", **digest)
        release(before)
        if seen == last:
            break
        last = seen
    roots = star.select("label").distinct()
    found = star.union(roots.select("label", F.col("label").alias("label2")).toDF("node", "label"))
    found._scratch = vars(star).get("_scratch")  # whoever releases the result frees its table
    return found
