"""Similar pairs of vectors, with dense clumps kept as groups.

Vectors within half the radius of one of them are all similar to each other.  Such a
clump is a name and its members; two clumps that are close enough as wholes are one row
of clump names.  Only pairs whose clumps are neither are listed, so many near-equal
vectors give as many rows as vectors, not as pairs of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.functions.vectors import dot, on_sphere
from gripelens.operators.cells import (
    Block,
    CellTree,
    blocks,
    build_cells,
    cell_pairs,
    constant_facts,
    pair_distances,
    search,
    slack,
    slices,
    squared_distances,
)
from gripelens.operators.neighbours import distinct_vectors, members_of
from gripelens.session import materialise


@dataclass
class SimilarClusters:
    """Which ids are similar: those of one clump, those of two joint clumps, and pairs.

    ``members``: (id, clump) of all ids; a clump has the name of its smallest member.
    ``joint``: (a, b), a < b: every member of clump a is similar to every one of clump b.
    ``pairs``: (i, j), i < j, of members of different clumps that are not joint.
    ``vectors``: (id, vec) on the sphere.
    """

    members: DataFrame
    joint: DataFrame
    pairs: DataFrame
    vectors: DataFrame

    def listed(self) -> DataFrame:
        """(i, j, similarity), i < j: every similar pair."""
        named = self.vectors.join(self.members, "id")
        low = named.select(F.col("id").alias("i"), F.col("vec").alias("_x"), F.col("clump").alias("_a"))
        high = named.select(F.col("id").alias("j"), F.col("vec").alias("_y"), F.col("clump").alias("_b"))
        inside = low.join(high, (F.col("_a") == F.col("_b")) & (F.col("i") < F.col("j")))
        first, second = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
        across = self.joint.join(low, F.col("a") == F.col("_a")).join(high, F.col("b") == F.col("_b"))
        across = across.select(first, second, "_x", "_y")
        single = self.pairs.join(low.drop("_a"), "i").join(high.drop("_b"), "j").select("i", "j", "_x", "_y")
        every = inside.select("i", "j", "_x", "_y").union(across).union(single)
        diff = F.zip_with("_x", "_y", lambda x, y: x - y)
        return every.withColumn("_d", diff).select("i", "j", (1 - dot(F.col("_d"), F.col("_d")) / 2).alias("similarity"))


def _clumped(tree: CellTree, half: float) -> DataFrame:
    """(id, clump, away): in id order, each point joins the first clump it is near to, or
    starts one.  Clumps do not leave their leaf cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                of = np.full(len(block), -1)
                away = np.zeros(len(block))
                for i in range(len(block)):
                    if of[i] >= 0:
                        continue
                    rest = np.flatnonzero(of < 0)
                    d = pair_distances(block.vec, block.vec, rest, np.full(len(rest), i))
                    near = rest[d <= half]
                    of[near], away[near] = i, d[d <= half]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, kind), pa.array(block.ids[of], kind), pa.array(away)], names=["id", "clump", "away"]
                )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(tree.packed.schema["ids"].dataType.elementType)
    return tree.packed.mapInArrow(run, f"id {tree.kind}, clump {tree.kind}, away double")


def _near_clumps(radius: float):
    """Clumps of which some members may be similar, and whether all are."""

    def reduce(q: Block, p: Block) -> dict[str, np.ndarray]:
        found = []
        rounding = math.sqrt(slack(q.vec, p.vec)) + 1e-9
        reach = q.more["reach"][:, None] + p.more["reach"][None, :] + radius
        for s in slices(len(q), len(p)):
            away = np.sqrt(squared_distances(q.vec[s], p.vec))
            rows, cols = np.nonzero((away <= reach[s] + rounding) & (q.ids[s, None] < p.ids[None, :]))
            found.append((rows + s.start, cols))
        rows, cols = (np.concatenate(part) for part in zip(*found))
        away = pair_distances(q.vec, p.vec, rows, cols)
        widest = q.more["reach"][rows] + p.more["reach"][cols]
        return {"a": q.ids[rows], "b": p.ids[cols], "whole": away + widest <= radius - 1e-9}

    return reduce


def similar_clusters(centroids: DataFrame, threshold: float) -> SimilarClusters:
    """Which of (cluster_id, centroid) have a cosine of at least ``threshold``."""
    radius = math.sqrt(max(2.0 - 2.0 * threshold, 0.0))
    points = centroids.select(F.col("cluster_id").alias("id"), on_sphere(F.col("centroid")).alias("vec"))
    points = materialise(points, "centroids")
    distinct = materialise(distinct_vectors(points), "distinct")
    tree = build_cells(distinct.select("id", "vec"))
    clumped = materialise(_clumped(tree, max(radius / 2 - 1e-9, 0.0)), "clumped")
    copies = members_of(points, distinct.select("id", "vec"))
    members = copies.join(clumped.select(F.col("id").alias("rep"), "clump"), "rep").select("id", "clump")
    members = materialise(members, "members")

    reach = clumped.groupBy(F.col("clump").alias("id")).agg(F.max("away").alias("reach"))
    centres = materialise(distinct.select("id", "vec").join(reach, "id"), "centres")
    above = build_cells(centres.select("id", "vec"))
    places = above.packed.select("cell", F.explode("ids").alias("id")).join(centres.select("id", "reach"), "id")
    sides = places.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("id", "reach"))).alias("_p"))
    sides = materialise(sides.select("cell", F.col("_p.reach").alias("reach")), "reaches")
    cells = cell_pairs(above, constant_facts(above, 2 * radius + 1e-9))
    schema = f"a {tree.kind}, b {tree.kind}, whole boolean"
    near = materialise(search(above, cells, _near_clumps(radius), schema, sides), "near")

    named = distinct.select("id", "vec").join(clumped.select("id", "clump"), "id")
    low = named.select(F.col("clump").alias("a"), F.col("id").alias("x"), F.col("vec").alias("_x"))
    high = named.select(F.col("clump").alias("b"), F.col("id").alias("y"), F.col("vec").alias("_y"))
    diff = F.zip_with("_x", "_y", lambda x, y: x - y)
    met = near.filter("NOT whole").join(low, "a").join(high, "b").withColumn("_d", diff)
    similar = 1 - dot(F.col("_d"), F.col("_d")) / 2 >= threshold - 1e-12
    met = met.filter(similar).select("x", "y")
    copy = copies.select(F.col("rep").alias("x"), F.col("id").alias("i"))
    other = copies.select(F.col("rep").alias("y"), F.col("id").alias("j"))
    pairs = met.join(copy, "x").join(other, "y").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return SimilarClusters(members, near.filter("whole").select("a", "b"), materialise(pairs, "pairs"), points)
