"""Silhouette of clusters by a nearest-centre search with weights.

The mean squared distance of x to the points of a cluster with centre m and mean square
norm s is |x - m|^2 + w, where w = s - |m|^2 is the cluster's spread.  With one more
coordinate that is a plain distance: of (x, 0) to (m, sqrt(w)).  So the nearest other
cluster of a point is a nearest-neighbour search among lifted centres, over the cell
tree that the other searches use.

If r is the distance of a point to its own lifted centre and d that of this centre to
its nearest other, the wanted centre is within d + 2 r of the own one.  The largest such
radius of a cell of centres names the cells it has to meet; the points of its clusters
are dealt to tasks that hold a few packed cells of centres each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.functions.vectors import as_doubles, dot
from gripelens.operators.cells import PARTNERS, blocks, build_cells, cell_pairs, joined, matrix, slices
from gripelens.operators.neighbours import distinct_vectors, members_of, nearest_in_cells
from gripelens.operators.reports import without_noise
from gripelens.operators.skew import large_keys, spread_join
from gripelens.session import materialise, materialise_with, release

# Bytes of vectors of points that one task holds.
PART_BYTES = 16 << 20


def _centres(points: DataFrame) -> DataFrame:
    """(id, n, centre, spread, vec) of each cluster; ``vec`` is the lifted centre."""
    sums = points.groupBy(F.col("own").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(dot(F.col("x"), F.col("x"))).alias("_square"),
        vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("centre"),
    )
    # rounding may leave a spread just below zero
    spread = F.greatest(F.col("_square") - dot(F.col("centre"), F.col("centre")), F.lit(0.0))
    lifted = F.concat("centre", F.array(F.sqrt("spread")))
    return sums.withColumn("spread", spread).withColumn("vec", lifted).drop("_square")


def _others(points: DataFrame, packed: DataFrame, pairs: DataFrame, cells: DataFrame, dim: int) -> DataFrame:
    """(row, least): least squared distance to the lifted centre of another group.

    ``points``: (row, cell, group, x); ``packed``: the cells of centres; ``pairs``: which
    of them meet; ``cells``: (cell, n), the points of each.
    """
    rows = max(1024, PART_BYTES // (8 * max(dim, 1)))
    layout = pairs.groupBy("q_cell").agg(F.ceil(F.count("*") / PARTNERS).alias("chunks"))
    sizes = cells.agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("many")).first()
    parts = max(1, min(-(-(sizes["most"] or 0) // rows), (1 << 16) // max(sizes["many"], 1)))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    left = points.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    large = large_keys(cells, "cell", sizes["total"] or 0)
    left = spread_join(left, layout.withColumnRenamed("q_cell", "cell"), "cell", large)
    left = left.withColumn("chunk", chunk).drop("chunks")
    right = (
        pairs.join(layout, "q_cell")
        .select("q_cell", F.pmod(F.xxhash64("p_cell"), "chunks").alias("c"), F.col("p_cell").alias("cell"))
        .join(packed.select("cell", "ids", "vecs"), "cell")
        .select("q_cell", "c", every.alias("p"), "ids", "vecs")
    )

    def nearest(mine: pa.Table, centres: pa.Table) -> pa.Table:
        if not mine.num_rows or not centres.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "least": pa.array([], pa.float64())})
        c = joined(blocks(centres))
        x, group = matrix(mine.column("x")), mine.column("group").to_numpy()
        least = np.full(len(x), np.inf)
        for s in slices(len(x), c.vec.size):
            diff = x[s][:, None, :] - c.vec[None, :, :-1]
            away = np.einsum("ijk,ijk->ij", diff, diff) + np.square(c.vec[:, -1])[None, :]
            away[group[s][:, None] == c.ids[None, :]] = np.inf
            least[s] = away.min(axis=1)
        return pa.table({"row": mine.column("row"), "least": pa.array(least)})

    met = left.groupBy("cell", "part", "chunk").cogroup(right.groupBy("q_cell", "p", "c"))
    found = met.applyInArrow(nearest, "row long, least double")
    return found.groupBy("row").agg(F.min("least").alias("least"))


def point_scores(clustered: DataFrame, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(row, own, n, within, beside): for each point that is not noise, the size of its
    cluster and the mean squared distances to its own cluster, itself left out, and to the
    nearest other one; null without such points.
    """
    points = materialise(
        without_noise(clustered)
        .select("feedback_id", F.col("cluster_id").cast("long").alias("own"))
        .join(vectors.select("feedback_id", as_doubles(F.col(column)).alias("x")), "feedback_id")
        .filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
        .select("own", "x", F.monotonically_increasing_id().alias("row")),
        "points",
    )
    centres, seen = materialise_with(_centres(points), "centres", total=F.sum("n"), dim=F.max(F.size("centre")))
    lifted = materialise(distinct_vectors(centres.select("id", "vec")), "lifted")
    groups = members_of(centres.select("id", "vec"), lifted).withColumnRenamed("rep", "group")
    tree = build_cells(lifted.select("id", "vec"), 1)
    nearest = nearest_in_cells(tree, 1).select(F.col("src").alias("group"), F.col("dist").alias("gap"))
    places = tree.packed.select("cell", F.explode("ids").alias("group"))
    twin = lifted.select(F.col("id").alias("group"), (F.col("copies") > 1).alias("twin"))
    facts = (
        centres.drop("vec").join(groups, "id").join(places, "group").join(twin, "group")
        .join(nearest, "group", "left").withColumnRenamed("id", "own")
    )
    facts = materialise(facts, "facts")
    total = seen["total"] or 0
    known = spread_join(points, facts, "own", large_keys(facts, "own", total))
    diff = F.zip_with("x", "centre", lambda a, b: a - b)
    known = known.withColumn("_d", diff).withColumn("own_square", dot(F.col("_d"), F.col("_d")) + F.col("spread"))
    gap = F.when(F.col("twin"), F.lit(0.0)).otherwise(F.coalesce("gap", F.lit(float("inf"))))
    known = materialise(
        known.select(
            "row", "own", "group", "cell", "x", "n", "twin", "own_square",
            (gap + 2 * F.sqrt("own_square")).alias("radius"),
        ),
        "known",
    )
    cells = materialise(
        known.groupBy("cell").agg(F.max("radius").alias("need"), F.count("*").alias("n")), "cells"
    )
    marks = [F.lit(0).cast("long").alias("low_mark"), F.lit(1).cast("long").alias("high_mark")]
    pairs = materialise(cell_pairs(tree, cells.select("cell", "need", *marks)), "pairs")
    beside = _others(known.select("row", "cell", "group", "x"), tree.packed, pairs, cells, seen["dim"] or 1)
    n = F.col("n")
    finite = F.when(F.col("least") < float("inf"), F.col("least"))
    result = known.join(beside, "row", "left").select(
        "row",
        "own",
        "n",
        F.when(n > 1, n * F.col("own_square") / (n - 1)).alias("within"),
        F.when(F.col("twin"), F.least(finite, F.col("own_square"))).otherwise(finite).alias("beside"),
    )
    result = materialise(result, "silhouette")
    release(points, centres, lifted, facts, known, cells, pairs)
    return result


def silhouette(clustered: DataFrame, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Mean silhouette (squared Euclidean) of the points that are not noise.

    Null if they are in fewer than two clusters; a point that is its whole cluster counts
    as 0.  Points without a vector, or with a null in it, are left out.
    """
    a, b = F.col("within"), F.col("beside")
    score = F.when((F.col("n") == 1) | (a == b), 0.0).when(a < b, 1 - a / b).otherwise(b / a - 1)
    return point_scores(clustered, vectors, column).agg(
        F.avg(F.when(b.isNotNull(), score)).alias("silhouette")
    )
