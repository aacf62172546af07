"""Exact nearest-neighbour graphs and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gripelens.functions.vectors import as_doubles, on_sphere
from gripelens.operators.cells import (
    CELL_ROWS,
    Block,
    CellTree,
    blocks,
    build_cells,
    cell_pairs,
    pair_distances,
    radius_facts,
    search,
    slack,
    slices,
    smallest_per_row,
    squared_distances,
)
from gripelens.session import materialise, materialise_with


def prepared(points: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    """(id, vec) with distances that order like ``metric``.

    Vectors have one length, the most frequent one.  Rows with a null key, a null vector,
    another length or a component that is null or not a number are set aside: they have
    no distances.
    """
    v = as_doubles(F.col(vector))
    rows = points.select(F.col(key).alias("id"), v.alias("vec"))
    whole = F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))
    size = rows.filter(whole).agg(F.mode(F.size("vec"), deterministic=True)).first()[0]
    rows = rows.filter(whole & (F.size("vec") == F.lit(size)))
    if metric == "cosine":
        return rows.withColumn("vec", on_sphere(F.col("vec")))
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    return rows


def distinct_vectors(points: DataFrame) -> DataFrame:
    """One row per distinct vector: (id of its first point, vec, copies).

    Copies are folded before any distance work; the counts combine on the map
    side, so a vector shared by a third of the points costs one group.
    """
    return points.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def members_of(points: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, rep): every point with the first point of its vector."""
    reps = distinct.select(F.col("id").alias("rep"), "vec", F.xxhash64("vec").alias("_h"))
    keyed = points.withColumn("_h", F.xxhash64("vec"))
    return keyed.join(reps, ["_h", "vec"]).select("id", "rep")


def _closest(block: Block, k: int) -> tuple[np.ndarray, ...]:
    """(row, other row, distance) of the ``k`` nearest others of each point of a block.

    Points are in the order of their ids.
    """
    found: list[tuple[np.ndarray, ...]] = []
    vec = block.vec
    rounding = slack(vec, vec)
    take = min(k, len(block))
    for s in slices(len(block), len(block)):
        rough = squared_distances(vec[s], vec)
        rough[np.arange(len(rough)), np.arange(s.start, s.start + len(rough))] = np.inf
        limit = np.partition(rough, take - 1, axis=1)[:, take - 1] + rounding
        rows, cols = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        rows += s.start
        away = pair_distances(vec, vec, rows, cols)
        keep = smallest_per_row(rows, [away, cols], k) if len(rows) else rows
        found.append((rows[keep], cols[keep], away[keep]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _candidates(rough: np.ndarray, limit: np.ndarray, k: int, rounding: float) -> tuple[np.ndarray, np.ndarray]:
    """Where squared distances are within the limit of their row; if these are many, those
    that may be among the ``k`` least."""
    near = rough <= limit[:, None]
    if rough.shape[1] > k and np.count_nonzero(near) > 4 * k * len(rough):
        least = np.partition(rough, k - 1, axis=1)[:, k - 1] + rounding
        near = rough <= np.minimum(limit, least)[:, None]
    rows, cols = np.divmod(np.flatnonzero(near), rough.shape[1])
    whole = np.isfinite(rough[rows, cols])
    return rows[whole], cols[whole]


def _closest_others(q: Block, p: Block, k: int) -> tuple[np.ndarray, ...]:
    """(query, point, distance) of the ``k`` nearest points of each query within its radius.

    Points are in the order of their ids.  They are met piece by piece, and what was found
    narrows the radius for the next piece.
    """
    rounding = slack(q.vec, p.vec)
    limit = np.square(q.more["radius"]) + rounding
    # squared distances as one product: -2 x y + |x|^2 * 1 + 1 * |y|^2
    left = np.column_stack([-2.0 * q.vec, np.einsum("ij,ij->i", q.vec, q.vec), np.ones(len(q))])
    right = np.column_stack([p.vec, np.ones(len(p)), np.einsum("ij,ij->i", p.vec, p.vec)])
    rows, cols, away = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for at in range(0, len(p), CELL_ROWS):
        piece = right[at : at + CELL_ROWS].T
        parts = []
        for s in slices(len(q), 16 * piece.shape[1]):  # few enough to stay in a core's cache
            i, j = _candidates(left[s] @ piece, limit[s], k, rounding)
            parts.append((i + s.start, j + at))
        i, j = (np.concatenate(part) for part in zip(*parts))
        if not len(i):
            continue
        away = np.concatenate([away, pair_distances(q.vec, p.vec, i, j)])
        rows, cols = np.concatenate([rows, i]), np.concatenate([cols, j])
        keep = smallest_per_row(rows, [away, cols], k)
        rows, cols, away = rows[keep], cols[keep], away[keep]
        count = np.bincount(rows, minlength=len(q))
        full = np.flatnonzero(count == k)
        limit[full] = np.minimum(limit[full], np.square(away[np.cumsum(count)[full] - 1]) + rounding)
    return rows, cols, away


def _nearest(k: int):
    def reduce(q: Block, p: Block) -> dict[str, np.ndarray]:
        rows, cols, away = _closest_others(q, p, k)
        return {"src": q.ids[rows], "dst": p.ids[cols], "dist": away}

    return reduce


def _inside(tree: CellTree, k: int) -> DataFrame:
    """(cell, radius, src, dst, dist): the neighbours within each leaf cell, as lists.

    ``radius`` has, for each point, a distance within which its k neighbours are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(blocks(batch)):
                rows, cols, away = _closest(block, k)
                radius = block.more["bound"].copy()
                if len(block) > k:
                    np.minimum.at(radius, rows[k - 1 :: k], away[k - 1 :: k])
                lists = (radius * (1 + 1e-9), block.ids[rows], block.ids[cols], away)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cell").slice(i, 1), *[pa.array([x], t) for x, t in zip(lists, types)]],
                    names=["cell", "radius", "src", "dst", "dist"],
                )

    ids = tree.packed.schema["ids"].dataType
    key = to_arrow_type(ids)
    types = [pa.list_(pa.float64()), key, key, pa.list_(pa.float64())]
    kind = ids.simpleString()
    schema = f"cell string, radius array<double>, src {kind}, dst {kind}, dist array<double>"
    return tree.packed.mapInArrow(run, schema)


def _top(candidates: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_in_cells(tree: CellTree, k: int) -> DataFrame:
    """Exact (src, dst, dist, rank) for the points of a tree built with ``near=k``.

    Each leaf cell is first searched by itself.  The k-th distance found there, or the
    one to k pivots if that is less, is a point's radius for the other cells.
    """
    own = materialise(_inside(tree, k), "inside")
    near = own.select(F.inline(F.arrays_zip("src", "dst", "dist")))
    if not tree.split:
        return _top(near, k)
    sides = own.select("cell", "radius")
    pairs = cell_pairs(tree, radius_facts(sides)).filter("q_cell <> p_cell")
    schema = f"src {tree.kind}, dst {tree.kind}, dist double"
    far = search(tree, materialise(pairs, "pairs"), _nearest(k), schema, sides)
    return _top(near.union(far), k)


def knn_graph(
    points: DataFrame,
    k: int = 15,
    metric: str = "cosine",
    key: str = "feedback_id",
    vector: str = "embedding",
) -> DataFrame:
    """Exact k nearest other points: (src, dst, rank, dist), ties by ``dst``.

    Equal vectors are searched once.  A point's neighbours are then chosen among
    the first k + 1 points of its own vector and the first k of each
    neighbouring vector, which is enough for an exact answer.
    """
    pts = prepared(points, key, vector, metric)
    distinct, count = materialise_with(
        distinct_vectors(pts), "distinct", folded=F.count("*"), total=F.sum("copies")
    )
    if not count["folded"]:
        kind = distinct.schema["id"].dataType.simpleString()
        schema = f"src {kind}, dst {kind}, rank int, dist double"
        return distinct.sparkSession.createDataFrame([], schema)
    edges = nearest_in_cells(build_cells(distinct.select("id", "vec"), k), k)
    if count["folded"] < count["total"]:
        edges = _expand(pts, distinct, edges, k)
    if metric == "cosine":
        edges = edges.withColumn("dist", F.col("dist") * F.col("dist") / 2.0)
    return edges.select("src", "dst", "rank", "dist")


def _expand(points: DataFrame, distinct: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    members = materialise(members_of(points, distinct), "members")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    heads = members.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    near = edges.select("src", F.col("dst").alias("rep"), "dist").join(heads, "rep")
    candidates = near.select("src", F.col("id").alias("dst"), "dist").union(
        heads.select("rep", "id", F.lit(0.0))
    )
    lists = (
        _top(candidates, k + 1)
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("_near"))
    )
    others = F.slice(F.filter("_near", lambda n: n["dst"] != F.col("id")), 1, k)
    return (
        members.join(lists.withColumnRenamed("src", "rep"), "rep")
        .select(F.col("id").alias("src"), F.posexplode(others).alias("_at", "_n"))
        .select("src", "_n.dst", "_n.dist", (F.col("_at") + 1).alias("rank"))
    )


def core_distances(knn: DataFrame, min_samples: int = 10) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th other point."""
    return knn.filter(F.col("rank") == min_samples).select(
        F.col("src").alias("id"), F.col("dist").alias("core")
    )


def mutual_reachability(knn: DataFrame, core: DataFrame) -> DataFrame:
    """Edges with weight = max of both core distances and the distance."""
    return (
        knn.join(core.select(F.col("id").alias("src"), F.col("core").alias("_a")), "src")
        .join(core.select(F.col("id").alias("dst"), F.col("core").alias("_b")), "dst")
        .select("src", "dst", "dist", F.greatest("_a", "_b", "dist").alias("weight"))
    )


def _bandwidths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``sigma``, which solves sum(exp(-excess / sigma)) = log2(k), by bisection."""
    for batch in batches:
        lists = batch.column("excess")
        sizes = np.diff(lists.offsets.to_numpy())
        table = np.full((len(sizes), max(sizes.max(initial=1), 1)), np.inf)
        table[np.arange(table.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
        target = np.log2(np.maximum(sizes, 2))
        low, high = np.full(len(table), 1e-12), np.full(len(table), 1e12)
        with np.errstate(over="ignore", under="ignore"):
            for _ in range(128):
                middle = np.sqrt(low * high)
                too_wide = np.exp(-table / middle[:, None]).sum(axis=1) > target
                high = np.where(too_wide, middle, high)
                low = np.where(too_wide, low, middle)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.sqrt(low * high))], names=[*batch.schema.names, "sigma"]
        )


def fuzzy_graph(knn: DataFrame) -> DataFrame:
    """Symmetric neighbour weights (src < dst, weight) of a kNN graph.

    rho is the nearest distance, sigma makes the weights of a point add up to
    log2(k); both directions combine as a + b - a * b.
    """
    lists = knn.groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("_n")
    )
    rho = F.element_at("_n", 1)["dist"]
    excess = F.transform("_n", lambda n: F.greatest(n["dist"] - rho, F.lit(0.0)))
    kind = knn.schema["dst"].dataType.simpleString()
    key = knn.schema["src"].dataType.simpleString()
    lists = lists.select("src", F.col("_n.dst").alias("dst"), excess.alias("excess"))
    scaled = lists.mapInArrow(_bandwidths, f"src {key}, dst array<{kind}>, excess array<double>, sigma double")
    directed = scaled.select("src", F.inline(F.arrays_zip("dst", "excess")), "sigma").select(
        "src", "dst", F.exp(-F.col("excess") / F.col("sigma")).alias("w")
    )
    forward = F.col("src") < F.col("dst")
    both = directed.groupBy(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).agg(
        F.coalesce(F.max(F.when(forward, F.col("w"))), F.lit(0.0)).alias("a"),
        F.coalesce(F.max(F.when(~forward, F.col("w"))), F.lit(0.0)).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return both.select("src", "dst", (a + b - a * b).alias("weight"))
