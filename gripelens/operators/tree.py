"""Minimum spanning tree of mutual reachability, exact, as joins and searches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from gripelens.operators import skew
from gripelens.operators.cells import (
    Block,
    CellTree,
    build_cells,
    cell_pairs,
    matrix,
    pair_distances,
    search,
    slack,
    slices,
    smallest_per_row,
)
from gripelens.operators.neighbours import (
    distinct_vectors,
    members_of,
    nearest_in_cells,
    prepared,
)
from gripelens.operators.ranking import with_row_index
from gripelens.operators.skew import large_keys, spread_join
from gripelens.session import materialise, materialise_with, release

MIN_SAMPLES = 10
# A round searches the cells only when the neighbour lists settle fewer than
# this share of the components.
SEARCH_BELOW = 0.25
# So many pointers are followed in one task, which then holds 16 bytes for each and a few
# copies.
FEW = 1 << 19


@dataclass
class Reachability:
    """Distinct vectors as vertices with integer ids, in the order of their keys.

    ``vertices``: (id, rep, copies, core, reach), where every point that is not
    in the vertex's neighbour list is at least ``reach`` away.
    ``edges``: (lo, hi, dist) from the neighbour lists and within the cell tree.
    ``members``: (point, rep).
    """

    index: CellTree
    vertices: DataFrame
    edges: DataFrame
    members: DataFrame


def reachability(
    points: DataFrame, min_samples: int, key: str, vector: str, metric: str = "euclidean"
) -> Reachability:
    """Fold copies, number the distinct vectors, find neighbours and core distances.

    The core distance counts copies as points.  It is 0 where a vector has more
    than ``min_samples`` copies.
    """
    pts = prepared(points, key, vector, metric)
    distinct = distinct_vectors(pts).withColumnRenamed("id", "rep")
    if isinstance(pts.schema["id"].dataType, IntegralType):
        distinct = distinct.withColumn("id", F.col("rep").cast("long"))
    else:
        distinct = with_row_index(distinct, ["rep"], "id")
    distinct, count = materialise_with(
        distinct, "distinct", folded=F.count("*"), total=F.sum("copies")
    )
    total, folded = count["total"], count["folded"]
    members = pts.select(F.col("id").alias("point"), F.col("id").alias("rep"))
    if folded < total:
        members = members_of(pts, distinct.select(F.col("rep").alias("id"), "vec"))
        members = materialise(members.withColumnRenamed("id", "point"), "members")
    k = 2 * min_samples
    index = build_cells(distinct.select("id", "vec"), k)
    knn = materialise(nearest_in_cells(index, k), "neighbours")

    wanted = min(min_samples, total - 1)
    weights = distinct.select("id", "rep", "copies")
    so_far = Window.partitionBy("src").orderBy("rank")
    reached = (
        knn.join(weights.select(F.col("id").alias("dst"), F.col("copies").alias("_w")), "dst")
        .withColumn("_others", F.sum("_w").over(so_far))
        .join(weights.select(F.col("id").alias("src"), "copies"), "src")
        .groupBy("src")
        .agg(
            F.min(
                F.when(F.col("_others") + F.col("copies") - 1 >= wanted, F.col("dist"))
            ).alias("_core"),
            F.when(F.count("*") >= k, F.max("dist")).alias("_reach"),
        )
    )
    vertices = weights.join(reached.withColumnRenamed("src", "id"), "id", "left").select(
        "id",
        "rep",
        "copies",
        F.when(F.col("copies") - 1 >= wanted, F.lit(0.0))
        .otherwise(F.coalesce("_core", F.lit(0.0)))
        .alias("core"),
        F.coalesce("_reach", F.lit(float("inf"))).alias("reach"),
    )
    edges = knn.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "dist")
    if index.split:
        edges = edges.union(tree_edges(index))
    edges = edges.groupBy("lo", "hi").agg(F.min("dist").alias("dist"))
    return Reachability(index, materialise(vertices, "vertices"), edges, members)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs among the pivots of each family, at most ``FAN`` and the one above."""
    for batch in batches:
        lists = batch.column("pivots")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids, vec = lists.flatten().flatten()
        ids, vec = ids.to_numpy(), matrix(vec)
        found = [np.triu_indices(b - a, 1) for a, b in zip(ends[:-1], ends[1:])]
        i = np.concatenate([x + a for (x, _), a in zip(found, ends)] or [np.zeros(0, int)])
        j = np.concatenate([x + a for (_, x), a in zip(found, ends)] or [np.zeros(0, int)])
        away = pair_distances(vec, vec, i, j)
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        keep = low < high
        yield pa.RecordBatch.from_arrays(
            [pa.array(low[keep]), pa.array(high[keep]), pa.array(away[keep])], names=["lo", "hi", "dist"]
        )


def tree_edges(index: CellTree) -> DataFrame:
    """(lo, hi, dist): each point to the pivot of its cell, and pivots of one family.

    A family is the children of a cell and its own pivot.  These edges connect all
    points, so every component knows an edge that leaves it, and thereby a radius.
    """
    cells = index.cells
    inner = index.packed.select("cell", F.inline(F.arrays_zip(F.col("ids").alias("id"), "away")))
    inner = inner.join(cells.select("cell", "pivot_id"), "cell").filter("id <> pivot_id")
    inner = inner.select(F.least("id", "pivot_id").alias("lo"), F.greatest("id", "pivot_id").alias("hi"), "away")
    pivot = F.struct("pivot_id", "pivot")
    kids = cells.select(F.col("parent").alias("family"), pivot.alias("p"))
    heads = cells.join(cells.select(F.col("parent").alias("cell")).distinct(), "cell", "left_semi")
    families = kids.union(heads.select("cell", pivot)).groupBy("family").agg(F.collect_list("p").alias("pivots"))
    return inner.union(families.select("pivots").mapInArrow(_around, "lo long, hi long, dist double"))


# Contraction --------------------------------------------------------------


def contract(hooks: DataFrame, count: int | None = None) -> DataFrame:
    """(id, root) for hooks (id, parent) without cycles longer than two.

    Two nodes that point at each other are rooted at the smaller.  Up to ``FEW`` hooks,
    if so many are known to be there, are followed in one task.
    """
    if count is not None and count <= FEW:
        return materialise(hooks.repartition(1).mapInArrow(_rooted, "id long, root long"), "roots")
    back = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("_back"))
    is_root = (F.col("_back") == F.col("id")) & (F.col("id") < F.col("parent"))
    inner = hooks.select("id").alias("h")
    pointers = hooks.join(back, "parent", "left").select(
        "id", F.when(is_root, F.col("id")).otherwise(F.col("parent")).alias("root")
    )
    tops = hooks.select(F.col("parent").alias("id")).distinct().join(inner, "id", "left_anti")
    return resolve(pointers.union(tops.select("id", F.col("id").alias("root"))))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("root", pa.int64())]))
    table = table.sort_by("id")
    ids, root = (table.column(c).to_numpy() for c in ("id", "root"))
    to = np.append(np.searchsorted(ids, root), len(ids))
    to[:-1][~np.isin(root, ids)] = len(ids)  # those that end nowhere are left out
    while (to != to[to]).any():
        to = to[to]
    ends = to[:-1]
    found = ends < len(ids)
    yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(ids[ends[found]])], names=["id", "root"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("parent", pa.int64())]))
    hook, parent = (table.column(c).to_numpy() for c in ("id", "parent"))
    ids, spot = np.unique(np.concatenate([hook, parent]), return_inverse=True)
    to = np.arange(len(ids))
    to[spot[: len(hook)]] = spot[len(hook) :]
    own = np.arange(len(ids))
    to = np.where((to[to] == own) & (own < to), own, to)
    while (to != to[to]).any():
        to = to[to]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[to])], names=["id", "root"])


def resolve(pointers: DataFrame, count: int | None = None) -> DataFrame:
    """Follow (id, root) pointers to their ends, which point at themselves.

    Each round follows four pointers at once, so the rounds grow with the
    logarithm of the longest chain.  Up to ``FEW`` pointers, if so many are known to be
    there, are followed in one task.
    """
    pointers = pointers.select("id", "root")
    if count is not None and count <= FEW:
        return materialise(pointers.repartition(1).mapInArrow(_followed, "id long, root long"), "pointers")
    while True:
        step = pointers.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        doubled = pointers.join(step, "root").select("id", F.col("_next").alias("root"))
        again = doubled.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        doubled = doubled.join(again, "root").withColumn("_moved", F.col("_next") != F.col("root"))
        doubled = doubled.select("id", F.col("_next").alias("root"), "_moved")
        doubled, facts = materialise_with(doubled, "pointers", moves=F.count_if("_moved"))
        pointers = doubled.select("id", "root")
        if not facts["moves"]:
            return pointers


def relabel(df: DataFrame, column: str, roots: DataFrame, large: list[int] | None = None) -> DataFrame:
    """Replace component ids in ``column`` by their root; others stay.

    Rows of the ``large`` components are joined to the few roots of these alone, which go
    to all tasks; the rest has no key that many rows share.
    """
    named = roots.select(F.col("id").alias(column), F.col("root").alias("_root"))
    return spread_join(df, named, column, large or []).withColumn(column, F.coalesce("_root", column)).select(*df.columns)


# Search for edges that no neighbour list holds -----------------------------


def _nearest_foreign(q: Block, p: Block) -> dict[str, np.ndarray]:
    """Per component that asks, the cheapest edge to a point of another one in the block."""
    q = q.take(np.flatnonzero(q.more["radius"] >= 0))
    found: list[tuple[np.ndarray, ...]] = []
    core, other = q.more["core"], p.more["core"]
    mine, theirs = q.more["component"], p.more["component"]
    rounding = 4 * slack(q.vec, p.vec)
    most = np.square(q.more["radius"])
    # squared distances as one product: -2 x y + |x|^2 * 1 + 1 * |y|^2
    left = np.column_stack([-2.0 * q.vec, np.einsum("ij,ij->i", q.vec, q.vec), np.ones(len(q))])
    right = np.vstack([p.vec.T, np.ones(len(p)), np.einsum("ij,ij->i", p.vec, p.vec)])
    near, far = np.square(core), np.square(other)[None, :]
    for s in slices(len(q), 16 * len(p)):  # few enough to stay in a core's cache
        rough = left[s] @ right
        np.maximum(rough, near[s, None], out=rough)
        np.maximum(rough, far, out=rough)
        np.copyto(rough, np.inf, where=mine[s, None] == theirs[None, :])
        limit = np.minimum(rough.min(axis=1), most[s]) + rounding
        rows, cols = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(p))
        whole = np.isfinite(rough[rows, cols])
        found.append((rows[whole] + s.start, cols[whole]))
    rows, cols = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int),) * 2
    dist = pair_distances(q.vec, p.vec, rows, cols)
    weight = np.maximum(np.maximum(core[rows], other[cols]), dist)
    lo, hi = np.minimum(q.ids[rows], p.ids[cols]), np.maximum(q.ids[rows], p.ids[cols])
    best = smallest_per_row(mine[rows], [weight, dist, lo, hi], 1) if len(rows) else rows
    rows, cols = rows[best], cols[best]
    return {
        "component": mine[rows], "weight": weight[best], "dist": dist[best],
        "lo": lo[best], "hi": hi[best], "other": theirs[cols],
    }


def _searched(
    graph: Reachability, labels: DataFrame, open_components: DataFrame, large: list[int]
) -> DataFrame:
    """Cheapest outgoing edge of each open component among all points.

    ``labels``: (id, cell, core, reach, component); ``open_components``: (component,
    weight of the best listed edge or null).  Vectors stay where they are but for those
    of leaf cells that meet another one; cells within one component never do.
    """
    asked = open_components.select("component", F.coalesce("weight", F.lit(float("inf"))).alias("radius"))
    asking = spread_join(labels, asked, "component", large)
    useful = (F.col("reach") <= F.col("radius")) & (F.col("core") <= F.col("radius"))
    radius = F.when(F.coalesce(useful, F.lit(False)), F.col("radius"))
    point = F.struct("id", "component", "core", F.coalesce(radius, F.lit(-1.0)).alias("radius"))
    sides = asking.groupBy("cell").agg(
        F.max(radius).alias("need"),
        F.min("component").alias("low_mark"),
        F.max("component").alias("high_mark"),
        F.sort_array(F.collect_list(point)).alias("_p"),
    )
    lists = [F.col(f"_p.{c}").alias(c) for c in ("component", "core", "radius")]
    sides = materialise(sides.select("cell", "need", "low_mark", "high_mark", *lists), "sides")
    pairs = materialise(cell_pairs(graph.index, sides.select("cell", "need", "low_mark", "high_mark")), "pairs")
    schema = "component long, weight double, dist double, lo long, hi long, other long"
    return search(graph.index, pairs, _nearest_foreign, schema, sides.select("cell", "component", "core", "radius"))


# Borůvka rounds -------------------------------------------------------------

_ORDER = ("weight", "dist", "lo", "hi", "other")


def _cheapest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("component").agg(F.min(F.struct(*_ORDER)).alias("e"))


def spanning_edges(graph: Reachability) -> DataFrame:
    """Exact tree edges (lo, hi, weight) over the vertices.

    Each round every component picks its cheapest edge by (weight, dist, lo, hi).
    A pick from the neighbour lists is final if it is cheaper than anything the
    lists may lack; when too few picks are, the others search the cells, all but
    the largest component, which the rest joins.
    """
    spark = graph.vertices.sparkSession
    core = graph.vertices.select("id", "core")
    places = graph.index.packed.select("cell", F.explode("ids").alias("id"))
    labels = graph.vertices.join(places, "id").select("id", "cell", "core", "reach", F.col("id").alias("component"))
    labels = materialise(labels, "labels")
    known = labels.select("component", "reach", F.lit(1).cast("long").alias("size"))
    edges = (
        graph.edges.join(core.select(F.col("id").alias("lo"), F.col("core").alias("_a")), "lo")
        .join(core.select(F.col("id").alias("hi"), F.col("core").alias("_b")), "hi")
        .select(
            "lo", "hi", "dist",
            F.greatest("_a", "_b", "dist").alias("weight"),
            F.col("lo").alias("c_lo"),
            F.col("hi").alias("c_hi"),
        )
    )
    edges = materialise(edges, "edges")
    tree, pending = None, []
    while True:
        sides = edges.select(
            "weight", "dist", "lo", "hi",
            F.inline(
                F.array(
                    F.struct(F.col("c_lo").alias("component"), F.col("c_hi").alias("other")),
                    F.struct(F.col("c_hi").alias("component"), F.col("c_lo").alias("other")),
                )
            ),
        )
        final = F.coalesce(F.col("e.weight") < F.col("reach"), F.lit(False))
        state = known.join(_cheapest(sides), "component", "left").withColumn("final", final)
        state, facts = materialise_with(
            state,
            "state",
            n=F.count("*"),
            final=F.count_if("final"),
            largest=F.max_by("component", F.struct("size", "component")),
            total=F.sum("size"),
            most=F.max("size"),
        )
        if facts["n"] <= 1:
            break
        large = large_keys(state, "component", facts["total"], "size") if facts["most"] > skew.LARGE else []
        picks = state.filter("final").select("component", "e.*")
        if facts["final"] < SEARCH_BELOW * facts["n"]:
            undecided = state.filter(
                ~F.col("final") & (F.col("component") != facts["largest"])
            )
            open_ = undecided.select("component", F.col("e.weight").alias("weight"))
            last = labels
            for roots in pending:
                labels = relabel(labels, "component", roots, large)
            labels, pending = materialise(labels, "labels"), []
            release(last)
            found = _searched(graph, labels, open_, large)
            listed = undecided.filter(F.col("e").isNotNull()).select("component", "e.*")
            found = _cheapest(found.union(listed.select(*found.columns)))
            picks = picks.union(found.select("component", "e.*"))
            picks = materialise(picks, "picks")
        chosen = picks.select("lo", "hi", "weight").distinct()
        tree = chosen if tree is None else tree.union(chosen)
        hooks = picks.select(F.col("component").alias("id"), F.col("other").alias("parent"))
        roots = contract(hooks, facts["n"])
        pending.append(roots)  # the points learn of it when they are asked
        known = (
            relabel(state.select("component", "reach", "size"), "component", roots)
            .groupBy("component")
            .agg(F.min("reach").alias("reach"), F.sum("size").alias("size"))
        )
        last = edges
        edges = relabel(relabel(edges, "c_lo", roots, large), "c_hi", roots, large)
        edges = materialise(edges.filter(F.col("c_lo") != F.col("c_hi")), "edges")
        release(last)
    if tree is None:
        return spark.createDataFrame([], StructType.fromDDL("lo long, hi long, weight double"))
    return tree


def minimum_spanning_tree(
    points: DataFrame,
    min_samples: int = MIN_SAMPLES,
    key: str = "feedback_id",
    vector: str = "embedding",
    metric: str = "euclidean",
) -> DataFrame:
    """(src, dst, weight): n - 1 edges of least total mutual reachability.

    Copies of a vector hang on its first point by an edge of its core distance.
    """
    graph = reachability(points, min_samples, key, vector, metric)
    names = graph.vertices.select("id", "rep")
    between = (
        spanning_edges(graph)
        .join(names.select(F.col("id").alias("lo"), F.col("rep").alias("src")), "lo")
        .join(names.select(F.col("id").alias("hi"), F.col("rep").alias("dst")), "hi")
        .select("src", "dst", "weight")
    )
    copies = (
        graph.members.filter(F.col("point") != F.col("rep"))
        .join(graph.vertices.select("rep", "core"), "rep")
        .select(F.col("rep").alias("src"), F.col("point").alias("dst"), F.col("core").alias("weight"))
    )
    return between.union(copies)
