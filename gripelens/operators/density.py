"""Hierarchical density clusters with noise, from the spanning tree to labels.

The result is that of the published method (excess of mass over the condensed
tree of mutual reachability, root never selected), not an approximation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.operators.ranking import with_row_index
from gripelens.operators.reports import NOISE
from gripelens.operators.tree import (
    FEW,
    contract,
    reachability,
    relabel,
    resolve,
    spanning_edges,
)
from gripelens.session import materialise, materialise_with

MIN_CLUSTER_SIZE = 10
# Merges are replayed in groups of 2 ** GROUP_BITS consecutive tree edges; a task holds about
# a kilobyte for each.
GROUP_BITS = 17


@dataclass
class DensityClusters:
    """``assignment``: (key, cluster_id, cluster_confidence); ``info``: (cluster_id, stability)."""

    assignment: DataFrame
    info: DataFrame


# Merge history ---------------------------------------------------------------


def forest_components(edges: DataFrame) -> DataFrame:
    """(id, root) of a forest given as (x, y, r), ``r`` distinct per edge.

    Every node hooks onto the end of its lowest edge, so the nodes at least
    halve each round.
    """
    edges = materialise(edges.select("x", "y", "r"), "forest")
    mapping = edges.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    mapping = materialise(mapping.withColumn("root", F.col("id")), "mapping")
    while not edges.isEmpty():
        sides = edges.select(
            "r",
            F.inline(
                F.array(
                    F.struct(F.col("x").alias("id"), F.col("y").alias("parent")),
                    F.struct(F.col("y").alias("id"), F.col("x").alias("parent")),
                )
            ),
        )
        hooks = sides.groupBy("id").agg(F.min_by("parent", "r").alias("parent"))
        roots = contract(materialise(hooks, "hooks"))
        mapping = materialise(relabel(mapping, "root", roots), "mapping")
        edges = relabel(relabel(edges, "x", roots), "y", roots)
        edges = materialise(edges.filter(F.col("x") != F.col("y")), "forest")
    return mapping


def _contract_lower(edges: DataFrame, bit: int, first_node: int) -> DataFrame:
    """Replace end points of the upper edges by what the lower edges make of them.

    Edges whose ranks agree above ``bit`` form a forest of their own; inside it
    those without the bit merge before those with it.  A merged component is
    named after its last edge.
    """
    group = F.shiftright("r", bit + 1)
    is_upper = F.shiftright("r", bit).bitwiseAND(F.lit(1)) == 1
    scoped = edges.withColumn("x", F.struct(group.alias("g"), F.col("a").alias("n"))).withColumn(
        "y", F.struct(group.alias("g"), F.col("b").alias("n"))
    )
    lower, upper = scoped.filter(~is_upper), scoped.filter(is_upper)
    mapping = forest_components(lower)
    ends = lower.select(
        F.inline(
            F.array(
                F.struct(F.col("x").alias("id"), F.col("size_a").alias("size")),
                F.struct(F.col("y").alias("id"), F.col("size_b").alias("size")),
            )
        )
    ).distinct()
    sizes = mapping.join(ends, "id").groupBy("root").agg(F.sum("size").alias("size"))
    last = (
        lower.select(F.col("x").alias("id"), "r")
        .join(mapping, "id")
        .groupBy("root")
        .agg((F.max("r") + first_node).alias("node"))
    )
    merged = materialise(
        mapping.join(sizes, "root").join(last, "root").select("id", "node", "size"), "merged"
    )
    for end, node, size in (("x", "a", "size_a"), ("y", "b", "size_b")):
        new = merged.select(F.col("id").alias(end), F.col("node").alias("_n"), F.col("size").alias("_s"))
        upper = (
            upper.join(new, end, "left")
            .withColumn(node, F.coalesce("_n", node))
            .withColumn(size, F.coalesce("_s", size))
            .drop("_n", "_s")
        )
    return lower.select(*edges.columns).union(upper.select(*edges.columns))


def _replay(first_node: int):
    """Merge the edges of one bounded group in order, noting what each joins."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(
            zip(*(group.column(c).to_pylist() for c in ("r", "a", "size_a", "b", "size_b", "weight")))
        )
        parent: dict[int, int] = {}
        size: dict[int, int] = {}

        def top(node: int) -> int:
            while node in parent:
                above = parent[node]
                if above in parent:
                    parent[node] = parent[above]
                node = above
            return node

        out: list[tuple] = []
        for r, a, size_a, b, size_b, weight in rows:
            left, right = top(a), top(b)
            left_size, right_size = size.get(left, size_a), size.get(right, size_b)
            node = first_node + r
            parent[left] = parent[right] = node
            size[node] = left_size + right_size
            out.append((node, weight, left, left_size, right, right_size))
        names = ("node", "weight", "left", "left_size", "right", "right_size")
        return pa.table(dict(zip(names, (pa.array(c) for c in zip(*out)))))

    return run


def merge_history(tree: DataFrame, vertices: DataFrame, group_bits: int = GROUP_BITS) -> DataFrame:
    """(node, weight, left, left_size, right, right_size) for every tree edge.

    Edge number r in ascending weight makes node r above the largest vertex id.
    Ranks are halved bit by bit, the lower half contracted for the upper one,
    until groups have 2 ** group_bits edges; all groups are then replayed side
    by side.
    """
    facts = vertices.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    first_node = max(facts["last"], -1) + 1
    sizes = vertices.select("id", "copies")
    ranked = with_row_index(tree.select("lo", "hi", "weight"), ["weight", "lo", "hi"], "r")
    edges = (
        ranked.join(sizes.select(F.col("id").alias("lo"), F.col("copies").alias("size_a")), "lo")
        .join(sizes.select(F.col("id").alias("hi"), F.col("copies").alias("size_b")), "hi")
        .select("r", F.col("lo").alias("a"), "size_a", F.col("hi").alias("b"), "size_b", "weight")
    )
    for bit in range(max(facts["n"] - 2, 0).bit_length() - 1, group_bits - 1, -1):
        edges = _contract_lower(materialise(edges, "merging"), bit, first_node)
    schema = "node long, weight double, left long, left_size long, right long, right_size long"
    replayed = edges.withColumn("_group", F.shiftright("r", group_bits)).groupBy("_group")
    return materialise(replayed.applyInArrow(_replay(first_node), schema), "history")


# Condensed tree ----------------------------------------------------------------


def _density(weight: str) -> Column:
    return F.when(F.col(weight) > 0, 1.0 / F.col(weight)).otherwise(F.lit(float("inf")))


@dataclass
class CondensedTree:
    """``clusters``: (cluster, parent, size, birth); ``exits``: (vertex, size, cluster, density)."""

    clusters: DataFrame
    exits: DataFrame


def condense(history: DataFrame, vertices: DataFrame, min_cluster_size: int) -> CondensedTree:
    """Keep the merges of two large enough parts as clusters.

    A part below ``min_cluster_size`` that meets a larger one falls out of its
    cluster at that density; the larger part continues the cluster.
    """
    m = min_cluster_size
    children = history.select(
        F.col("node").alias("parent"),
        _density("weight").alias("density"),
        F.inline(
            F.array(
                F.struct(
                    F.col("left").alias("child"),
                    F.col("left_size").alias("size"),
                    F.col("right_size").alias("sibling"),
                ),
                F.struct(
                    F.col("right").alias("child"),
                    F.col("right_size").alias("size"),
                    F.col("left_size").alias("sibling"),
                ),
            )
        ),
    )
    total = F.col("size") + F.col("sibling")
    children, top = materialise_with(
        children, "children", id=F.max("parent"), size=F.max_by(total, F.col("parent")), n=F.count("*")
    )
    root = history.sparkSession.createDataFrame([(top["id"], top["size"])], "id long, size long")

    real = children.filter(F.col("size") >= m)
    starts = F.col("sibling") >= m
    pointers = real.select(
        F.col("child").alias("id"), F.when(starts, F.col("child")).otherwise(F.col("parent")).alias("root")
    ).union(root.filter(F.col("size") >= m).select("id", F.col("id").alias("root")))
    small = children.filter(F.col("size") < m)
    falling = F.when(total >= m, F.col("child")).otherwise(F.col("parent"))
    pointers = pointers.union(small.select(F.col("child").alias("id"), falling.alias("root")))
    # large nodes end at the head of their cluster, small ones at the part that falls out
    ends = resolve(pointers, top["n"] + 1)
    belongs = ends.withColumnRenamed("root", "cluster")
    of_parent = belongs.withColumnRenamed("id", "parent")

    born = (
        real.filter(starts)
        .join(of_parent, "parent")
        .select(
            F.col("child").alias("cluster"),
            F.col("cluster").alias("parent"),
            "size",
            F.col("density").alias("birth"),
        )
    )
    root_row = root.filter(F.col("size") >= m).select(
        F.col("id").alias("cluster"), F.lit(None).cast("long").alias("parent"), "size", F.lit(0.0).alias("birth")
    )
    clusters = materialise(born.union(root_row), "clusters")

    falls = small.filter(total >= m).join(of_parent, "parent")
    copies = vertices.select("id", "copies")
    fallen = (
        ends.join(falls.select(F.col("child").alias("root"), "cluster", "density"), "root")
        .join(copies, "id")
        .select(F.col("id").alias("vertex"), F.col("copies").alias("size"), "cluster", "density")
    )
    heavy = vertices.filter(F.col("copies") >= m).select(
        "id", F.col("copies").alias("size"), _density("core").alias("density")
    )
    stayed = heavy.join(belongs, "id").select(
        F.col("id").alias("vertex"), "size", "cluster", "density"
    )
    return CondensedTree(clusters, materialise(fallen.union(stayed), "exits"))


def cluster_stability(tree: CondensedTree) -> DataFrame:
    """(cluster, parent, size, stability, peak): excess of mass and highest density left at."""
    leaving = tree.exits.select("cluster", "size", "density").union(
        tree.clusters.filter(F.col("parent").isNotNull()).select("parent", "size", "birth")
    )
    mass = leaving.groupBy("cluster").agg(
        F.sum(F.col("size") * F.col("density")).alias("_mass"), F.max("density").alias("peak")
    )
    return tree.clusters.join(mass, "cluster", "left").select(
        "cluster",
        "parent",
        "size",
        (F.coalesce("_mass", F.lit(0.0)) - F.col("size") * F.col("birth")).alias("stability"),
        F.coalesce("peak", F.lit(0.0)).alias("peak"),
    )


def _settle(state: DataFrame) -> DataFrame:
    """One round: settle clusters without open children, link and shorten chains."""
    below = (
        state.filter("parent IS NOT NULL")
        .groupBy(F.col("parent").alias("cluster"))
        .agg(
            F.coalesce(F.sum("worth"), F.lit(0.0)).alias("_settled"),
            F.count_if(F.col("worth").isNull()).alias("_open"),
            F.max(F.when(F.col("worth").isNull(), F.col("cluster"))).alias("_child"),
        )
    )
    one = F.col("down").isNull() & (F.col("_open") == 1)
    done = F.col("worth").isNull() & (F.coalesce("_open", F.lit(0)) == 0)
    settled = F.coalesce("_settled", F.lit(0.0))
    linked = state.join(below, "cluster", "left").select(
        "cluster",
        "parent",
        "stability",
        F.when(done, F.greatest("stability", settled)).otherwise(F.col("worth")).alias("worth"),
        F.when(one, F.col("_child")).otherwise(F.col("down")).alias("down"),
        F.when(one, F.col("stability")).otherwise(F.col("p")).alias("p"),
        F.when(one, F.col("_settled")).otherwise(F.col("q")).alias("q"),
    )
    end = linked.select(
        F.col("cluster").alias("down"),
        F.col("worth").alias("_worth"),
        F.col("down").alias("_down"),
        F.col("p").alias("_p"),
        F.col("q").alias("_q"),
    )
    known = F.col("worth").isNull() & F.col("_worth").isNotNull()
    jump = F.col("_worth").isNull() & F.col("_down").isNotNull()
    reached = F.greatest("p", F.col("_worth") + F.col("q"))
    return linked.join(end, "down", "left").select(
        "cluster",
        "parent",
        "stability",
        F.when(known, reached).otherwise(F.col("worth")).alias("worth"),
        F.when(jump, F.col("_down")).otherwise(F.col("down")).alias("down"),
        F.when(jump, F.greatest("p", F.col("_p") + F.col("q"))).otherwise(F.col("p")).alias("p"),
        F.when(jump, F.col("q") + F.col("_q")).otherwise(F.col("q")).alias("q"),
    )


def _climb(climb: DataFrame) -> DataFrame:
    """Replace each ``up`` by the up of that cluster; a choice further up wins."""
    above = climb.select(
        F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("selected").alias("_selected")
    )
    return climb.join(above, "up", "left").select(
        "cluster", F.col("_up").alias("up"), F.coalesce("_selected", "selected").alias("selected")
    )


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, selected) of all clusters, parents having larger ids than their children."""
    schema = pa.schema([("cluster", pa.int64()), ("parent", pa.int64()), ("stability", pa.float64())])
    table = pa.Table.from_batches(list(batches), schema).sort_by("cluster")
    cluster, stability = (table.column(c).to_numpy() for c in ("cluster", "stability"))
    root = table.column("parent").is_null().to_numpy()
    above = np.searchsorted(cluster, table.column("parent").fill_null(-1).to_numpy())
    below, selected = np.zeros(len(cluster)), np.full(len(cluster), -1)
    for i in np.flatnonzero(~root):
        below[above[i]] += np.maximum(stability[i], below[i])
    for i in range(len(cluster) - 1, -1, -1):
        if not root[i]:
            own = i if stability[i] >= below[i] or np.isnan(stability[i]) else -1
            selected[i] = selected[above[i]] if selected[above[i]] >= 0 else own
    found = pa.array(cluster[selected], mask=selected < 0)
    yield pa.RecordBatch.from_arrays([pa.array(cluster), found], names=["cluster", "selected"])


def select_clusters(stability: DataFrame, count: int | None = None) -> DataFrame:
    """(cluster, selected): the chosen cluster each one belongs to, or null.

    Bottom up, a cluster is worth the larger of its own stability and the worth
    of its children.  Leaves are settled first; a chain of clusters with one
    unsettled child each is a chain of functions max(p, x + q), which are joined
    pairwise, so deep trees take few rounds.  Top down, the highest cluster that
    is worth its own stability wins.  Up to ``FEW`` clusters, if so many are known to
    be there, are chosen among in one task.
    """
    if count is not None and count <= FEW:
        rows = stability.select("cluster", "parent", "stability").repartition(1)
        return materialise(rows.mapInArrow(_chosen, "cluster long, selected long"), "selected")
    state = stability.select(
        "cluster",
        "parent",
        "stability",
        F.lit(None).cast("double").alias("worth"),
        F.lit(None).cast("long").alias("down"),
        F.lit(None).cast("double").alias("p"),
        F.lit(None).cast("double").alias("q"),
    )
    while True:
        state, facts = materialise_with(
            _settle(state), "worth", unsettled=F.count_if(F.col("worth").isNull())
        )
        if not facts["unsettled"]:
            break
    children = (
        state.filter("parent IS NOT NULL")
        .groupBy(F.col("parent").alias("cluster"))
        .agg(F.sum("worth").alias("_children"))
    )
    chosen = F.col("parent").isNotNull() & (
        F.col("stability") >= F.coalesce("_children", F.lit(0.0))
    )
    climb = state.join(children, "cluster", "left").select(
        "cluster",
        F.col("parent").alias("up"),
        F.when(chosen, F.col("cluster")).alias("selected"),
    )
    while True:
        climb, facts = materialise_with(
            _climb(_climb(climb)), "climb", climbing=F.count_if(F.col("up").isNotNull())
        )
        if not facts["climbing"]:
            break
    return climb.select("cluster", "selected")


# Labels --------------------------------------------------------------------------


def _all_noise(points: DataFrame, key: str) -> DensityClusters:
    assignment = points.select(
        key,
        F.lit(NOISE).alias("cluster_id"),
        F.lit(0.0).alias("cluster_confidence"),
    )
    info = assignment.filter(F.lit(False)).select("cluster_id", F.lit(0.0).alias("stability"))
    return DensityClusters(assignment, info)


def density_clusters(
    points: DataFrame,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    min_samples: int | None = None,
    metric: str = "euclidean",
    key: str = "feedback_id",
    vector: str = "reduced",
    group_bits: int = GROUP_BITS,
) -> DensityClusters:
    """Cluster points by density; -1 is noise.

    ``min_samples`` defaults to ``min_cluster_size``.  Ids count from 0 in the
    order of each cluster's smallest key.  Confidence is a point's density over
    its cluster's peak; ``stability`` is the excess of mass as a share of the
    largest possible.
    """
    if points.isEmpty():
        return _all_noise(points, key)
    graph = reachability(points, min_samples or min_cluster_size, key, vector, metric)
    tree = spanning_edges(graph)
    if tree.isEmpty():
        return _all_noise(points, key)
    history = merge_history(tree, graph.vertices, group_bits)
    condensed = condense(history, graph.vertices, min_cluster_size)
    stability, seen = materialise_with(cluster_stability(condensed), "stability", n=F.count("*"))
    if not seen["n"]:
        return _all_noise(points, key)
    selected = select_clusters(stability, seen["n"])

    density, peak = F.col("density"), F.col("peak")
    endless = density == float("inf")
    share = F.when(endless | (peak == 0), 1.0).otherwise(F.least(density, peak) / peak)
    placed = (
        condensed.exits.join(selected.filter("selected IS NOT NULL"), "cluster")
        .join(stability.select(F.col("cluster").alias("selected"), "peak"), "selected")
        .join(graph.vertices.select(F.col("id").alias("vertex"), "rep"), "vertex")
        .select("rep", "selected", share.alias("_share"))
    )
    located = materialise(graph.members.join(placed, "rep", "left"), "located")
    found = (
        located.filter("selected IS NOT NULL")
        .groupBy("selected")
        .agg(F.min("point").alias("_first"), F.count("*").alias("_size"))
    )
    numbered = with_row_index(found, ["_first"], "_index").select(
        "selected", F.col("_index").cast("int").alias("cluster_id"), "_size"
    )
    numbered = materialise(numbered, "numbered")
    highest = stability.agg(F.max("peak")).scalar()
    info = (
        numbered.join(stability.withColumnRenamed("cluster", "selected"), "selected")
        .withColumn("_highest", highest)
        .select(
            "cluster_id",
            F.when((F.col("_highest") == float("inf")) | (F.col("_highest") == 0), 1.0)
            .otherwise(F.col("stability") / (F.col("_size") * F.col("_highest")))
            .alias("stability"),
        )
    )
    assignment = located.join(numbered, "selected", "left").select(
        F.col("point").alias(key),
        F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"),
        F.coalesce("_share", F.lit(0.0)).alias("cluster_confidence"),
    )
    return DensityClusters(assignment, info)
