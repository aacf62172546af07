"""Merging clusters whose centroids point the same way."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.operators.clumps import SimilarClusters, similar_clusters
from gripelens.operators.reports import without_noise
from gripelens.operators.skew import large_keys, spread_join
from gripelens.session import materialise, materialise_with, release

MERGE_THRESHOLD = 0.90


def cluster_centroids(
    clustered: DataFrame, vectors: DataFrame, vector: str = "reduced", key: str = "feedback_id"
) -> DataFrame:
    """(cluster_id, centroid): element-wise mean of the members, noise left out.

    Vectors are summed as vectors, per task first, so one large cluster sends
    one partial sum per task.
    """
    members = without_noise(clustered).select(key, "cluster_id")
    features = vectors.select(key, array_to_vector(vector).alias("_v"))
    return (
        members.join(features, key)
        .groupBy("cluster_id")
        .agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select("cluster_id", vector_to_array("_m").alias("centroid"))
    )


def similar_pairs(centroids: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """(i, j, similarity) with i < j and cosine of at least ``threshold``, all of them.

    ``similar_clusters`` has the same without listing the pairs of dense clumps.
    """
    return similar_clusters(centroids, threshold).listed()


# Merging ----------------------------------------------------------------------


def _smallest(rows: DataFrame, key: str) -> DataFrame:
    """(key, kept, open): the smallest kept and the smallest open id of each."""
    return rows.groupBy(key).agg(
        F.min(F.when(F.col("state") == "kept", F.col("id"))).alias("kept"),
        F.min(F.when(F.col("state") == "open", F.col("id"))).alias("open"),
    )


def _below(similar: SimilarClusters, nodes: DataFrame, large: list) -> DataFrame:
    """nodes with ``kept``: the smallest kept id similar to each and smaller, ``many``:
    whether it has several smaller open ones, and ``only``: the open one otherwise."""
    clumps = _smallest(nodes, "clump")
    ways = similar.joint.select(F.col("a").alias("clump"), F.col("b").alias("other")).union(
        similar.joint.select(F.col("b"), F.col("a"))
    )
    beside = ways.join(clumps.withColumnRenamed("clump", "other"), "other").groupBy("clump")
    beside = beside.agg(F.min("kept").alias("kept2"), F.min("open").alias("open2"))
    around = clumps.withColumnsRenamed({"kept": "kept1", "open": "open1"}).join(beside, "clump", "left")
    state = nodes.select(F.col("id").alias("i"), "state")
    single = (
        similar.pairs.join(state, "i")
        .groupBy(F.col("j").alias("id"))
        .agg(
            F.min(F.when(F.col("state") == "kept", F.col("i"))).alias("kept3"),
            F.min(F.when(F.col("state") == "open", F.col("i"))).alias("only"),
            F.count_if(F.col("state") == "open").alias("n"),
        )
    )
    rows = spread_join(nodes, around, "clump", large).join(single, "id", "left")

    def smaller(c: str) -> Column:
        return F.when(F.col(c) < F.col("id"), F.col(c))

    crowd = F.coalesce(F.least("open1", "open2") < F.col("id"), F.lit(False))
    return rows.select(
        "id", "clump", "state",
        F.least(smaller("kept1"), smaller("kept2"), "kept3").alias("kept"),
        (crowd | (F.coalesce("n", F.lit(0)) > 1)).alias("many"),
        "only",
    )


def _along_chains(nodes: DataFrame, waiting: DataFrame) -> DataFrame:
    """States of the nodes that wait for one other each: (id, state).

    Such a node is kept if the other is not.  Pointers are followed two at a time, each
    with the number of steps it stands for, so that rounds grow with the logarithm of
    the longest chain.
    """
    to = materialise(waiting.select("id", F.col("only").alias("to"), F.lit(True).alias("turned")), "chains")
    while True:
        ahead = to.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("turned").alias("again"))
        step = to.join(ahead, "to", "left").select(
            "id",
            F.coalesce("next", "to").alias("to"),
            F.when(F.col("next").isNull(), F.col("turned")).otherwise(F.col("turned") != F.col("again")).alias("turned"),
            F.col("next").isNotNull().alias("moved"),
        )
        step, seen = materialise_with(step, "chains", moved=F.count_if("moved"))
        release(to)
        to = step.drop("moved")
        if not seen["moved"]:
            break
    ends = nodes.filter("state <> 'open'").select(F.col("id").alias("to"), (F.col("state") == "kept").alias("end"))
    kept = F.col("end") != F.col("turned")
    return to.join(ends, "to").select("id", F.when(kept, "kept").otherwise("mapped").alias("state"))


def merge_map(similar: SimilarClusters | DataFrame) -> DataFrame:
    """(old_id, new_id) from similar clusters, or a table of similar pairs (i, j), i < j.

    A cluster maps to the smallest similar cluster that is itself unmapped, so merging
    is not transitive.  Each round keeps those without a smaller open or kept one, maps
    those next to a smaller kept one, and settles chains of clusters that wait for one
    other each as a whole.
    """
    if isinstance(similar, DataFrame):
        pairs = materialise(similar.select("i", "j"), "pairs")
        ids = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct()
        none = pairs.select(F.col("i").alias("a"), F.col("j").alias("b")).limit(0)
        similar = SimilarClusters(ids.select("id", F.col("id").alias("clump")), none, pairs, ids)
    nodes, seen = materialise_with(
        similar.members.withColumn("state", F.lit("open")), "nodes", n=F.count("*")
    )
    sizes = nodes.groupBy("clump").agg(F.count("*").alias("n"))
    large = large_keys(sizes, "clump", seen["n"])
    left = seen["n"]
    while left:
        below = _below(similar, nodes, large)
        free = F.col("only").isNull() & ~F.col("many")
        state = (
            F.when(F.col("state") != "open", F.col("state"))
            .when(F.col("kept").isNotNull(), "mapped")
            .when(free, "kept")
            .otherwise("open")
        )
        decided, seen = materialise_with(
            below.withColumn("state", state).select("id", "clump", "state", "many", "only"),
            "decided",
            waiting=F.count_if((F.col("state") == "open") & ~F.col("many")),
            left=F.count_if(F.col("state") == "open"),
        )
        last = nodes
        if seen["waiting"]:
            settled = _along_chains(decided, decided.filter("state = 'open' AND NOT many"))
            now = settled.withColumnRenamed("state", "now")
            nodes, seen = materialise_with(
                decided.join(now, "id", "left").select("id", "clump", F.coalesce("now", "state").alias("state")),
                "nodes",
                left=F.count_if(F.col("state") == "open"),
            )
            release(decided)
        else:
            nodes = decided.select("id", "clump", "state")
        release(last)
        left = seen["left"]
    found = _below(similar, nodes, large).filter("state = 'mapped'")
    return found.select(F.col("id").alias("old_id"), F.col("kept").alias("new_id"))


def apply_merges(clustered: DataFrame, merges: DataFrame) -> DataFrame:
    """Replace merged cluster ids, keep the others.

    Noise and other large clusters are not shuffled by their id.
    """
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"))
    facts = sizes.agg(F.sum("n").alias("total")).first()
    named = merges.select(F.col("old_id").cast(clustered.schema["cluster_id"].dataType).alias("cluster_id"), "new_id")
    joined = spread_join(clustered, named, "cluster_id", large_keys(sizes, "cluster_id", facts["total"] or 0))
    return joined.withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).select(*clustered.columns)


def refine_clusters(
    clustered: DataFrame,
    vectors: DataFrame,
    threshold: float = MERGE_THRESHOLD,
    vector: str = "reduced",
) -> DataFrame:
    """Merge clusters with similar centroids."""
    centroids = cluster_centroids(clustered, vectors, vector)
    return apply_merges(clustered, merge_map(similar_clusters(centroids, threshold)))


def refinement_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: clusters before and after refinement."""
    count = F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id")))
    return before.agg(count.alias("clusters_before")).select(
        "clusters_before", after.agg(count.alias("clusters_after")).scalar().alias("clusters_after")
    )
