"""Report queries over the stage tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gripelens.functions.labels import severity_bucket
from gripelens.functions.text import contains_like, display_text, percent_of, percent_text

NOISE = -1


def without_noise(clustered: DataFrame) -> DataFrame:
    return clustered.filter(F.col("cluster_id") != NOISE)


def cluster_ids(clustered: DataFrame) -> DataFrame:
    """Distinct cluster ids without noise, ascending."""
    return without_noise(clustered.select("cluster_id")).distinct().orderBy("cluster_id")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("size"))


def cluster_statistics(clustered: DataFrame) -> DataFrame:
    """One row: clusters, noise points, total points and the noise percentage."""
    is_noise = F.col("cluster_id") == NOISE
    counts = cluster_sizes(clustered).agg(
        F.count_if(~is_noise).alias("clusters"),
        F.coalesce(F.sum(F.when(is_noise, F.col("size"))), F.lit(0)).alias("noise_points"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_points"),
    )
    return counts.withColumn(
        "noise_percentage", percent_of(F.col("noise_points"), F.col("total_points"))
    )


def head(df: DataFrame, n: int, order: str = "feedback_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def cluster_info(clustered: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """Size and percentage of all points, noise included in the total.

    ``stability`` (cluster_id, stability) is joined on when given.
    """
    total = clustered.agg(F.count("*").alias("n")).scalar()
    info = (
        without_noise(cluster_sizes(clustered))
        .withColumn("percentage", percent_of(F.col("size"), total))
    )
    if stability is None:
        return info
    return info.join(stability.select("cluster_id", "stability"), "cluster_id", "left")


def failure_frequency(clustered: DataFrame) -> DataFrame:
    sizes = without_noise(cluster_sizes(clustered))
    return sizes.withColumnRenamed("size", "failure_frequency")


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts of the non-null values, most frequent first, ties by value."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )
    return counts if k is None else counts.limit(k)


def failure_totals(labels: DataFrame) -> DataFrame:
    """One row: labelled clusters, summed frequency, largest frequency."""
    return labels.agg(
        F.count("*").alias("total_clusters"),
        F.sum("failure_frequency").alias("total_failures"),
        F.coalesce(F.max("failure_frequency"), F.lit(0)).alias("top_cluster_size"),
    )


def overview_metrics(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    largest = labels.agg(F.coalesce(F.max("failure_frequency"), F.lit(0)).alias("m")).scalar()
    return cluster_statistics(clustered).select(
        F.col("total_points").alias("total_issues"),
        "clusters",
        "noise_points",
        "noise_percentage",
        largest.alias("top_cluster_size"),
    )


def top_failures(labels: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent patterns; equal frequencies by lowest cluster id."""
    return (
        labels.orderBy(F.desc("failure_frequency"), F.asc("cluster_id"))
        .limit(k)
        .select("label", "failure_frequency", "root_component", "recurring_symptom")
    )


def analytics(labels: DataFrame, k: int = 10, components: int = 5) -> dict[str, DataFrame]:
    """The three frames of the analytics answer."""
    return {
        "top_failures": top_failures(labels, k),
        "components": value_counts(labels, "root_component", components),
        "totals": failure_totals(labels),
    }


def severity_distribution(labels: DataFrame) -> DataFrame:
    """Clusters (not complaints) per frequency bucket."""
    return labels.groupBy(severity_bucket(F.col("failure_frequency")).alias("severity")).agg(
        F.count("*").alias("count")
    )


def facet_values(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Distinct values of several columns in one scan: (facet, value)."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]
    )
    return df.select(F.inline(pairs)).distinct()


def facet_search(df: DataFrame, facets: Mapping[str, Sequence]) -> DataFrame:
    """Rows that satisfy every facet; an empty list does not filter."""
    for name, values in facets.items():
        if values:
            df = df.filter(F.col(name).isin(list(values)))
    return df


def search_feedback(
    feedback: DataFrame,
    clustered: DataFrame,
    query: str | None = None,
    cluster_id: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Clustered feedback whose text contains ``query``; all of it without a ``limit``.

    A limit keeps the lowest ids among the matches.
    """
    members = clustered
    if cluster_id is not None:
        members = members.filter(F.col("cluster_id") == cluster_id)
    found = feedback
    if query:
        found = found.filter(contains_like(F.col("customer_feedback"), query))
    found = found.join(members.select("feedback_id"), "feedback_id", "left_semi")
    return found if limit is None else head(found, limit)


def cluster_lookup(labels: DataFrame, label: str) -> DataFrame:
    """First cluster that carries a label, as the detail page shows it."""
    return (
        labels.filter(F.col("label") == label)
        .orderBy("cluster_id")
        .limit(1)
        .select(
            "cluster_id",
            "failure_frequency",
            "root_component",
            "recurring_symptom",
            percent_text(F.col("confidence")).alias("confidence"),
            display_text(F.col("representative_complaint")).alias("representative_complaint"),
        )
    )


def cluster_members(
    feedback: DataFrame, clustered: DataFrame, cluster_id: int, limit: int = 5
) -> DataFrame:
    """Preview of a cluster's complaints, lowest ids first.

    The ids are found without the texts; then only their rows are fetched.
    """
    members = clustered.filter(F.col("cluster_id") == cluster_id).select("feedback_id")
    ids = head(feedback.select("feedback_id").join(members, "feedback_id", "left_semi"), limit)
    found = feedback.join(F.broadcast(ids), "feedback_id", "left_semi")
    return head(found, limit).withColumn("language", F.upper("language"))


def cluster_texts(feedback: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster_id, feedback_id, text) for all clusters in one join."""
    return feedback.select("feedback_id", "customer_feedback").join(
        without_noise(clustered).select("feedback_id", "cluster_id"), "feedback_id"
    )


def representatives(clustered: DataFrame, samples: int = 3) -> DataFrame:
    """Members spread over each cluster: every (n // samples)-th, ``samples`` at most.

    Positions follow ``feedback_id``.  They are found without ranking a whole
    cluster in one task: ids are cut into ranges, range counts give each range
    its first position, and only the rank inside a range needs a window.
    """
    from gripelens.operators.ranking import with_group_position

    ranked = with_group_position(
        without_noise(clustered).select("cluster_id", "feedback_id"), "cluster_id", "feedback_id"
    )
    step = F.greatest(F.floor(F.col("group_size") / samples), F.lit(1))
    return (
        ranked.filter(
            (F.col("group_size") <= samples)
            | ((F.col("position") % step == 0) & (F.col("position") / step < samples))
        )
        .select("cluster_id", "feedback_id", "position")
        .orderBy("cluster_id", "position")
    )


def first_texts(
    clustered: DataFrame, feedback: DataFrame, count: int = 3, text: str = "customer_feedback"
) -> DataFrame:
    """(cluster_id, sample_texts): the first texts of each cluster by id.

    Ids are ranked first, so no other text is moved.
    """
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("feedback_id"))
    firsts = (
        without_noise(clustered)
        .select("cluster_id", "feedback_id")
        .join(feedback.select("feedback_id"), "feedback_id", "left_semi")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= count)
    )
    return (
        firsts.join(feedback.select("feedback_id", text), "feedback_id")
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", text))).alias("_rows"))
        .select("cluster_id", F.col(f"_rows.{text}").alias("sample_texts"))
    )


def representative_complaint(
    clustered: DataFrame, feedback: DataFrame, text: str = "customer_feedback"
) -> DataFrame:
    """First member text per cluster, empty when no member has feedback.

    Only one text per cluster is fetched: the first id is found on ids alone.
    """
    firsts = (
        without_noise(clustered)
        .join(feedback.select("feedback_id"), "feedback_id", "left_semi")
        .groupBy("cluster_id")
        .agg(F.min("feedback_id").alias("feedback_id"))
    )
    return (
        without_noise(clustered.select("cluster_id"))
        .distinct()
        .join(firsts, "cluster_id", "left")
        .join(feedback.select("feedback_id", text), "feedback_id", "left")
        .select("cluster_id", F.coalesce(F.col(text), F.lit("")).alias("representative_complaint"))
    )


def label_table(labels: DataFrame) -> DataFrame:
    """Columns of the export preview."""
    return labels.select(
        "label", "failure_frequency", "root_component", "recurring_symptom", "confidence"
    )


def summary_table(labels: DataFrame) -> DataFrame:
    """Columns of the end-of-run summary."""
    return labels.select("cluster_id", "label", "failure_frequency", "root_component").orderBy(
        "cluster_id"
    )


def cluster_map(clustered: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Scatter data; ``fraction`` thins a plot, never the stored table."""
    points = clustered.select(
        F.col("umap_x").alias("x"), F.col("umap_y").alias("y"), "cluster_id", "feedback_id"
    )
    return points if fraction is None else points.sample(fraction=fraction, seed=seed)


def assignment(clustered: DataFrame, reduced: DataFrame) -> DataFrame:
    """Join cluster ids to their reduced vectors by key: coordinates and noise flag."""
    return clustered.join(
        reduced.select(
            "feedback_id",
            F.element_at("reduced", 1).cast("double").alias("umap_x"),
            F.element_at("reduced", 2).cast("double").alias("umap_y"),
        ),
        "feedback_id",
    ).withColumn("is_noise", F.col("cluster_id") == NOISE)
