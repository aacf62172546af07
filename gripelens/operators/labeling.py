"""Labels for clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gripelens.functions.entities import LABEL_DDL, LABEL_FIELDS, parse_answers
from gripelens.functions.labels import LABEL_CONFIDENCE, fallback_label, label_prompt
from gripelens.operators.hooks import complete
from gripelens.operators.keywords import cluster_keywords
from gripelens.operators.reports import (
    cluster_texts,
    failure_frequency,
    first_texts,
    representative_complaint,
    without_noise,
)


def modal_value(df: DataFrame, group: str, column: str) -> DataFrame:
    """Most frequent non-null value per group, ties by value."""
    counts = (
        df.filter(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("_n"))
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"), F.asc(column)))
    return counts.withColumn("_rank", rank).filter("_rank = 1").select(group, column)


def label_from_answer(df: DataFrame, content: str = "content") -> DataFrame:
    """Parse label answers; fields default to empty, a bad answer to the fallback.

    A failed completion (null answer) leaves no label, hence no row.
    """
    parsed = parse_answers(df.filter(F.col(content).isNotNull()), content, LABEL_DDL)
    good = F.col("parse_status") == "success"
    values = [F.coalesce(F.col(f"entity.{f}"), F.lit("")) for f in LABEL_FIELDS]
    fallback = [fallback_label(F.col("keywords"))] + [F.lit("")] * (len(LABEL_FIELDS) - 1)
    out = parsed.filter(F.col("parse_status") != "failed")
    return out.select(
        *[c for c in df.columns if c != content],
        *[F.when(good, v).otherwise(f).alias(n) for n, v, f in zip(LABEL_FIELDS, values, fallback)],
    )


def label_clusters(
    clustered: DataFrame,
    entities: DataFrame,
    feedback: DataFrame,
    stop_words: Sequence[str] | None = None,
    call: Callable[[str], str] | None = None,
    confidence: float = LABEL_CONFIDENCE,
) -> DataFrame:
    """One labelled row per cluster.

    With ``call`` a completion hook names the cluster from its keywords and
    first texts; otherwise the two best keywords do, and component and symptom
    are the most frequent ones among the members' entities.
    """
    texts = cluster_texts(feedback, clustered)
    keywords = cluster_keywords(texts, stop_words)
    frequency = failure_frequency(clustered)
    representative = representative_complaint(clustered, feedback)
    base = frequency.join(keywords, "cluster_id", "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>"))
    )
    if call is None:
        members = without_noise(clustered).select("cluster_id", "feedback_id").join(
            entities.select("feedback_id", "component", "symptom"), "feedback_id"
        )
        named = (
            base.join(modal_value(members, "cluster_id", "component"), "cluster_id", "left")
            .join(modal_value(members, "cluster_id", "symptom"), "cluster_id", "left")
            .withColumn("label", fallback_label(F.col("keywords")))
            .withColumn("root_component", F.coalesce("component", F.lit("")))
            .withColumn("recurring_symptom", F.coalesce("symptom", F.lit("")))
        )
    else:
        samples = first_texts(clustered, feedback)
        prompts = base.join(samples, "cluster_id", "left").select(
            *base.columns,
            label_prompt(
                F.col("keywords"), F.coalesce("sample_texts", F.array().cast("array<string>"))
            ).alias("_prompt"),
        )
        named = label_from_answer(complete(prompts, "_prompt", call).drop("_prompt"))
    return named.join(representative, "cluster_id").select(
        "cluster_id",
        "label",
        "root_component",
        "recurring_symptom",
        "failure_frequency",
        "representative_complaint",
        F.lit(float(confidence)).alias("confidence"),
    )
