"""Data-quality reports: one row per rule with the number of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.functions.entities import ENTITY_FIELDS
from gripelens.operators.cleaning import CRITICAL_COLUMNS
from gripelens.operators.reports import without_noise
from gripelens.operators.silhouette import silhouette as silhouette
from gripelens.schemas import TableRules


def _as_rules(one_row: DataFrame) -> DataFrame:
    """Turn a one-row frame of violation counts into (rule, violations)."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations"))
            for c in one_row.columns
        ]
    )
    return one_row.select(F.inline(pairs))


def _none_as_zero(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in df.columns])


def check_cleaning(df: DataFrame, text: str = "customer_feedback") -> DataFrame:
    """Valid UTF-8, no nulls in critical columns, no duplicate text."""
    has_null = F.lit(False)
    for name in CRITICAL_COLUMNS:
        has_null = has_null | F.col(name).isNull()
    invalid = ~F.coalesce(F.is_valid_utf8(F.col(text)), F.lit(True))
    groups = df.groupBy(F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).agg(
        F.count("*").alias("n"),
        F.count_if(invalid).alias("invalid"),
        F.count_if(has_null).alias("nulls"),
    )
    return _as_rules(
        _none_as_zero(
            groups.agg(
                F.sum("invalid").alias("invalid_utf8"),
                F.sum("nulls").alias("null_critical_field"),
                F.sum(F.col("n") - 1).alias("duplicate_text"),
            )
        )
    )


def check_extraction(entities: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Fields present, confidence above zero and, given statuses, valid JSON."""
    missing = F.lit(False)
    for name in ENTITY_FIELDS:
        missing = missing | F.col(name).isNull()
    report = _as_rules(
        entities.agg(
            F.count_if(missing).alias("missing_field"),
            F.count_if(~(F.coalesce(F.col("confidence"), F.lit(0.0)) > 0)).alias(
                "confidence_not_positive"
            ),
        )
    )
    if status is None:
        return report
    bad = status.agg(F.count_if(F.col("parse_status") != "success").alias("invalid_json"))
    return report.union(_as_rules(bad))


def check_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One dimension for all, no null vector, no null or NaN component."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return _as_rules(
        vectors.agg(
            F.greatest(F.count_distinct(F.size(v)) - 1, F.lit(0)).alias("extra_dimension"),
            F.count_if(v.isNull()).alias("null_vector"),
            F.count_if(F.coalesce(bad, F.lit(False))).alias("null_or_nan_component"),
        )
    )


def check_clusters(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids contiguous from 0, confidence in [0, 1], finite coordinates, usable labels."""
    ids = without_noise(clustered).groupBy("cluster_id").agg(F.count("*").alias("n"))
    gaps = ids.agg(
        (F.coalesce(F.max("cluster_id") + 1, F.lit(0)) - F.count("*")).alias("missing_cluster_id")
    )
    confidence = F.col("cluster_confidence")
    checks = [
        F.count_if(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1)).alias(
            "confidence_out_of_range"
        )
    ]
    axes = [c for c in ("umap_x", "umap_y") if c in clustered.columns]
    if axes:
        finite = F.lit(True)
        for c in axes:
            finite = finite & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
            finite = finite & ~F.isnan(c)
        checks.append(F.count_if(~finite).alias("coordinate_not_finite"))
    label_rules = labels.agg(
        F.count_if(F.coalesce(F.col("label"), F.lit("")) == "").alias("empty_label"),
        F.count_if(~(F.coalesce(F.col("failure_frequency"), F.lit(0)) > 0)).alias(
            "frequency_not_positive"
        ),
    )
    return (
        _as_rules(gaps).union(_as_rules(clustered.agg(*checks))).union(_as_rules(label_rules))
    )


def orphan_keys(child: DataFrame, parent: DataFrame, key: str = "feedback_id") -> DataFrame:
    """Child keys that the parent table lacks."""
    return child.select(key).join(parent.select(key), key, "left_anti")


def check_constraints(df: DataFrame, rules: TableRules) -> DataFrame:
    """Required columns not null, key unique; columns the frame lacks count as null."""
    counts = [
        (F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(f"null_{c}")
        for c in rules.required
    ]
    repeated = df.groupBy(rules.key).agg(F.count("*").alias("n"))
    unique = repeated.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"duplicate_{rules.key}")
    )
    return _as_rules(df.agg(*counts)).union(_as_rules(unique))
