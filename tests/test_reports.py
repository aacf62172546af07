from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gripelens.operators import quality, ranking, reports
from gripelens.schemas import TABLES


def clusters(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "feedback_id long, cluster_id int")


@pytest.mark.parametrize(
    "n, expected", [(2, [0, 1]), (3, [0, 1, 2]), (7, [0, 2, 4]), (10, [0, 3, 6])]
)
def test_representatives(spark, n, expected):
    df = clusters(spark, [4] * n + [-1, -1])
    assert [r["position"] for r in reports.representatives(df).collect()] == expected


def test_positions_in_a_hot_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("feedback_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("g")
    )
    got = ranking.with_group_position(df, "g", "feedback_id").toPandas().sort_values("feedback_id")
    for g, part in got.groupby("g"):
        assert (part["position"].to_numpy() == np.arange(len(part))).all()
        assert (part["group_size"] == len(part)).all()


def test_row_index_over_strings(spark):
    df = spark.range(500).select(F.format_string("k%03d", "id").alias("k"))
    got = ranking.with_row_index(df, ["k"]).orderBy("k").collect()
    assert [r["row_index"] for r in got] == list(range(500))


def test_search_looks_at_all_rows(spark):
    fb = spark.range(60).select(
        F.col("id").alias("feedback_id"),
        F.when(F.col("id") == 55, "needle").otherwise("hay").alias("customer_feedback"),
    )
    cl = clusters(spark, [0] * 60)
    assert reports.search_feedback(fb, cl, "needle").count() == 1
    assert reports.search_feedback(fb, cl.filter("feedback_id > 20"), "NEEDLE", 0).count() == 1
    assert reports.search_feedback(fb, cl, limit=50).count() == 50


def test_empty_labels(spark):
    labels = spark.createDataFrame([], "cluster_id int, label string, failure_frequency long")
    assert reports.failure_totals(labels).first()["top_cluster_size"] == 0
    got = reports.overview_metrics(clusters(spark, [-1, 0, 0, 1]), labels).first().asDict()
    assert got == {
        "total_issues": 4,
        "clusters": 2,
        "noise_points": 1,
        "noise_percentage": 25.0,
        "top_cluster_size": 0,
    }


def test_value_counts_drop_nulls_and_order_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert [tuple(r) for r in reports.value_counts(df, "v", 2).collect()] == [("a", 2), ("b", 2)]


def test_representative_complaint_without_feedback(spark):
    fb = spark.createDataFrame([(1, "one"), (0, "zero")], "feedback_id long, customer_feedback string")
    got = reports.representative_complaint(clusters(spark, [3, 3, 5, -1]), fb).collect()
    assert {r["cluster_id"]: r["representative_complaint"] for r in got} == {3: "zero", 5: ""}


def test_cluster_map_keeps_all_points(spark):
    df = clusters(spark, [0, -1]).selectExpr("*", "1.0 AS umap_x", "2.0 AS umap_y")
    assert reports.cluster_map(df).count() == 2


def violations(df):
    return {r["rule"]: r["violations"] for r in df.collect()}


def test_quality_finds_what_is_wrong(spark):
    cl = clusters(spark, [0, 2, -1]).selectExpr(
        "*",
        "CASE feedback_id WHEN 0 THEN 1.5 WHEN 1 THEN double('NaN') ELSE 0.5 END AS cluster_confidence",
        "CASE feedback_id WHEN 0 THEN double('Infinity') ELSE 0.0 END AS umap_x",
        "CAST(NULL AS double) AS umap_y",
    )
    lab = spark.createDataFrame([("", 0), ("x", 3)], "label string, failure_frequency long")
    assert violations(quality.check_clusters(cl, lab)) == {
        "missing_cluster_id": 1,
        "confidence_out_of_range": 2,
        "coordinate_not_finite": 3,
        "empty_label": 1,
        "frequency_not_positive": 1,
    }
    v = spark.createDataFrame(
        [([1.0, 2.0],), ([1.0],), (None,), ([float("nan"), 1.0],)], "embedding array<double>"
    )
    assert violations(quality.check_vectors(v)) == {
        "extra_dimension": 1,
        "null_vector": 1,
        "null_or_nan_component": 1,
    }
    keyed = spark.createDataFrame([("a", 1), ("a", None)], "feedback_id string, cluster_id int")
    assert violations(quality.check_constraints(keyed, TABLES["clustered_feedback"])) == {
        "null_feedback_id": 0,
        "null_cluster_id": 1,
        "duplicate_feedback_id": 1,
    }


def test_silhouette_matches_the_definition(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(20, 3)), rng.normal(size=(25, 3)) + 4])
    ids = np.array([0] * 20 + [1] * 25)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i in range(len(x)):
        own = d[i, ids == ids[i]].sum() / ((ids == ids[i]).sum() - 1)
        other = d[i, ids != ids[i]].mean()
        scores.append((other - own) / max(own, other))
    df = clusters(spark, [*ids.tolist(), -1])
    vec = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(np.vstack([x, [[99, 99, 99]]]))],
        "feedback_id long, embedding array<double>",
    )
    got = quality.silhouette(df, vec).first()["silhouette"]
    assert got == pytest.approx(np.mean(scores), abs=1e-6)


def test_silhouette_of_many_clusters_stays_in_spark(spark, monkeypatch):
    from pyspark.ml.evaluation import ClusteringEvaluator

    monkeypatch.setattr(ClusteringEvaluator, "_evaluate", None)
    rng = np.random.default_rng(6)
    ids = np.array([*rng.integers(0, 9, 80), 50, -1, -1])
    ids[:3] = 8
    x = rng.normal(size=(len(ids), 4)) + ids[:, None] % 5
    x[0] = x[1] = x[2]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i in np.flatnonzero(ids != -1):
        n = (ids == ids[i]).sum()
        own = d[i, ids == ids[i]].sum() / max(n - 1, 1)
        other = min(d[i, ids == c].mean() for c in set(ids.tolist()) - {ids[i], -1})
        scores.append(0 if n == 1 else (other - own) / max(own, other))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "feedback_id long, embedding array<float>")
    got = quality.silhouette(clusters(spark, ids.tolist()), vec).first()["silhouette"]
    assert got == pytest.approx(np.mean(scores), abs=1e-5)
    alone = clusters(spark, [3, -1])
    assert quality.silhouette(alone, vec).first()["silhouette"] is None
