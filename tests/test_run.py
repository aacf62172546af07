from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gripelens.operators import extraction, quality
from gripelens.plans import run
from gripelens.sources.tables import coerce_records


FAILURES = ["engine overheating", "clutch slipping", "coolant leak", "brake squeal", "battery drain", "pump rattle"]


def complaints(spark, n):
    i = F.col("id")
    failure = F.element_at(F.array(*[F.lit(f) for f in FAILURES]), (i % len(FAILURES) + 1).cast("int"))
    rows = spark.range(n).select(
        F.concat(F.lit("row "), i.cast("string"), F.lit(" shows "), failure).alias("customer_feedback"),
        i.alias("feedback_id"),
        F.lit("en").alias("language"),
        *[F.lit("x").alias(c) for c in ("timestamp", "vehicle_model", "domain", "country")],
    )
    return coerce_records(rows)


def test_run_sees_new_rows(spark, tmp_path):
    root = str(tmp_path / "run")
    lexicon = extraction.default_lexicon(spark, FAILURES)
    raw = complaints(spark, 600)
    settings = run.Settings(dimension=64, components=4)
    stages = run.analyse(raw, root, lexicon, settings)
    counts = {r["stage"]: r["rows"] for r in run.stage_counts(stages).collect()}
    n = counts["cleaned_feedback"]
    assert counts["raw_feedback"] == 600 and 0 < n <= 600
    for name in ("structured_entities", "embeddings", "reduced", "clustered_feedback"):
        assert counts[name] == n
    assert counts["cluster_labels"] == counts["summary"] >= 2
    merged = stages["clustered_feedback_refined"]
    found = violations(quality.check_clusters(stages["clustered_feedback"], stages["cluster_labels"]))
    assert set(found.values()) == {0}
    sizes = merged.filter("cluster_id <> -1").groupBy("cluster_id").count()
    labels = stages["cluster_labels"].join(sizes, "cluster_id")
    assert labels.filter(F.col("count") != F.col("failure_frequency")).count() == 0
    # every cluster names a component that its members have
    assert labels.filter("root_component = ''").count() == 0

    first = sorted(stages["cluster_labels"].collect())

    def written(name):
        return {d: os.stat(f"{root}/{name}/{d}/_SUCCESS").st_mtime_ns for d in os.listdir(f"{root}/{name}")}

    before, labelled = written("embeddings"), written("cluster_labels")
    again = run.analyse(raw, root, lexicon, settings)
    assert written("embeddings") == before
    assert written("cluster_labels").keys() == labelled.keys() and written("cluster_labels") != labelled
    assert sorted(again["cluster_labels"].collect()) == first

    more = run.analyse(complaints(spark, 660), root, lexicon, settings)
    assert len(written("embeddings")) == 2
    assert more["cleaned_feedback"].count() == 660 == more["raw_feedback"].count()
    assert more["cluster_labels"].agg(F.sum("failure_frequency")).first()[0] > sum(
        r["failure_frequency"] for r in first
    )


def violations(df):
    return {r["rule"]: r["violations"] for r in df.collect()}


def test_raw_from_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run.raw_from_folder(spark, str(tmp_path))
    (tmp_path / "x.csv").write_text("complaint_id,complaint_text,mileage_km\n1,text,\n")
    row = run.raw_from_folder(spark, str(tmp_path)).first()
    assert (row["feedback_id"], row["customer_feedback"], row["mileage"]) == ("1", "text", 0)
