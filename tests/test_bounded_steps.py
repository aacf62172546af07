"""Steps that small inputs settle in one task, against the rounds that large ones take."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gripelens.operators import density, extraction, tree
from gripelens.plans import run
from test_run import complaints


def test_pointers_in_one_task(spark):
    rng = np.random.default_rng(5)
    to = [int(rng.integers(i, 400)) if i < 390 else i for i in range(400)]
    rows = [(7 * i, 7 * j) for i, j in enumerate(to)] + [(5000, 6000), (5001, 5000)]
    pointers = spark.createDataFrame(rows, "id long, root long")
    expected = sorted(tree.resolve(pointers).collect())
    assert sorted(tree.resolve(pointers, len(rows)).collect()) == expected
    assert len(expected) == 400


def test_clusters_chosen_in_one_task(spark):
    rng = np.random.default_rng(6)
    n = 300
    parents = [min(int(i + rng.integers(1, 9)), n) for i in range(n)]
    rows = [(i, parents[i], float(rng.integers(0, 6))) for i in range(n)] + [(n, None, 3.0)]
    rows[4] = (4, parents[4], float("inf"))
    rows[9] = (9, parents[9], float("nan"))
    stability = spark.createDataFrame(rows, "cluster long, parent long, stability double")
    expected = sorted(density.select_clusters(stability).collect())
    assert sorted(density.select_clusters(stability, len(rows)).collect()) == expected


def test_raw_rows_are_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.StringType())
    def told(text):
        seen.add(1)
        return text

    raw = complaints(spark, 60).withColumn("country", told("country"))
    settings = run.Settings(dimension=16, components=2)
    stages = run.analyse(raw, str(tmp_path / "run"), extraction.default_lexicon(spark, ["pump rattle"]), settings)
    assert stages["cleaned_feedback"].count() == 60
    assert seen.value == 60
