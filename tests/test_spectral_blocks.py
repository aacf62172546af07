"""Products with the graph in blocks of nodes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gripelens.operators import skew, spectral


def ring(spark, n):
    """Each node tied to the next two; the first one to every fourth node as well."""
    rng = np.random.default_rng(3)
    ends = {(i, (i + s) % n) for i in range(n) for s in (1, 2)} | {(0, j) for j in range(4, n, 4)}
    ends = sorted({(min(e), max(e)) for e in ends})
    rows = [(3 * i, 3 * j, float(w)) for (i, j), w in zip(ends, rng.uniform(0.2, 1, len(ends)))]
    w = np.zeros((n, n))
    for i, j, x in rows:
        w[i // 3, j // 3] = w[j // 3, i // 3] = x
    return spark.createDataFrame(rows, "src long, dst long, weight double"), w / np.sqrt(np.outer(w.sum(0), w.sum(0)))


@pytest.mark.parametrize("large", [skew.LARGE, 8])
def test_a_block_sends_the_rows_that_are_asked_for(spark, monkeypatch, large):
    graph, s = ring(spark, 320)
    monkeypatch.setattr(skew, "LARGE", large)
    edges, nodes, total, _ = spectral._normalised(graph)
    grid = spectral._grid(edges, nodes, total)
    assert (grid.sends is not None) == (large == 8)
    first = spectral._first(grid, nodes, 3)
    parcels = spectral._sent(grid, first, lambda rows: spectral._matrix(rows.column("x"), 0, 3))
    rows = parcels.filter("sender >= 0").agg(F.sum(F.length("x") / 24)).first()[0]
    assert rows <= edges.count()
    x = np.concatenate([np.frombuffer(r["x"]).reshape(3, -1) for r in first.orderBy("block").collect()], axis=1)
    again = spectral._factor(grid, parcels, 3, -0.5)
    both = spectral._ahead(grid, again, 3).orderBy("block").collect()
    got, ahead = (np.concatenate([np.frombuffer(r[c]).reshape(3, -1) for r in both], axis=1) for c in "xz")
    expected = (x @ s + 0.5 * x) / 1.5
    assert np.allclose(got, expected) and np.allclose(ahead, expected @ s)


def test_axes_of_a_graph_with_a_hub_in_parts(spark, monkeypatch):
    graph, s = ring(spark, 90)
    monkeypatch.setattr(skew, "LARGE", 4)
    rows, axes = spectral.spectral_axes(graph, 3)
    expected = np.linalg.eigvalsh(s)[::-1][:4]
    assert np.allclose([r["eigenvalue"] for r in axes.orderBy("axis").collect()], expected, atol=1e-6)
    v = np.array([r[1:] for r in rows.orderBy("id").collect()])
    assert np.linalg.norm(s @ v - v * expected, axis=0).max() < 1e-3


def test_a_part_without_edges(spark, monkeypatch):
    """Many edges to one node alone are in one part, and that need not be the first."""
    monkeypatch.setattr(skew, "LARGE", 1)
    for node in range(1, 4):
        pair = spark.createDataFrame([(0, node, 0.1)] * 9, "src long, dst long, weight double")
        rows, axes = spectral.spectral_axes(pair)
        assert sorted(round(r["eigenvalue"], 9) for r in axes.collect()) == [-1, 1]
