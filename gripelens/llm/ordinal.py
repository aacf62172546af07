"""Cumulative-link ordinal regression on sparse text features.

Grades 0..K share one weight vector w; ordered thresholds t1 < t2 < ... cut the
score s = w x into grades: P(grade >= k) = 1 / (1 + exp(t_k - s)).  The expected grade
is the sum of these tail probabilities.

Features are hashed into buckets; a model keeps the buckets whose share of texts
differs significantly between low and high grades, so texts without any such feature
have the same score.  It is fitted on the driver from a sample of labelled rows whose
size is a documented bound; every row of the input is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.llm.words import sliced, text_array
from gripelens.session import materialise

BUCKETS = 1 << 18
SAMPLE = 6000
MIN_Z = 4.0
MIN_LIFT = 2.5
DECAY = 1e-4
STEPS = 500

#: Of some texts: (text, bucket, value), each pair once.
Extract = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Ordinal:
    """Weights by bucket (sorted) and ordered thresholds."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        weight = np.where(self.buckets[at] == bucket, self.weights[at], 0.0)
        return np.bincount(text, weight * value, n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))


def fit(
    text: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray,
    decay: float = DECAY, steps: int = STEPS,
) -> Ordinal:
    """Maximum likelihood with weight decay, by Adam over the whole sample.

    Threshold gaps are exponentials, so the order holds.  With one grade only there
    are no thresholds.
    """
    top = int(grade.max()) if grade.size else 0
    if top == 0:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    buckets, column = np.unique(bucket, return_inverse=True)
    n = grade.size
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)])
    start = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    start = np.maximum.accumulate(start + np.arange(top) * 1e-3)
    p = np.concatenate([np.zeros(len(buckets)), start[:1], np.log(np.diff(start))])
    m, v = np.zeros(p.size), np.zeros(p.size)
    rows, d = np.arange(n), len(buckets)
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        cuts = np.concatenate([[-np.inf], p[d] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(text, p[:d][column] * value, n)
        below = 1 / (1 + np.exp(-np.clip(cuts[:, None] - s, -500, 500)))  # P(grade < k)
        below[0], below[-1] = 0.0, 1.0
        a, b = below[grade + 1, rows], below[grade, rows]
        like = np.maximum(a - b, 1e-12)
        by_score = a + b - 1  # derivative of the log likelihood
        by_cut = np.zeros((top + 2, n))
        by_cut[grade + 1, rows] += a * (1 - a) / like
        by_cut[grade, rows] -= b * (1 - b) / like
        by_cut = by_cut.sum(1)[1:-1]
        g = np.empty(p.size)
        g[:d] = np.bincount(column, by_score[text] * value, d) / n - decay * p[:d]
        g[d] = by_cut.sum() / n
        g[d + 1 :] = gaps * np.cumsum(by_cut[::-1])[::-1][1:] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])
    return Ordinal(buckets.astype(np.int64), p[:d], cuts)


def telling(rows: DataFrame, high: Column) -> DataFrame:
    """(bucket): those whose share of rows differs between ``high`` and other rows.

    The difference must be ``MIN_Z`` standard errors and a factor of ``MIN_LIFT``.
    """
    counts = rows.agg(F.count_if(high).alias("high"), F.count_if(~high).alias("low")).first()
    n1, n0 = counts["high"], counts["low"]
    if not (n1 and n0):
        return rows.select(F.lit(0).alias("bucket")).limit(0)
    own = rows.select(high.cast("int").alias("high"), F.explode("buckets").alias("bucket"))
    found = own.groupBy("bucket").agg(F.sum("high").alias("a"), F.sum(1 - F.col("high")).alias("b"))
    pooled = (F.col("a") + F.col("b")) / (n1 + n0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0)) + 1e-12
    p1, p0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    strong = F.abs(F.col("a") / n1 - F.col("b") / n0) >= MIN_Z * error
    return found.filter(strong & (F.greatest(p1 / p0, p0 / p1) >= MIN_LIFT)).select("bucket")


def sampled_features(docs: DataFrame, sample: DataFrame, extract: Extract) -> DataFrame:
    """One row per sampled document with its grade columns, buckets and values.

    ``docs`` has (doc_id, _text).  ``sample`` has a bounded number of ids and is sent to
    all tasks; of repeated ids one row is used.
    """
    columns = [c for c in sample.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            text, bucket, value = extract(text_array(batch.column("_text")))
            order = np.argsort(text, kind="stable")
            ends = np.cumsum(np.bincount(text, minlength=batch.num_rows))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[batch.column(c) for c in columns],
                    pa.ListArray.from_arrays(offsets, pa.array(bucket[order].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value[order].astype(np.float64))),
                ],
                names=["doc_id", *columns, "buckets", "values"],
            )

    source = docs.join(F.broadcast(sample), "doc_id")
    source = source.select("doc_id", "_text", *[F.col(c).cast("int").alias(c) for c in columns])
    kind = source.schema["doc_id"].dataType.simpleString()
    own = ", ".join(f"{c} int" for c in columns)
    found = source.mapInArrow(run, f"doc_id {kind}, {own}, buckets array<int>, values array<double>")
    one = F.min(F.struct(*columns, "buckets", "values")).alias("row")
    return materialise(found.groupBy("doc_id").agg(one).select("doc_id", "row.*"), "sample")


def training_rows(
    rows: DataFrame, highs: list[Column]
) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The sample's grades, and (row, bucket, value) of its telling features.

    Features are chosen in Spark; the driver gets the chosen ones of a bounded sample.
    """
    grades = rows.drop("buckets", "values").toPandas()
    chosen = None
    for high in highs:
        own = telling(rows, high)
        chosen = own if chosen is None else chosen.union(own).distinct()
    if chosen is None:
        return grades, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    each = rows.select("doc_id", F.explode(F.arrays_zip("buckets", "values")).alias("f"))
    each = each.select("doc_id", F.col("f.buckets").alias("bucket"), F.col("f.values").alias("value"))
    found = each.join(chosen, "bucket").toPandas().sort_values(["doc_id", "bucket"])
    text = pd.Index(grades["doc_id"]).get_indexer(found["doc_id"])
    return grades, text, found["bucket"].to_numpy(np.int64), found["value"].to_numpy(np.float64)


def graded(docs: DataFrame, model: Ordinal, extract: Extract, least: float, text: str) -> DataFrame:
    """All columns of ``docs``, and a struct ``_graded``.

    It has the score, the expected grade, the tail probabilities and whether the first
    tail reaches ``least``.  Null texts are scored as empty ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for batch in sliced(batches, text):
            score = own.score(*extract(text_array(batch.column(text))), batch.num_rows)
            tails = own.tails(score)
            first = tails[:, 0] if tails.shape[1] else np.zeros(len(score))
            ends = np.arange(len(score) + 1, dtype=np.int32) * tails.shape[1]
            parts = [
                pa.array(score),
                pa.array(tails.sum(1)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(tails.reshape(-1))),
                pa.array(first >= least),
            ]
            names = ["score", "expected", "tails", "reached"]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.StructArray.from_arrays(parts, names)],
                names=[*batch.schema.names, "_graded"],
            )

    kind = "struct<score:double,expected:double,tails:array<double>,reached:boolean>"
    return docs.mapInArrow(run, _with(docs, "_graded", kind))


def _with(docs: DataFrame, name: str, kind: str) -> str:
    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return f"{own}, {name} {kind}"
