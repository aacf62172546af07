"""Quality grades by cumulative-link ordinal regression (see ``ordinal``).

Ratings are 0 (poor), 1 (good quality but toxic) and 2 (good); a table with a column
``rating`` is used as it is.  Features are hashed words and hashed word shapes (runs
of capitals, small letters and digits, other signs as they are), weighted by the root
of their share of the words, so that the style of a text counts and not its length.
The expected grade ranks texts, the tail probability P(rating >= 1) selects them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.llm import ordinal
from gripelens.llm.quality_rules import labelled_sample
from gripelens.llm.words import hashes, space_words

LEAST = 0.5
SCALE = 4.0


def _shapes(distinct: pa.Array) -> pa.Array:
    shape = distinct
    for pattern, to in (("[0-9]+", "0"), ("[a-z\\x{80}-\\x{10FFFF}]+", "a"), ("[A-Z]+", "A")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    return shape


def style_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, scaled root of the share) of hashed words and word shapes."""
    words = space_words(texts)
    codes, distinct = words.coded()
    total = np.maximum(words.per_text, 1)
    keys = []
    for seed, names in enumerate((distinct, _shapes(distinct))):
        bucket = (hashes(names, seed) % np.uint64(ordinal.BUCKETS)).astype(np.int64)
        keys.append(words.text_of * ordinal.BUCKETS + bucket[codes])
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    text = key // ordinal.BUCKETS
    return text, key % ordinal.BUCKETS, SCALE * np.sqrt(counts / total[text])


def train(docs: DataFrame, labels: DataFrame, sample: int = ordinal.SAMPLE, text: str = "text") -> ordinal.Ordinal:
    """A model from at most ``sample`` labelled rows."""
    source = docs.select(docs["doc_id"], F.coalesce(docs[text], F.lit("")).alias("_text"))
    if "rating" not in labels.columns:
        good = F.col("quality") > 0
        rating = F.when(good & (F.col("toxic") <= 0), 2).when(good, 1).otherwise(0)
        labels = labels.dropna(subset=["quality", "toxic"]).select("doc_id", rating.alias("rating"))
    own = labelled_sample(labels.select("doc_id", F.col("rating").cast("int").alias("rating")), ["rating"], sample)
    rows = ordinal.sampled_features(source, own, style_features)
    top = rows.agg(F.max("rating")).first()[0] or 0
    grades, at, bucket, value = ordinal.training_rows(rows, [F.col("rating") >= k for k in range(1, top + 1)])
    return ordinal.fit(at, bucket, value, grades["rating"].to_numpy(np.int64))


def quality(docs: DataFrame, labels: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, score, expected, p_good, p_best, kept) for each row.

    ``kept`` is P(rating >= 1) of at least ``least``.  Without ratings of two kinds nothing
    is known and all is kept.  A null or empty text has no features.
    """
    model = train(docs, labels, text=text)
    own = docs.select(docs["doc_id"], docs[text].alias("_text"))
    g = F.col("_graded")
    one = F.lit(1.0)
    return ordinal.graded(own, model, style_features, least, "_text").select(
        "doc_id",
        g["score"].alias("score"),
        g["expected"].alias("expected"),
        F.coalesce(F.get(g["tails"], F.lit(0)), one).alias("p_good"),
        F.coalesce(F.get(g["tails"], F.lit(1)), one).alias("p_best"),
        (g["reached"] if len(model.thresholds) else F.lit(True)).alias("kept"),
    )
