"""Toxicity grades by cumulative-link ordinal regression (see ``ordinal``).

Features are the distinct words of a text and their first letters, hashed, so a long text with a few toxic
words counts like a short one; their value grows with the logarithm of the count.
Labels say toxic or not.  The grades between come from the labelled rows: a toxic row
with more uses of telling words than the median toxic row is severe (2), the other
toxic rows are 1, all others 0.  A table that has grades already is used as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.llm import ordinal
from gripelens.llm.quality_rules import labelled_sample
from gripelens.llm.words import hashes, plain_words

LEAST = 0.3
STEM = 5


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, 1 + log count) of the hashed words and word stems of texts."""
    words = plain_words(texts)
    codes, distinct = words.coded()
    keys = []
    for seed, names in enumerate((distinct, pc.utf8_slice_codeunits(distinct, 0, STEM))):
        bucket = (hashes(names, seed) % np.uint64(ordinal.BUCKETS)).astype(np.int64)
        keys.append(words.text_of * ordinal.BUCKETS + bucket[codes])
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    return key // ordinal.BUCKETS, key % ordinal.BUCKETS, 1 + np.log(counts)


def train(docs: DataFrame, labels: DataFrame, sample: int = ordinal.SAMPLE, text: str = "text") -> ordinal.Ordinal:
    """A model from at most ``sample`` labelled rows of each side, toxic and not."""
    source = docs.select(docs["doc_id"], F.coalesce(docs[text], F.lit("")).alias("_text"))
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    parts = [labelled_sample(own.filter(c), ["toxic"], sample) for c in ("toxic > 0", "toxic <= 0")]
    rows = ordinal.sampled_features(source, parts[0].union(parts[1]).groupBy("doc_id").agg(F.min("toxic").alias("toxic")), word_features)
    grades, at, bucket, value = ordinal.training_rows(rows, [F.col("toxic") > 0])
    toxic = grades["toxic"].to_numpy(np.int64)
    grade = toxic
    if toxic.size and toxic.max() == 1:
        uses = np.bincount(at, np.exp(value - 1), toxic.size)
        middle = np.median(uses[toxic > 0])
        grade = np.where(toxic > 0, 1 + (uses > middle), 0)
        if not (grade == 2).any():
            grade = toxic
    return ordinal.fit(at, bucket, value, grade)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, score, severity, p_toxic, p_severe, rejected) for each row.

    ``severity`` is the expected grade; a row is rejected if P(grade >= 1) is at least
    ``least``.  Without labelled rows of both kinds nothing is known: severity 0, nothing
    is rejected.  A null or empty text has no words, hence the lowest score.
    """
    model = train(docs, labels, text=text)
    own = docs.select(docs["doc_id"], docs[text].alias("_text"))
    g = F.col("_graded")
    zero = F.lit(0.0)
    return ordinal.graded(own, model, word_features, least, "_text").select(
        "doc_id",
        g["score"].alias("score"),
        g["expected"].alias("severity"),
        F.coalesce(F.get(g["tails"], F.lit(0)), zero).alias("p_toxic"),
        F.coalesce(F.get(g["tails"], F.lit(1)), zero).alias("p_severe"),
        g["reached"].alias("rejected"),
    )


def accepted(docs: DataFrame, labels: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged."""
    model = train(docs, labels, text=text)
    # rows as one column, so that no column of theirs can clash with the verdict
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("_text"))
    marked = ordinal.graded(rows, model, word_features, least, "_text")
    return marked.filter(~F.col("_graded.reached")).select("row.*")
