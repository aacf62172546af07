"""TF-IDF keywords, each cluster being a corpus of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gripelens.functions.text import tokens
from gripelens.session import materialise

KEYWORDS = 5


def _stop_words(stop_words: Sequence[str] | None) -> Sequence[str]:
    if stop_words is None:
        return StopWordsRemover.loadDefaultStopWords("english")
    return stop_words


def cluster_tokens(
    texts: DataFrame, stop_words: Sequence[str] | None = None, text: str = "customer_feedback"
) -> DataFrame:
    """(cluster_id, feedback_id, term): one row per token, repeats kept.

    ``stop_words`` defaults to Spark's English list; any list can be given.
    """
    return texts.select(
        "cluster_id",
        "feedback_id",
        F.explode(tokens(F.col(text), _stop_words(stop_words))).alias("term"),
    )


def cluster_vocabulary(token_rows: DataFrame, max_terms: int | None = None) -> DataFrame:
    """The terms of each cluster: (cluster_id, term, total).

    With ``max_terms`` only the most frequent ones; the rank filter then keeps at most
    that many rows per cluster and task before the second shuffle.
    """
    totals = token_rows.groupBy("cluster_id", "term").agg(F.count("*").alias("total"))
    if max_terms is None:
        return totals
    rank = F.row_number().over(
        Window.partitionBy("cluster_id").orderBy(F.desc("total"), F.asc("term"))
    )
    return totals.withColumn("_rank", rank).filter(F.col("_rank") <= max_terms).drop("_rank")


def tfidf_weights(
    texts: DataFrame, token_rows: DataFrame, vocabulary: DataFrame | None = None
) -> DataFrame:
    """(cluster_id, feedback_id, term, weight), rows of length one per document.

    Smoothed idf over the cluster's own documents.  A vocabulary, if given, cuts the
    tokens before anything else is grouped.  The term counts are written once, so the
    texts are cut into tokens once.
    """
    if vocabulary is not None:
        known = vocabulary.select("cluster_id", "term")
        token_rows = token_rows.join(known, ["cluster_id", "term"], "left_semi")
    counts = token_rows.groupBy("cluster_id", "feedback_id", "term").agg(F.count("*").alias("tf"))
    counts = materialise(counts, "terms")
    documents = texts.groupBy("cluster_id").agg(F.count("*").alias("n"))
    idf = (
        counts.groupBy("cluster_id", "term")
        .agg(F.count("*").alias("df"))
        .join(documents, "cluster_id")
        .select(
            "cluster_id",
            "term",
            (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
        )
    )
    raw = counts.join(idf, ["cluster_id", "term"]).withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(
        F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("cluster_id", "feedback_id"))
    )
    return raw.select("cluster_id", "feedback_id", "term", (F.col("_w") / norm).alias("weight"))


def mean_scores(weights: DataFrame, texts: DataFrame) -> DataFrame:
    """Mean weight per term over all documents of the cluster, absent terms as 0."""
    documents = texts.groupBy("cluster_id").agg(F.count("*").alias("n"))
    sums = weights.groupBy("cluster_id", "term").agg(F.sum("weight").alias("_sum"))
    return sums.join(documents, "cluster_id").select(
        "cluster_id", "term", (F.col("_sum") / F.col("n")).alias("score")
    )


def rank_keywords(scores: DataFrame, count: int = KEYWORDS) -> DataFrame:
    """The best terms per cluster, equal scores by descending term.

    Scores are compared to 12 digits, so the order of summing cannot decide.
    """
    rank = F.row_number().over(
        Window.partitionBy("cluster_id").orderBy(F.desc(F.round("score", 12)), F.desc("term"))
    )
    return scores.withColumn("rank", rank).filter(F.col("rank") <= count)


def cluster_keywords(
    texts: DataFrame,
    stop_words: Sequence[str] | None = None,
    count: int = KEYWORDS,
    max_terms: int | None = None,
    text: str = "customer_feedback",
) -> DataFrame:
    """(cluster_id, keywords): best terms first, an empty list without a vocabulary."""
    token_rows = cluster_tokens(texts, stop_words, text)
    vocabulary = None if max_terms is None else cluster_vocabulary(token_rows, max_terms)
    weights = tfidf_weights(texts, token_rows, vocabulary)
    best = (
        rank_keywords(mean_scores(weights, texts), count)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
        .select("cluster_id", F.col("_t.term").alias("keywords"))
    )
    return (
        texts.select("cluster_id")
        .distinct()
        .join(best, "cluster_id", "left")
        .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    )
