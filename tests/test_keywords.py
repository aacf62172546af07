from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from gripelens.operators import keywords


def plain(texts, stop, cap):
    docs = [[t for t in re.findall(r"(?u)\b\w\w+\b", x.lower()) if t not in stop] for x in texts]
    total = Counter(t for d in docs for t in d)
    vocab = [t for t, _ in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:cap]]
    df = {t: sum(t in d for d in docs) for t in vocab}
    score = Counter()
    for d in docs:
        tf = Counter(t for t in d if t in df)
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            score[t] += v / norm / len(docs)
    return score


@pytest.mark.parametrize("cap", [4, 100])
def test_keywords_by_plain_python(spark, cap):
    rng = np.random.default_rng(15)
    words = ["gear", "noise", "oil", "leak", "the", "brake", "é1", "x", "lag", "hot"]
    rows, by_cluster = [], {}
    for i in range(60):
        text = " ".join(rng.choice(words, size=int(rng.integers(0, 9))))
        rows.append((i % 3, i, text))
        by_cluster.setdefault(i % 3, []).append(text)
    df = spark.createDataFrame(rows, "cluster_id int, feedback_id long, customer_feedback string")
    tokens = keywords.cluster_tokens(df, ["the"])
    weights = keywords.tfidf_weights(df, tokens, keywords.cluster_vocabulary(tokens, cap))
    got = {(r["cluster_id"], r["term"]): r["score"] for r in keywords.mean_scores(weights, df).collect()}
    expected = {}
    for c, texts in by_cluster.items():
        expected.update({(c, t): s for t, s in plain(texts, {"the"}, cap).items()})
    assert got == pytest.approx(expected)


def test_no_vocabulary_gives_an_empty_list(spark):
    df = spark.createDataFrame(
        [(1, 1, "the of"), (2, 2, "gear gear oil")],
        "cluster_id int, feedback_id long, customer_feedback string",
    )
    got = {r["cluster_id"]: r["keywords"] for r in keywords.cluster_keywords(df).collect()}
    assert got == {1: [], 2: ["gear", "oil"]}


def test_ties_go_to_the_later_term(spark):
    df = spark.createDataFrame([(1, 1, "aa bb cc")], "cluster_id int, feedback_id long, customer_feedback string")
    assert keywords.cluster_keywords(df, [], 2).first()["keywords"] == ["cc", "bb"]
