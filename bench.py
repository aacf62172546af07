"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  Every query
is run to its last column with the ``noop`` sink.  One small query runs first
so that JVM start-up is not charged to the first one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gripelens.plans.catalog import QUERIES  # noqa: E402
from gripelens.session import build_session  # noqa: E402

HEADLINE = (
    "cleaned_per_language",
    "clean_feedback",
    "cleaning_stats",
    "csv_roundtrip",
    "insert_or_ignore",
    "entity_validate",
    "lexicon_entities",
    "text_vectors",
    "reduce_pca",
    "knn_cosine",
    "knn_euclidean",
    "fuzzy_graph",
    "mst_total_weight",
    "density_clusters",
    "refine_clusters",
    "tfidf_keywords",
    "label_clusters",
    "representatives",
    "analytics",
    "overview_metrics",
    "search_feedback",
    "facet_search",
    "quality_cleaning",
    "silhouette",
    "feedback_end_to_end",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", cpus, spark__driver__memory="12g", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["table_count"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
