"""The registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gripelens.functions import entities as E
from gripelens.functions import labels as L
from gripelens.functions import text as T
from gripelens.operators import (
    cleaning,
    density,
    embedding,
    extraction,
    keywords,
    labeling,
    neighbours,
    quality,
    refine,
    reports,
    spectral,
    tree,
)
from gripelens.plans import run, views
from gripelens.schemas import TABLES
from gripelens.session import scratch_path
from gripelens.sources import csv, files, tables
from gripelens.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters that the oracle SQL shares.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "that", "for", "with", "on", "as", "by", "was", "an")
TOP_TERMS = 20
SEARCH_TEXT = "THE"
MERGE_THRESHOLD = 0.15
FACETS = {"language": ["en", "fr"], "domain": ["click", "view"], "country": []}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Cleaning ---------------------------------------------------------------


@query
def clean_text(spark, sf):
    return views.documents_as_feedback(spark, sf).select(
        "feedback_id", T.clean_text(F.col("customer_feedback")).alias("customer_feedback")
    )


@query
def scrub_counts(spark, sf):
    return cleaning.scrub_counts(views.documents_as_feedback(spark, sf))


@query
def dedupe_first(spark, sf):
    kept = cleaning.drop_duplicate_texts(views.documents_as_feedback(spark, sf))
    return kept.select("feedback_id", "language", "vehicle_model")


@query
def clean_feedback(spark, sf):
    return cleaning.clean_feedback(views.feedback(spark, sf))


@query
def cleaned_per_language(spark, sf):
    cleaned = cleaning.clean_feedback(views.documents_as_feedback(spark, sf))
    return (
        cleaned.groupBy("language")
        .agg(
            F.count("*").alias("complaints"),
            F.sum(F.length("customer_feedback")).alias("cleaned_chars"),
        )
        .orderBy(F.desc("complaints"), "language")
    )


@query
def cleaning_stats(spark, sf):
    return cleaning.cleaning_statistics(views.documents_as_feedback(spark, sf))


# Sources and stage tables -----------------------------------------------


def _foreign(spark, sf) -> DataFrame:
    """Feedback under the column names other systems use."""
    return views.feedback(spark, sf).withColumnsRenamed(
        {
            "feedback_id": "complaint_id",
            "customer_feedback": "complaint_text",
            "mileage": "mileage_km",
        }
    )


@query
def coerce_records(spark, sf):
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return tables.coerce_records(_foreign(spark, sf).withColumn("timestamp", iso))


@query
def insert_or_ignore(spark, sf):
    batch = tables.coerce_records(views.feedback(spark, sf))
    path = scratch_path(spark, "raw_feedback")
    number = F.col("feedback_id").cast("long")
    tables.insert_or_ignore(batch.filter("language = 'en'"), path, order=number)
    second = batch.withColumn("country", F.upper("country"))
    tables.insert_or_ignore(second.union(second), path, order=number)
    return spark.read.parquet(path).select("feedback_id", "language", "mileage")


@query
def upload_feedback(spark, sf):
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "raw_feedback")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    csv.write_csv(_foreign(spark, sf).withColumn("timestamp", iso), landed)
    tables.upload(spark, landed, path)
    tables.upload(spark, landed, path)
    return spark.read.parquet(path)


@query
def load_latest(spark, sf):
    """A drop of several part files with two column orders and repeated keys."""
    folder, path = scratch_path(spark, "landing"), scratch_path(spark, "raw_feedback")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = _foreign(spark, sf).withColumn("timestamp", iso)
    csv.write_csv(rows, f"{folder}/drop/a")
    turned = rows.select(*reversed(rows.columns)).filter("language = 'en'")
    csv.write_csv(turned, f"{folder}/drop/b")
    tables.load_latest(spark, folder, path)
    return spark.read.parquet(path)


@query
def latest_file(spark, sf):
    path = files.latest_path(spark, sf, "documents*.parquet")
    return spark.read.parquet(path).select("doc_id", "lang", "n_chars")


@query
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "documents_csv")
    csv.write_csv(views.table(spark, sf, "documents"), path)
    schema = views.table(spark, sf, "documents").schema
    return csv.read_csv(spark, path, schema)


@query
def export_report(spark, sf):
    path = scratch_path(spark, "report")
    labels = views.labels(spark, sf)
    csv.export_report(labels, path)
    return csv.read_csv(spark, path, labels.schema)


@query
def vector_roundtrip(spark, sf):
    path = scratch_path(spark, "vectors")
    tables.write_vectors(views.table(spark, sf, "embeddings"), path)
    v = F.transform("embedding", lambda x: x.cast("double"))
    return tables.read_vectors(spark, path).select(
        "vec_id",
        F.size("embedding").alias("dimension"),
        F.round(F.element_at(v, 1), 6).alias("first_value"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query
def sql_param_query(spark, sf):
    return tables.run_query(
        spark,
        "SELECT feedback_id, language, mileage FROM {feedback} "
        "WHERE language = :language AND mileage >= :mileage",
        {"language": "en", "mileage": 1000},
        feedback=views.feedback(spark, sf),
    )


@query
def table_count(spark, sf):
    return tables.table_count(views.feedback(spark, sf))


@query
def skip_existing(spark, sf):
    path = scratch_path(spark, "stage")
    """A stage is skipped for the same input and built again for another one."""
    cl = views.clustered(spark, sf)
    part = cl.filter("cluster_id = 0")

    def sizes(made: DataFrame, source: DataFrame) -> DataFrame:
        key = tables.fingerprint(source)
        return tables.stage(spark, path, lambda: reports.cluster_sizes(made), key=key)

    sizes(cl, cl)
    same = sizes(part, cl).withColumn("input", F.lit("same"))
    return same.union(sizes(part, part).withColumn("input", F.lit("new")))


# Entities ---------------------------------------------------------------


def _parsed(spark, sf) -> DataFrame:
    return E.parse_answers(views.answers(spark, sf), "content")


@query
def entity_parse(spark, sf):
    return _parsed(spark, sf).filter("parse_status = 'success'").select("feedback_id", "entity.*")


@query
def entity_repair(spark, sf):
    parsed = _parsed(spark, sf).filter("parse_status = 'malformed'")
    return parsed.select(
        "feedback_id", F.col("entity").isNotNull().alias("repaired"), "entity.component", "entity.severity"
    )


@query
def entity_validate(spark, sf):
    valid = E.valid_entity(F.col("entity"))
    return _parsed(spark, sf).select("feedback_id", valid.alias("e")).select("feedback_id", "e.*")


@query
def entity_rows(spark, sf):
    return extraction.entity_rows(_parsed(spark, sf))


@query
def extraction_stats(spark, sf):
    return extraction.extraction_statistics(_parsed(spark, sf))


@query
def format_entities(spark, sf):
    return extraction.format_entities(views.entities(spark, sf)).select("feedback_id", "formatted_text")


def query_lexicon(spark, sf) -> DataFrame:
    """Lexicon made from the benchmark texts: every distinct word of 4 to 9 letters.

    The word length decides the field and is the priority.
    """
    words = views.table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    )
    size = F.length("term")
    field = (
        F.when(size == 4, "severity")
        .when(size == 5, "driving_condition")
        .when(size == 6, "symptom")
        .when(size == 7, "failure_mode")
        .otherwise("component")
    )
    return words.distinct().filter(size.between(4, 9)).select(
        "term",
        F.lit(None).cast("string").alias("language"),
        field.alias("field"),
        F.col("term").alias("value"),
        size.alias("priority"),
    )


@query
def lexicon_matches(spark, sf):
    fb = views.documents_as_feedback(spark, sf)
    found = extraction.lexicon_matches(fb, query_lexicon(spark, sf), max_words=1)
    return found.groupBy("feedback_id", "field").agg(
        F.count("*").alias("hits"), F.min("position").cast("long").alias("first_position")
    )


@query
def lexicon_entities(spark, sf):
    fb = views.documents_as_feedback(spark, sf)
    return extraction.extract_entities(fb, query_lexicon(spark, sf))


# Reports ----------------------------------------------------------------


@query
def noise_flag_coords(spark, sf):
    cl = views.clustered(spark, sf)
    reduced = cl.select("feedback_id", F.col("embedding").alias("reduced"))
    out = reports.assignment(cl.drop("embedding"), reduced)
    return out.withColumns({c: F.round(c, 6) for c in ("umap_x", "umap_y", "cluster_confidence")})


@query
def cluster_map(spark, sf):
    cl = views.clustered(spark, sf)
    reduced = cl.select("feedback_id", F.col("embedding").alias("reduced"))
    points = reports.cluster_map(reports.assignment(cl.drop("embedding"), reduced))
    return points.withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query
def display_fields(spark, sf):
    fb, lab = views.documents_as_feedback(spark, sf), views.labels(spark, sf)
    shown = fb.select(
        "feedback_id",
        T.display_text(F.col("customer_feedback")).alias("preview"),
        F.upper("language").alias("language"),
    )
    confidence = lab.agg(T.percent_text(F.max("confidence")).alias("c")).scalar()
    return shown.withColumn("confidence", confidence)


@query
def label_table(spark, sf):
    return reports.label_table(views.labels(spark, sf))


@query
def summary_table(spark, sf):
    return reports.summary_table(views.labels(spark, sf))


@query
def facet_search(spark, sf):
    found = reports.facet_search(views.feedback(spark, sf), FACETS)
    return found.select("feedback_id", "vehicle_model", "language", "domain", "country")


@query
def facet_search_page(spark, sf):
    found = reports.facet_search(views.feedback(spark, sf), FACETS)
    return reports.head(found, 20).select("feedback_id", "language", "domain", "customer_feedback")


@query
def facet_values(spark, sf):
    return reports.facet_values(
        views.feedback(spark, sf), ["vehicle_model", "language", "domain", "country"]
    )


@query
def search_feedback(spark, sf):
    found = reports.search_feedback(
        views.feedback(spark, sf), views.clustered(spark, sf), SEARCH_TEXT, cluster_id=3
    )
    return found.select("feedback_id", "language", "customer_feedback")


@query
def cluster_lookup(spark, sf):
    return reports.cluster_lookup(views.labels(spark, sf), "pattern 3")


@query
def cluster_members(spark, sf):
    members = reports.cluster_members(views.feedback(spark, sf), views.clustered(spark, sf), 3)
    return members.drop("timestamp")


@query
def cluster_texts(spark, sf):
    return reports.cluster_texts(
        views.documents_as_feedback(spark, sf), views.clustered(spark, sf)
    )


@query
def cluster_stats(spark, sf):
    return reports.cluster_statistics(views.clustered(spark, sf))


@query
def cluster_preview(spark, sf):
    return reports.head(views.clustered(spark, sf).drop("embedding"), 10)


@query
def cluster_ids(spark, sf):
    return reports.cluster_ids(views.clustered(spark, sf))


@query
def cluster_info(spark, sf):
    info = reports.cluster_info(views.clustered(spark, sf))
    return info.withColumn("percentage", F.round("percentage", 6))


@query
def failure_frequency(spark, sf):
    return reports.failure_frequency(views.clustered(spark, sf))


@query
def failure_totals(spark, sf):
    return reports.failure_totals(views.labels(spark, sf))


@query
def overview_metrics(spark, sf):
    return reports.overview_metrics(views.clustered(spark, sf), views.labels(spark, sf))


@query
def language_counts(spark, sf):
    return reports.value_counts(views.documents_as_feedback(spark, sf), "language")


@query
def country_top8(spark, sf):
    return reports.value_counts(views.feedback(spark, sf), "country", 8)


@query
def model_top6(spark, sf):
    return reports.value_counts(views.documents_as_feedback(spark, sf), "vehicle_model", 6)


@query
def component_top5(spark, sf):
    return reports.value_counts(views.labels(spark, sf), "root_component", 5)


@query
def component_top8(spark, sf):
    return reports.value_counts(views.labels(spark, sf), "root_component", 8)


@query
def top_failures(spark, sf):
    return reports.top_failures(views.labels(spark, sf))


@query
def analytics(spark, sf):
    """The three analytics frames as one table of (section, name, value)."""
    parts = reports.analytics(views.labels(spark, sf))
    top = parts["top_failures"].select(
        F.lit("top_failure").alias("section"),
        F.col("label").alias("name"),
        F.col("failure_frequency").alias("value"),
    )
    components = parts["components"].select(
        F.lit("component"), F.col("root_component"), F.col("count")
    )
    totals = parts["totals"].select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("total").alias("a"), F.lit(c).alias("b"), F.col(c).alias("c"))
                    for c in ("total_clusters", "total_failures")
                ]
            )
        )
    )
    return top.union(components).union(totals)


@query
def severity_distribution(spark, sf):
    return reports.severity_distribution(views.labels(spark, sf))


@query
def representatives(spark, sf):
    return reports.representatives(views.clustered(spark, sf))


@query
def representative_complaints(spark, sf):
    return reports.representative_complaint(
        views.clustered(spark, sf), views.documents_as_feedback(spark, sf)
    )


# Labels and keywords ----------------------------------------------------


def _cluster_texts(spark, sf) -> DataFrame:
    return reports.cluster_texts(
        views.documents_as_feedback(spark, sf), views.clustered(spark, sf)
    )


@query
def prompt_snippets(spark, sf):
    texts = reports.first_texts(
        views.clustered(spark, sf), views.documents_as_feedback(spark, sf)
    )
    return texts.select("cluster_id", L.snippet_list(F.col("sample_texts")).alias("snippets"))


@query
def label_json(spark, sf):
    """Label answers made from the entity answers, parsed with defaults."""
    content = F.replace(F.col("content"), F.lit('"component"'), F.lit('"label"'))
    content = F.replace(content, F.lit('"symptom"'), F.lit('"recurring_symptom"'))
    answers = views.answers(spark, sf).select(
        "feedback_id",
        F.split(F.lit("red bolt ring"), " ").alias("keywords"),
        content.alias("content"),
    )
    return labeling.label_from_answer(answers).drop("keywords")


@query
def fallback_label(spark, sf):
    words = F.filter(
        F.split("text", " "), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(*STOP_WORDS)
    )
    return views.table(spark, sf, "benchmark").select(
        "item_id", L.fallback_label(words).alias("label")
    )


@query
def tfidf_tokens(spark, sf):
    rows = keywords.cluster_tokens(_cluster_texts(spark, sf), STOP_WORDS)
    return rows.groupBy("cluster_id", "feedback_id").agg(
        F.count("*").alias("token_count"),
        F.count_distinct("term").alias("term_count"),
        F.min("term").alias("first_term"),
        F.max("term").alias("last_term"),
    )


@query
def tfidf_vocab(spark, sf):
    return keywords.cluster_vocabulary(keywords.cluster_tokens(_cluster_texts(spark, sf), STOP_WORDS))


def _weights(spark, sf) -> tuple[DataFrame, DataFrame]:
    texts = _cluster_texts(spark, sf)
    rows = keywords.cluster_tokens(texts, STOP_WORDS)
    return texts, keywords.tfidf_weights(texts, rows)


@query
def tfidf_weights(spark, sf):
    return _weights(spark, sf)[1].withColumn("weight", F.round("weight", 9))


@query
def tfidf_scores(spark, sf):
    texts, weights = _weights(spark, sf)
    return keywords.mean_scores(weights, texts).withColumn("score", F.round("score", 9))


@query
def tfidf_keywords(spark, sf):
    found = keywords.cluster_keywords(_cluster_texts(spark, sf), STOP_WORDS)
    return found.select("cluster_id", F.array_join("keywords", " ").alias("keywords"))


@query
def label_clusters(spark, sf):
    return labeling.label_clusters(
        views.clustered(spark, sf),
        views.entities(spark, sf),
        views.documents_as_feedback(spark, sf),
        STOP_WORDS,
    )


# Quality ----------------------------------------------------------------


@query
def quality_cleaning(spark, sf):
    return quality.check_cleaning(views.documents_as_feedback(spark, sf))


@query
def quality_extraction(spark, sf):
    return quality.check_extraction(views.entities(spark, sf), _parsed(spark, sf))


@query
def quality_vectors(spark, sf):
    return quality.check_vectors(views.table(spark, sf, "embeddings"))


@query
def quality_clusters(spark, sf):
    return quality.check_clusters(views.clustered(spark, sf), views.labels(spark, sf))


@query
def quality_constraints(spark, sf):
    return quality.check_constraints(views.feedback(spark, sf), TABLES["raw_feedback"])


@query
def orphan_keys(spark, sf):
    """Documents without a vector and vectors without a document."""
    docs, cl = views.documents_as_feedback(spark, sf), views.clustered(spark, sf)
    missing = quality.orphan_keys(docs, cl).withColumn("missing_in", F.lit("vectors"))
    extra = quality.orphan_keys(cl, docs).withColumn("missing_in", F.lit("documents"))
    return missing.union(extra)


@query
def silhouette(spark, sf):
    cl = views.clustered(spark, sf)
    return _rounded(quality.silhouette(cl, cl), "silhouette")


# Vectors ----------------------------------------------------------------


def _vectors(spark, sf) -> DataFrame:
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("feedback_id"), "embedding")


@query
def embedding_metadata(spark, sf):
    return embedding.embedding_metadata(_vectors(spark, sf))


@query
def text_vectors(spark, sf):
    texts = extraction.format_entities(views.entities(spark, sf))
    return embedding.embed_texts(texts).select(
        "feedback_id",
        F.size("embedding").alias("dimension"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"),
    )


@query
def reduce_pca(spark, sf):
    return embedding.reduce_dimensions(_vectors(spark, sf))


@query
def centroids(spark, sf):
    cl = views.clustered(spark, sf)
    found = refine.cluster_centroids(cl, cl, "embedding")
    return found.select("cluster_id", F.posexplode("centroid").alias("pos", "value")).select(
        "cluster_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


def _centroids(spark, sf) -> DataFrame:
    cl = views.clustered(spark, sf)
    return refine.cluster_centroids(cl, cl, "embedding")


@query
def centroid_pairs(spark, sf):
    found = refine.similar_pairs(_centroids(spark, sf), MERGE_THRESHOLD)
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def merge_map(spark, sf):
    return refine.merge_map(refine.similar_clusters(_centroids(spark, sf), MERGE_THRESHOLD))


@query
def apply_merges(spark, sf):
    merges = views.table(spark, sf, "region").select(
        (F.col("r_regionkey") + 5).alias("old_id"), F.col("r_regionkey").alias("new_id")
    )
    return refine.apply_merges(views.clustered(spark, sf).drop("embedding"), merges)


@query
def refine_clusters(spark, sf):
    cl = views.clustered(spark, sf)
    refined = refine.refine_clusters(cl, cl, MERGE_THRESHOLD, "embedding")
    return refined.select("feedback_id", "cluster_id")


def _rounded(edges: DataFrame, *columns: str) -> DataFrame:
    return edges.withColumns({c: F.round(c, 6) for c in columns})


@query
def knn_cosine(spark, sf):
    return _rounded(neighbours.knn_graph(_vectors(spark, sf), 15, "cosine"), "dist")


@query
def knn_euclidean(spark, sf):
    return _rounded(neighbours.knn_graph(_vectors(spark, sf), 10, "euclidean"), "dist")


@query
def core_distance(spark, sf):
    knn = neighbours.knn_graph(_vectors(spark, sf), 10, "euclidean")
    return _rounded(neighbours.core_distances(knn, 10), "core")


@query
def mutual_reachability(spark, sf):
    knn = tables.stage(
        spark,
        scratch_path(spark, "knn"),
        lambda: neighbours.knn_graph(_vectors(spark, sf), 10, "euclidean"),
    )
    edges = neighbours.mutual_reachability(knn, neighbours.core_distances(knn, 10))
    return _rounded(edges, "dist", "weight")


@query
def fuzzy_graph(spark, sf):
    knn = neighbours.knn_graph(_vectors(spark, sf), 15, "cosine")
    return _rounded(neighbours.fuzzy_graph(knn), "weight")


@query
def spectral_axes(spark, sf):
    """What holds for each axis of the fuzzy graph, recomputed from all rows."""
    knn = neighbours.knn_graph(_vectors(spark, sf), 15, "cosine")
    graph = tables.stage(spark, scratch_path(spark, "graph"), lambda: neighbours.fuzzy_graph(knn))
    rows, axes = spectral.spectral_axes(graph)
    return spectral.axis_checks(graph, rows, axes).select(
        "axis",
        F.col("eigenvalue").between(-1.000001, 1.000001).alias("in_range"),
        (F.col("residual") < 2 * spectral.TOLERANCE).alias("settled"),
        (F.col("overlap") < 1e-8).alias("orthonormal"),
    )


@query
def mst_total_weight(spark, sf):
    found = tree.minimum_spanning_tree(_vectors(spark, sf))
    return found.agg(
        F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("total_weight")
    )


@query
def density_clusters(spark, sf):
    reduced = tables.stage(
        spark,
        scratch_path(spark, "reduced"),
        lambda: embedding.reduce_dimensions(_vectors(spark, sf)),
    )
    return density.density_clusters(reduced).assignment


@query
def stream_ingest(spark, sf):
    landed, path = scratch_path(spark, "drops"), scratch_path(spark, "raw_feedback")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    fb = views.feedback(spark, sf).withColumn("timestamp", iso)
    checkpoint = scratch_path(spark, "stream")
    for part in (fb.filter("language = 'en'"), fb):
        csv.write_csv(part, landed, mode="append")
        rows = ingest.read_drops(spark, landed, csv.text_schema(*fb.columns))
        ingest.ingest(rows, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query
def feedback_end_to_end(spark, sf):
    fb = views.feedback(spark, sf).withColumn("timestamp", F.col("timestamp").cast("string"))
    stages = run.analyse(
        tables.coerce_records(fb),
        lexicon=query_lexicon(spark, sf),
        settings=run.Settings(dimension=256, stop_words=STOP_WORDS),
    )
    return stages["cluster_labels"]
