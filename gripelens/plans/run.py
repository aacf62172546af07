"""The whole analysis, stage table by stage table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gripelens.operators.cleaning import clean_feedback
from gripelens.operators.density import density_clusters
from gripelens.operators.embedding import embed_texts, embedding_metadata, reduce_dimensions
from gripelens.operators.extraction import extract_entities, format_entities
from gripelens.operators.labeling import label_clusters
from gripelens.operators.refine import refine_clusters
from gripelens.operators.reports import assignment, cluster_info, summary_table
from gripelens.session import materialise, release, scratch_path
from gripelens.sources.csv import read_csv
from gripelens.sources.files import latest_drop
from gripelens.sources.tables import (
    FOREIGN_NAMES,
    coerce_records,
    fingerprint,
    insert_or_ignore,
    stage,
)


@dataclass(frozen=True)
class Settings:
    """Model parameters of a run."""

    dimension: int = 1024
    components: int = 15
    min_cluster_size: int = 10
    min_samples: int | None = None
    metric: str = "euclidean"
    merge_threshold: float = 0.90
    stop_words: Sequence[str] | None = None


@dataclass(frozen=True)
class Hooks:
    """Optional user models: completions for entities and labels, an encoder."""

    entity: Callable[[str], str] | None = None
    label: Callable[[str], str] | None = None
    encoder: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None


def raw_from_folder(
    spark: SparkSession,
    directory: str,
    pattern: str = "*.csv",
    names: Mapping[str, str] = FOREIGN_NAMES,
) -> DataFrame:
    """All files of the newest drop of the landing folder; an error if there is none."""
    paths = latest_drop(spark, directory, pattern)
    if not paths:
        raise FileNotFoundError(f"no {pattern} in {directory}")
    return coerce_records(read_csv(spark, paths), names)


def analyse(
    raw: DataFrame,
    root: str | None = None,
    lexicon: DataFrame | None = None,
    settings: Settings = Settings(),
    hooks: Hooks = Hooks(),
    resume: bool = True,
) -> dict[str, DataFrame]:
    """Run all stages over raw feedback and return the stage tables by name.

    Tables are written under ``root``.  With ``resume`` the stages up to the
    reduced vectors are skipped when their table is complete and was made from the
    same rows, lexicon and settings; clustering, merging and labelling always run.
    Rows whose completion fails keep a default entity and their ``parse_status`` and go
    through all stages; filter ``structured_entities`` to find them.
    Hooks are told apart by their names alone.  Ids that are numbers are ordered as
    numbers.
    """
    spark = raw.sparkSession
    root = root or scratch_path(spark, "run")
    raw = materialise(raw, "raw")  # read three times below

    names = [getattr(h, "__qualname__", str(h)) for h in (hooks.entity, hooks.encoder)]
    words = fingerprint(lexicon)
    key = fingerprint(raw, words, settings.dimension, settings.components, names, "every row")

    def keep(name: str, build: Callable[[], DataFrame], again: bool = False) -> DataFrame:
        return stage(spark, f"{root}/{name}", build, resume and not again, key)

    raw_path = f"{root}/raw_feedback"
    number = F.col("feedback_id").try_cast("long")
    insert_or_ignore(raw, raw_path)
    stored = spark.read.parquet(raw_path)
    cleaned = keep("cleaned_feedback", lambda: clean_feedback(raw, order=F.struct(number, "feedback_id")))
    release(raw)
    entities = keep(
        "structured_entities",
        lambda: extract_entities(cleaned, lexicon, call=hooks.entity, every_row=True),
    )
    formatted = keep("formatted_entities", lambda: format_entities(entities))
    vectors = keep(
        "embeddings",
        lambda: embed_texts(
            formatted, dimension=settings.dimension, make_encoder=hooks.encoder
        ),
    )
    metadata = keep("embeddings_metadata", lambda: embedding_metadata(vectors))
    reduced = keep("reduced", lambda: reduce_dimensions(vectors, settings.components))

    found = density_clusters(
        reduced, settings.min_cluster_size, settings.min_samples, settings.metric
    )
    clustered = keep("clustered_feedback", lambda: assignment(found.assignment, reduced), True)
    info = keep("cluster_info", lambda: cluster_info(clustered, found.info), True)
    refined = keep(
        "clustered_feedback_refined",
        lambda: refine_clusters(clustered, reduced, settings.merge_threshold),
        True,
    )
    labels = keep(
        "cluster_labels",
        lambda: label_clusters(
            refined, entities, cleaned, settings.stop_words, call=hooks.label
        ),
        True,
    )
    return {
        "raw_feedback": stored,
        "cleaned_feedback": cleaned,
        "structured_entities": entities,
        "formatted_entities": formatted,
        "embeddings": vectors,
        "embeddings_metadata": metadata,
        "reduced": reduced,
        "clustered_feedback": clustered,
        "cluster_info": info,
        "clustered_feedback_refined": refined,
        "cluster_labels": labels,
        "summary": summary_table(labels),
    }


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of a run."""
    frames = [t.agg(F.lit(n).alias("stage"), F.count("*").alias("rows")) for n, t in tables.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out
