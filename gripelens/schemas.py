"""Stage-table schemas and the key rules that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TEXT, _LONG, _REAL = StringType(), LongType(), DoubleType()


def _table(*columns: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns])


RAW_FEEDBACK = _table(
    ("feedback_id", _TEXT),
    ("timestamp", _TEXT),
    ("language", _TEXT),
    ("vehicle_model", _TEXT),
    ("domain", _TEXT),
    ("customer_feedback", _TEXT),
    ("country", _TEXT),
    ("mileage", _LONG),
)
CLEANED_FEEDBACK = RAW_FEEDBACK
STRUCTURED_ENTITIES = _table(
    ("feedback_id", _TEXT),
    ("component", _TEXT),
    ("failure_mode", _TEXT),
    ("symptom", _TEXT),
    ("severity", _TEXT),
    ("driving_condition", _TEXT),
    ("sentiment", _TEXT),
    ("confidence", _REAL),
)
FORMATTED_ENTITIES = StructType(
    STRUCTURED_ENTITIES.fields + [StructField("formatted_text", _TEXT, True)]
)
EMBEDDINGS = _table(
    ("feedback_id", _TEXT),
    ("embedding", ArrayType(FloatType())),
    ("embedding_index", _LONG),
    ("dimension", IntegerType()),
)
CLUSTERED_FEEDBACK = _table(
    ("feedback_id", _TEXT),
    ("cluster_id", IntegerType()),
    ("cluster_confidence", _REAL),
    ("umap_x", _REAL),
    ("umap_y", _REAL),
    ("is_noise", BooleanType()),
)
CLUSTERED_FEEDBACK_REFINED = CLUSTERED_FEEDBACK
CLUSTER_INFO = _table(
    ("cluster_id", IntegerType()),
    ("size", _LONG),
    ("percentage", _REAL),
    ("stability", _REAL),
)
CLUSTER_LABELS = _table(
    ("cluster_id", IntegerType()),
    ("label", _TEXT),
    ("root_component", _TEXT),
    ("recurring_symptom", _TEXT),
    ("failure_frequency", _LONG),
    ("representative_complaint", _TEXT),
    ("confidence", _REAL),
)


@dataclass(frozen=True)
class TableRules:
    """Constraints of one stage table; checked as data, not by storage."""

    schema: StructType
    key: str
    required: tuple[str, ...]
    parent: str | None = None


TABLES: dict[str, TableRules] = {
    "raw_feedback": TableRules(
        RAW_FEEDBACK,
        "feedback_id",
        (
            "feedback_id",
            "timestamp",
            "language",
            "vehicle_model",
            "domain",
            "customer_feedback",
            "country",
        ),
    ),
    "cleaned_feedback": TableRules(
        CLEANED_FEEDBACK,
        "feedback_id",
        ("feedback_id", "customer_feedback", "language", "vehicle_model"),
        "raw_feedback",
    ),
    "structured_entities": TableRules(
        STRUCTURED_ENTITIES, "feedback_id", ("feedback_id",), "cleaned_feedback"
    ),
    "formatted_entities": TableRules(
        FORMATTED_ENTITIES,
        "feedback_id",
        ("feedback_id", "formatted_text"),
        "structured_entities",
    ),
    "embeddings": TableRules(
        EMBEDDINGS,
        "feedback_id",
        ("feedback_id", "embedding_index", "dimension"),
        "formatted_entities",
    ),
    "clustered_feedback": TableRules(
        CLUSTERED_FEEDBACK, "feedback_id", ("feedback_id", "cluster_id"), "embeddings"
    ),
    "clustered_feedback_refined": TableRules(
        CLUSTERED_FEEDBACK_REFINED, "feedback_id", ("feedback_id", "cluster_id"), "embeddings"
    ),
    "cluster_info": TableRules(CLUSTER_INFO, "cluster_id", ("cluster_id",)),
    "cluster_labels": TableRules(CLUSTER_LABELS, "cluster_id", ("cluster_id", "label")),
}
