"""Parsing, repairing, validating and formatting of entity answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entity fields and the two closed vocabularies.
ENTITY_FIELDS = (
    "component",
    "failure_mode",
    "symptom",
    "severity",
    "driving_condition",
    "sentiment",
)
SEVERITIES = ("critical", "high", "medium", "low")
SENTIMENTS = ("negative", "neutral", "positive")
ENTITY_CONFIDENCE = 0.95

_CORRUPT = "_corrupt_record"
ENTITY_DDL = ", ".join(f"{f} string" for f in ENTITY_FIELDS)
LABEL_FIELDS = ("label", "root_component", "recurring_symptom", "failure_pattern")
LABEL_DDL = ", ".join(f"{f} string" for f in LABEL_FIELDS)


def _parse(c: Column, ddl: str) -> Column:
    return F.from_json(
        c,
        f"{ddl}, {_CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"},
    )


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def json_object_in(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, code fences dropped."""
    bare = F.regexp_replace(c, "```json|```", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def one_json_value(c: Column) -> Column:
    """Whether the text is exactly one JSON value.

    The parser stops after the first value; inside brackets it has to read to the end.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    first, second = (F.try_variant_get(listed, f"$[{i}]", "variant") for i in range(2))
    return listed.isNotNull() & first.isNotNull() & second.isNull()


def parse_answers(df: DataFrame, content: str, ddl: str = ENTITY_DDL) -> DataFrame:
    """Add ``entity`` (struct or null) and ``parse_status`` to answer rows.

    ``success``: the answer is one JSON object.  ``malformed``: it is not, and
    ``entity`` holds what the repair found, if anything.  ``failed``: no answer,
    or valid JSON that is not an object, which is not repaired.
    """
    fields = [part.split()[0] for part in ddl.split(", ")]
    staged = (
        df.withColumn("_text", strip_blanks(F.col(content)))
        .withColumn("_direct", _parse(F.col("_text"), ddl))
        .withColumn("_repaired", _parse(json_object_in(F.col("_text")), ddl))
    )
    text = F.col("_text")
    valid = one_json_value(text)
    status = (
        F.when(text.isNull() | (valid & ~text.startswith("{")), "failed")
        .when(valid & F.col(f"_direct.{_CORRUPT}").isNull(), "success")
        .otherwise("malformed")
    )

    def picked(name: str) -> Column:
        return F.struct(*[F.col(f"{name}.{f}").alias(f) for f in fields])

    repaired_ok = (
        F.col("_repaired").isNotNull()
        & F.col(f"_repaired.{_CORRUPT}").isNull()
        & one_json_value(json_object_in(text))
    )
    entity = F.when(F.col("parse_status") == "success", picked("_direct")).when(
        (F.col("parse_status") == "malformed") & repaired_ok, picked("_repaired")
    )
    return (
        staged.withColumn("parse_status", status)
        .withColumn("entity", entity)
        .drop("_text", "_direct", "_repaired")
    )


def valid_entity(entity: Column) -> Column:
    """Fill missing fields and default the closed vocabularies.

    A valid severity or sentiment keeps the case it came in; values keep their length.
    """

    def field(name: str) -> Column:
        value = entity.getField(name)
        if name == "severity":
            value = F.when(F.lower(value).isin(*SEVERITIES), value).otherwise("medium")
        elif name == "sentiment":
            value = F.when(F.lower(value).isin(*SENTIMENTS), value).otherwise("negative")
        return F.coalesce(value, F.lit(""))

    checked = F.struct(*[field(f).alias(f) for f in ENTITY_FIELDS])
    return F.when(entity.isNotNull(), checked)


def formatted_text(columns: list[str]) -> Column:
    """One line of text per entity row; a missing column or null prints empty."""
    # The caption of each part, in order.
    captions = {
        "component": "Component",
        "failure_mode": "Failure",
        "symptom": "Symptom",
        "severity": "Severity",
        "driving_condition": "Condition",
    }
    parts = []
    for name, caption in captions.items():
        value = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")
        parts.append(F.concat(F.lit(f"{caption}: "), value))
    return F.concat_ws(" | ", *parts)
