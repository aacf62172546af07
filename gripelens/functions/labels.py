"""Expressions around cluster labels: buckets, snippets, prompts, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_LABEL = "Unknown Failure"
LABEL_CONFIDENCE = 0.85


def severity_bucket(frequency: Column) -> Column:
    # Bucket limits, all exclusive.
    return (
        F.when(frequency > 50, "Critical")
        .when(frequency > 20, "High")
        .when(frequency > 10, "Medium")
        .otherwise("Low")
    )


def snippet_list(texts: Column, count: int = 3, length: int = 100) -> Column:
    """The first texts of an array as a bullet list, each cut to ``length``."""
    lines = F.transform(
        F.slice(texts, 1, count), lambda t: F.concat(F.lit("- "), F.substring(t, 1, length))
    )
    return F.array_join(lines, "\n")


def fallback_label(keywords: Column) -> Column:
    """The two best keywords, or a fixed text when there are none."""
    return F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 2), " ")).otherwise(
        UNKNOWN_LABEL
    )


def extraction_prompt(text: Column, language: Column) -> Column:
    """Prompt asking a completion hook for the six entity fields as JSON."""
    ask = (
        "Read one customer complaint and answer with a single JSON object and nothing else. "
        "Its string keys are component, failure_mode, symptom, "
        "severity (critical, high, medium or low), driving_condition and "
        "sentiment (negative, neutral or positive).\nLanguage: "
    )
    return F.concat(F.lit(ask), F.coalesce(language, F.lit("en")), F.lit("\nComplaint: "), text)


def label_prompt(keywords: Column, texts: Column) -> Column:
    """Prompt asking a completion hook to name one group of complaints."""
    ask = (
        "Name the shared fault behind these complaints. Answer with a single JSON object whose "
        "string keys are label (50 characters at most), root_component, recurring_symptom and "
        "failure_pattern.\nKeywords: "
    )
    return F.concat(
        F.lit(ask), F.array_join(keywords, ", "), F.lit("\nComplaints:\n"), snippet_list(texts)
    )
