"""Entity extraction by a term lexicon or by a completion hook."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gripelens.functions.entities import (
    ENTITY_CONFIDENCE,
    ENTITY_FIELDS,
    formatted_text,
    parse_answers,
    valid_entity,
)
from gripelens.functions.labels import extraction_prompt
from gripelens.functions.text import WORD_PATTERN, with_next_words
from gripelens.operators.hooks import complete

LEXICON_DDL = "term string, language string, field string, value string, priority int"
GRADES = {
    "severity": {
        "critical": ("dangerous", "unsafe", "accident", "smoke", "brake failure"),
        "high": ("stranded", "urgent", "broke down", "warning light"),
        "low": ("minor", "slight", "cosmetic"),
    },
    "sentiment": {
        "positive": ("satisfied", "happy with", "works well", "excellent"),
        "neutral": ("question about", "enquiry"),
        "negative": ("disappointed", "frustrating", "unacceptable"),
    },
}


def default_lexicon(
    spark: SparkSession,
    failures: Sequence[str] = (),
    conditions: Mapping[str, Mapping[str, str]] = MappingProxyType({}),
) -> DataFrame:
    """English severity and sentiment terms, and the caller's failures and conditions.

    The last word of a failure phrase is the failure mode, the words before it
    the component, the phrase itself the symptom; it holds in any language.
    ``conditions`` gives for each language its terms and the value they stand for.
    """
    rows = [
        (term, "en", field, value, 10)
        for field, values in GRADES.items()
        for value, terms in values.items()
        for term in terms
    ]
    for phrase in failures:
        component, _, mode = phrase.rpartition(" ")
        term = phrase.lower()
        rows += [
            (term, None, "component", component, 10),
            (term, None, "failure_mode", mode, 10),
            (term, None, "symptom", phrase, 10),
        ]
    for language, terms in conditions.items():
        for term, value in terms.items():
            rows.append((term.lower(), language, "driving_condition", value, 10))
    return spark.createDataFrame(rows, LEXICON_DDL)


def lexicon_matches(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "customer_feedback",
    key: str = "feedback_id",
    max_words: int | None = None,
) -> DataFrame:
    """Every occurrence of a lexicon term: (key, field, value, priority, position).

    Terms are cut into words like the text, so case and punctuation do not matter.
    Words whose text starts no lexicon term are dropped first; the others are
    joined on the runs of 1 to ``max_words`` words they start, by default as many
    as the longest term has.  The lexicon
    carries no hint: Spark broadcasts it when its size allows and shuffles
    otherwise.  Null language means any language.
    """

    def words_of(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))

    if max_words is None:
        longest = lexicon.agg(F.max(F.size(words_of(F.col("term")))).alias("n")).first()["n"]
        max_words = max(longest or 1, 1)
    lexicon = lexicon.withColumn("term", F.array_join(words_of(F.col("term")), " ")).filter("term <> ''")
    words = words_of(F.col(text))
    at_word = (
        df.select(key, F.col("language").alias("_language"), words.alias("_words"))
        .select(
            key, "_language", F.posexplode(with_next_words(F.col("_words"), max_words)).alias("position", "_w")
        )
        .select(key, "_language", "position", "_w.*")
    )
    starts = lexicon.select(F.split_part("term", F.lit(" "), F.lit(1)).alias("w1")).distinct()
    at_word = at_word.join(starts, "w1", "left_semi")
    grams = [F.col("w1")] + [
        F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *[f"w{i}" for i in range(1, n + 1)]))
        for n in range(2, max_words + 1)
    ]
    terms = at_word.select(key, "_language", "position", F.explode(F.array(*grams)).alias("term"))
    lex = lexicon.withColumnRenamed("language", "_term_language")
    return (
        terms.join(lex, "term")
        .filter(F.col("_term_language").isNull() | (F.col("_term_language") == F.col("_language")))
        .select(key, "field", "value", "priority", "position")
    )


def extract_with_lexicon(
    df: DataFrame,
    lexicon: DataFrame | None = None,
    text: str = "customer_feedback",
    key: str = "feedback_id",
    max_words: int | None = None,
) -> DataFrame:
    """Best match per field by priority, then position, then value.

    The result has ``entity`` (struct) per row; its fields are null where no term
    was found.
    """
    lexicon = default_lexicon(df.sparkSession) if lexicon is None else lexicon
    matches = lexicon_matches(df, lexicon, text, key, max_words)
    best = F.struct((-F.col("priority")).alias("p"), F.col("position"), F.col("value"))
    fields = [
        F.min(F.when(F.col("field") == f, best)).getField("value").alias(f) for f in ENTITY_FIELDS
    ]
    found = matches.groupBy(key).agg(*fields)
    return df.select(key).join(found, key, "left").select(key, F.struct(*ENTITY_FIELDS).alias("entity"))


def entity_rows(
    df: DataFrame, key: str = "feedback_id", confidence: float = ENTITY_CONFIDENCE
) -> DataFrame:
    """Flatten validated entities; rows without a result are left out."""
    return (
        df.filter(F.col("entity").isNotNull())
        .select(key, valid_entity(F.col("entity")).alias("_e"))
        .select(key, "_e.*", F.lit(float(confidence)).alias("confidence"))
    )


def all_entity_rows(
    parsed: DataFrame, key: str = "feedback_id", confidence: float = ENTITY_CONFIDENCE
) -> DataFrame:
    """``entity_rows`` of parsed answers with their ``parse_status``, no row left out.

    A row without a result has the default entity, with confidence 0.
    """
    found = F.col("entity").isNotNull()
    nothing = F.struct(*[F.lit(None).cast("string").alias(f) for f in ENTITY_FIELDS])
    return parsed.select(
        key, "parse_status", found.alias("_found"), valid_entity(F.coalesce("entity", nothing)).alias("_e")
    ).select(
        key, "_e.*", F.when(F.col("_found"), float(confidence)).otherwise(0.0).alias("confidence"), "parse_status"
    )


def extract_entities(
    df: DataFrame,
    lexicon: DataFrame | None = None,
    text: str = "customer_feedback",
    key: str = "feedback_id",
    call: Callable[[str], str] | None = None,
    every_row: bool = False,
) -> DataFrame:
    """Structured entities of each feedback row.

    With ``call`` the rows are put to a completion hook and its answers parsed;
    otherwise the lexicon decides.  The lexicon gives every row an entity; rows whose
    calls fail or whose answer holds no entity are left out, unless ``every_row``
    keeps them all, as ``all_entity_rows`` does.
    """
    if call is None:
        return entity_rows(extract_with_lexicon(df, lexicon, text, key), key)
    prompts = df.select(key, extraction_prompt(F.col(text), F.col("language")).alias("_prompt"))
    answers = complete(prompts, "_prompt", call).drop("_prompt")
    rows = all_entity_rows if every_row else entity_rows
    return rows(parse_answers(answers, "content"), key)


def extraction_statistics(parsed: DataFrame) -> DataFrame:
    """One row: answers parsed at once, answers malformed, answers failed."""
    status = F.col("parse_status")
    return parsed.agg(
        F.count_if(status == "success").alias("successful"),
        F.count_if(status == "malformed").alias("malformed"),
        F.count_if(status == "failed").alias("failed"),
    )


def format_entities(entities: DataFrame) -> DataFrame:
    """Add the line of text that represents an entity row in vector space."""
    return entities.withColumn("formatted_text", formatted_text(entities.columns))
