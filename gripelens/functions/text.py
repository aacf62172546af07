"""Text clean-up, tokenising and display expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as personal data in a complaint.  (?U) gives \b and
# \s their Unicode meaning; \x1c-\x1f are blanks too, though not to Java.  VIN
# letters are listed in both cases, with the two signs that fold to s and k.
VIN_PATTERN = r"(?U)\b[A-HJ-NPR-Za-hj-npr-z0-9\u017f\u212a]{17}\b"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = (
    r"(?U)\b[\+]?[(]?[0-9]{3}[)]?[-\s\x1c-\x1f\.]?[0-9]{3}[-\s\x1c-\x1f\.]?[0-9]{4,6}\b"
)
LONG_NUMBER_PATTERN = r"(?U)[\+]?[0-9]{1,3}[-\s\x1c-\x1f\.]?[0-9]{6,14}"
BLANK_PATTERN = r"(?U)[\s\x1c-\x1f]+"
# Cheap tests that a text without a match fails: a VIN is a long run without
# blanks, and both number patterns need three digits in a row.
LONG_RUN = r"\S{17}"
THREE_DIGITS = "[0-9]{3}"
TOKEN_PATTERN = r"(?U)\w{2,}"
WORD_PATTERN = r"(?U)\w+"


def drop_vin(c: Column) -> Column:
    return F.regexp_replace(c, VIN_PATTERN, "")


def drop_email(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL_PATTERN, "")


def drop_phone(c: Column) -> Column:
    return F.regexp_replace(c, PHONE_PATTERN, "")


def drop_long_number(c: Column) -> Column:
    return F.regexp_replace(c, LONG_NUMBER_PATTERN, "")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, BLANK_PATTERN, " ")


def drop_invalid_utf8(c: Column) -> Column:
    """Remove byte sequences that are not UTF-8; valid text is untouched."""
    return F.when(F.is_valid_utf8(c), c).otherwise(
        F.regexp_replace(F.make_valid_utf8(c), "�", "")
    )


def scrub(c: Column) -> Column:
    """The four removals in order.

    Most texts fail the cheap tests and skip the costly patterns.  The tests
    look at the text as it came: no removal can bring two digits together or add
    an at sign, because the patterns before end at a non-digit on the left.
    """
    text = F.when(c.rlike(LONG_RUN), drop_vin(c)).otherwise(c)
    text = F.when(c.contains("@"), drop_email(text)).otherwise(text)
    numbers = drop_long_number(drop_phone(text))
    return F.when(c.rlike(THREE_DIGITS), numbers).otherwise(text)


def clean_text(c: Column) -> Column:
    """VIN, e-mail, phone and long-number scrub, then blank collapse and trim.

    The order matters: a later removal may join the pieces of an earlier
    pattern.  A null becomes the empty string.
    """
    return F.coalesce(F.trim(collapse_blanks(scrub(drop_invalid_utf8(c)))), F.lit(""))


def tokens(c: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case tokens of two or more word characters, repeats kept."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))
    if not stop_words:
        return found
    stop = list(stop_words)
    return F.filter(found, lambda t: ~t.isin(stop))


def with_next_words(words: Column, count: int) -> Column:
    """Array of structs (w1, w2, ...): each word with those that follow it, then null."""
    rest = F.size(words)
    return F.arrays_zip(
        *[F.slice(words, n, rest).alias(f"w{n}") for n in range(1, count + 1)]
    )


def contains_like(c: Column, needle: str) -> Column:
    """SQL ``LIKE '%needle%'`` that ignores the case of ASCII letters only.

    ``%`` and ``_`` in the needle stay wildcards; a backslash is a plain
    character.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = needle.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(c, upper, lower).like(f"%{folded}%")


def display_text(c: Column, length: int = 300) -> Column:
    return F.substring(c, 1, length)


def percent_text(c: Column) -> Column:
    """A share as text with two digits: 0.85 gives ``85.00%``."""
    return F.format_string("%.2f%%", c.cast("double") * 100)


def percent_of(part: Column, whole: Column) -> Column:
    return part.cast("double") * F.lit(100.0) / whole
