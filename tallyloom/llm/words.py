"""Text helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs without ASCII blanks.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII lower-case letters, digits and everything beyond ASCII; for texts after ``ascii_lower``.
PLAIN_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def whole(text: Column) -> Column:
    """The text, NULL as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def blank_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BLANK_WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """Equal for equal texts; NULL counts as empty."""
    return F.sha2(whole(text), 256)
