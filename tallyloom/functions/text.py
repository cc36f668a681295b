"""Text cleaning as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.defaults import DEFINITE_ARTICLE, DELETED_MARKS, FOLDED_INTO, FOLDED_LETTERS, FOLDED_RANGE


def normalize_text(text: Column) -> Column:
    """Comparable form of a text: no markup, lower case, folded Arabic letters, no marks or article.

    NULL becomes the empty string. The article goes after the folding and once only, so a doubled
    article keeps one. A text without letters of the folded range skips both steps, which halves the
    work for other scripts.
    """
    untagged = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    plain = F.lower(F.replace(untagged, F.lit("&nbsp;"), F.lit(" ")))
    folded = F.translate(plain, FOLDED_LETTERS + DELETED_MARKS, FOLDED_INTO)
    bare = F.regexp_replace(folded, rf"(^|\s){DEFINITE_ARTICLE}", "$1")
    known = F.when(F.rlike(plain, F.lit(f"[{FOLDED_RANGE}]")), bare).otherwise(plain)
    return F.trim(F.regexp_replace(known, r"\s+", " "))


def words(normalized: Column) -> Column:
    """Words of two or more letters, in order, of a normalised text."""
    return F.regexp_extract_all(normalized, F.lit("[^ ]{2,}"), F.lit(0))


def none_if_blank(text: Column) -> Column:
    """The text without outer blanks, or NULL when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def match_name(external_ref: Column, full_name: Column) -> Column:
    """The name an employee is matched by: the reference where there is one, else the full name."""
    return F.coalesce(none_if_blank(external_ref), full_name)


def grams(normalized: Column, length: int) -> Column:
    """Distinct substrings of one length, found in a single pass over the text."""
    return F.array_distinct(
        F.regexp_extract_all(normalized, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))
