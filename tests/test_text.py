from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.defaults import DEFINITE_ARTICLE, DELETED_MARKS, FOLDED_LETTERS, FOLDED_RANGE
from tallyloom.functions.text import grams, match_name, normalize_text, words

GOLDEN = [
    (None, ""),
    ("<b>الأحمد</b>&nbsp;&NBSP;", "احمد &nbsp;"),
    ("مُحمّد", "محمد"),
    ("انتصر الرد", "انتصر رد"),
    ("ال", ""),
    ("الال", "ال"),
    ("ألفا", "فا"),
    ("أإآٱةىؤئ", "ااااهيوي"),
    ("a\t\n  b", "a b"),
    ("ماليزيا", "ماليزيا"),
    ("x<a\nb>Y", "x y"),
]


def test_golden_texts(spark, table):
    frame = table("no int, text string", *[(n, text) for n, (text, _) in enumerate(GOLDEN)])
    found = frame.select("no", normalize_text(F.col("text")).alias("t")).orderBy("no").collect()
    assert [r.t for r in found] == [expected for _, expected in GOLDEN]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="أإآٱةىؤئًٌٍَُِّْـالابت <>b&;nsp\t\n", max_size=30), min_size=5, max_size=30))
def test_nothing_foldable_remains(spark, table, texts):
    frame = table("text string", *[(t,) for t in texts])
    for row in frame.select(normalize_text(F.col("text")).alias("t")).collect():
        assert not set(row.t) & set(FOLDED_LETTERS + DELETED_MARKS)
        assert row.t == re.sub(r"[ \t\n]+", " ", row.t).strip(" ")


@pytest.mark.parametrize("text, expected", [("a bc  def", ["bc", "def"]), ("", []), ("x", []), ("ab ab", ["ab", "ab"])])
def test_words(table, text, expected):
    assert table("t string", (text,)).select(words(F.col("t"))).first()[0] == expected


def test_grams_are_all_distinct_substrings(table):
    text = "abcabcd é€😀x"
    found = table("t string", (text,)).select(grams(F.col("t"), 3)).first()[0]
    assert len(found) == len(set(found))
    assert {text[i:i + 3] for i in range(len(text) - 2)} <= set(found)


def test_match_name(table, rows):
    frame = table("ref string, name string", ("  ", "A"), (None, "B"), (" R ", "C"))
    assert rows(frame.select(match_name(F.col("ref"), F.col("name")))) == [("A",), ("B",), ("R",)]


def test_every_folded_letter_is_in_the_tested_range():
    first, last = FOLDED_RANGE.split("-")
    assert all(first <= letter <= last for letter in FOLDED_LETTERS + DELETED_MARKS + DEFINITE_ARTICLE)
