"""Keyset pages equal slices of the whole list and open few files."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.sources.notepages import NotePages

NOTES = "id bigint, message_at timestamp, label string"


@pytest.fixture
def stored(spark, table, tmp_path):
    dice = random.Random(9)
    rows = [(n, dice.choice([None, *(datetime(2024, 1, 1) + timedelta(hours=h) for h in range(30))]), f"l{n % 3}") for n in range(400)]
    pages = NotePages(spark, str(tmp_path / "pages"))
    pages.write(table(NOTES, *rows), 10)
    in_order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime(2024, 1, 1)).timestamp(), r[0]))
    return pages, [r[0] for r in in_order]


@pytest.mark.parametrize("size", [37, 400, 1000])
def test_pages_are_slices_of_the_list(stored, size):
    pages, ids = stored
    seen, token = [], None
    while True:
        page = pages.page(size, token)
        found = [r.id for r in page.collect()]
        token = pages.next_token(page)
        if not found:
            break
        seen += found
        assert len(found) == size or len(seen) == len(ids)
    assert seen == ids and token is None


def test_a_page_opens_only_files_that_can_hold_it(stored):
    pages, ids = stored
    token = None
    for _ in range(5):
        page = pages.page(30, token)
        files = set(page.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
        assert len(pages._files(30, token)) <= 2 and len(files) <= 2
        token = pages.next_token(page)


def test_no_notes(spark, table, tmp_path):
    pages = NotePages(spark, str(tmp_path / "none"))
    pages.write(table(NOTES), 4)
    assert pages.page(5).collect() == [] and pages.next_token(pages.page(5)) is None
    assert pages.page(5, (0, 0)).collect() == []
