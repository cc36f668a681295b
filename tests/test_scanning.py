"""The two ways of scanning, and matching, against plain Python on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.matching import assign_employees, employee_names, match_employees
from tallyloom.operators.scanning import count_phrases, find_phrases
from tallyloom.plans.quality import scan_messages

WAYS = {"join": {}, "in_place": {"in_place": True}}
KEYWORDS = "id bigint, phrase string, label string, is_active boolean"
PEOPLE = "id bigint, full_name string, external_ref string, is_active boolean"
CUSTOMERS = "id bigint, channel_id string, name string"
MESSAGES = "message_id bigint, customer_id bigint, employee_id bigint, body string, sent_at timestamp"


@pytest.mark.parametrize("way", WAYS)
def test_hits_equal_brute_force(table, rows, way):
    rng = random.Random(7)
    alphabet = "ab  c%_é"
    texts = [(n, "".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 40, 200])))) for n in range(120)]
    # A third of the texts and many rules share one passage.
    texts += [(200 + n, f"x{n} hello world passage {'c' * (n % 9)}") for n in range(60)]
    texts += [(400 + n, f"say number {n} of it all") for n in range(30)]
    phrases = ["hello world passage " + "c" * n for n in range(8)] + ["a", "b c", "ab", "%", "_", "é%", "abcab", " ", "zzz",
                                                                      "a b c", "b ab c", "a abc b", "c %_% a", "x world x"]
    phrases += [f"say number {n} of it" for n in range(12)]
    rules = [(n, p, f"l{n % 3}", n % 5 != 4) for n, p in enumerate(phrases)]

    def clean(text):
        return " ".join(text.split())

    expected = sorted((str(t), str(r)) for t, body in texts for r, p, _, active in rules
                      if active and clean(p) and clean(p) in clean(body))
    keywords = table(KEYWORDS, *rules)
    frame = table("id bigint, body string", *texts)
    found = find_phrases(frame, "id", "body", keywords, **WAYS[way])
    assert sorted((str(r.id), str(r.keyword_id)) for r in found.collect()) == expected
    counts = {r.id: r.n_notes for r in count_phrases(frame, "id", "body", keywords, **WAYS[way]).collect()}
    assert counts == {t: sum(e[0] == str(t) for e in expected) for t, _ in texts}


@pytest.mark.parametrize("way", WAYS)
def test_notes(table, rows, way):
    messages = table(MESSAGES, (1, 7, None, "Please <b>SEND</b> your  account, 50% off", None), (2, 8, 3, None, None),
                     (3, 9, None, "send your account", None))
    customers = table(CUSTOMERS, (7, "ch7", "Nora"), (8, "ch8", None), (9, "ch9", None))
    keywords = table(KEYWORDS, (1, "send your ACCOUNT", "transfer", True), (2, "0% o", "offer", True),
                     (3, "send", "off", False), (4, "<i></i>", "empty", True), (5, "acc_unt", "wild", True))
    found = scan_messages(messages, customers, keywords, **WAYS[way])
    assert rows(found, "message_id", "customer_name", "keyword_id", "matched_phrase", "label") == [
        (1, "Nora", 1, "send your ACCOUNT", "transfer"), (1, "Nora", 2, "0% o", "offer"),
        (3, "ch9", 1, "send your ACCOUNT", "transfer")]


@pytest.mark.parametrize("way", WAYS)
def test_no_rules_no_hits(table, way):
    frame = table("id bigint, body string", (1, "abc"))
    assert find_phrases(frame, "id", "body", table(KEYWORDS), **WAYS[way]).count() == 0


def test_matches_equal_brute_force(table):
    rng = random.Random(3)
    vocabulary = ["mo", "ali", "sam", "nur", "x", "zed", "kim"]
    texts = [(n, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 6])))) for n in range(150)]
    people = [(n, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3]))), None, n % 4 != 3) for n in range(40)]
    people += [(100 + n, f"mo last{n}", None, True) for n in range(40)] + [(900, "mo last3", None, True)]
    texts += [(500 + n, f"mo went to last{n}") for n in range(50)]

    def tokens(text):
        return [w for w in text.split() if len(w) >= 2]

    expected = {}
    for t, text in texts:
        ids = [i for i, name, _, active in people if active and tokens(name)
               and {tokens(name)[0], tokens(name)[-1]} <= set(tokens(text))]
        if ids:
            expected[t] = min(ids)
    found = match_employees(table("id bigint, body string", *texts), "id", "body",
                            employee_names(table(PEOPLE, *people)))
    assert {r.id: r.employee_id for r in found.collect()} == expected


def test_reference_name_comes_first_and_inactive_people_never_match(table):
    people = table(PEOPLE, (5, "Sara Omar", "  ", True), (2, "Other Name", " Huda Ali ", True), (1, "Sara Omar", None, False),
                   (9, None, None, True))
    texts = table("id bigint, body string", (1, "by <b>Sara</b> K. Omar"), (2, "other name"), (3, "ali and HUDA"),
                  (4, "Saraomar"), (5, None))
    found = {r.id: r.employee_id for r in match_employees(texts, "id", "body", employee_names(people)).collect()}
    assert found == {1: 5, 3: 2}


def test_assignment_fills_only_open_messages(table, rows):
    people = table(PEOPLE, (5, "Sara Omar", None, True))
    messages = table("id bigint, employee_id bigint, body string", (1, None, "sara omar"), (2, 8, "sara omar"), (3, None, "x"))
    assert rows(assign_employees(messages, "id", "body", employee_names(people)).select("id", "employee_id")) == [
        (1, 5), (2, 8), (3, None)]


def test_frequent_words_are_avoided_as_anchors(spark, table, rows):
    from tallyloom.functions.text import normalize_text
    from tallyloom.operators import scanning

    common = "international organisation of the everything"
    texts = table("id bigint, body string", *[(n, f"word{n} {common} {'zip code' if n % 50 == 0 else 'x'} end{n}") for n in range(300)])
    rules = table("id bigint, phrase string, label string, is_active boolean",
                  (1, "the everything zip code", "a", True), (2, "national organisation of the", "b", True), (3, "of the everything x end7", "c", True),
                  (4, "everything", "d", True), (5, "nowhere at all to be found", "e", True))
    frequent = scanning.frequent_words(texts, "body", words=20)
    counted = {r.anchor.strip(): r.n_texts for r in frequent.collect()}
    assert counted["international"] == counted["everything"] == 300
    norm = texts.select("id", normalize_text(F.col("body")).alias("norm_text"))
    active = scanning.active_rules(rules)
    drawn = lambda known: {r.keyword_id: r["count"] for r in
                           scanning._candidates(norm, "id", scanning._anchored(active, known)).groupBy("keyword_id").count().collect()}
    before, after = drawn(None), drawn(frequent)
    assert before[1] == 300 and after[1] == 6  # by "zip", not by "everything"
    assert before[3] == 300 and after[3] <= 300 and after.get(5, 0) == 0
    assert rows(find_phrases(texts, "id", "body", rules, frequent=frequent)) == rows(find_phrases(texts, "id", "body", rules))
    assert rows(find_phrases(texts, "id", "body", rules, frequent=frequent.limit(0))) == rows(find_phrases(texts, "id", "body", rules))
