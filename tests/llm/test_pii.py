from __future__ import annotations

import random
import re

import numpy as np

from tallyloom.llm import pii

DOCS = "doc_id long, text string, spans int, key string"


def _brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        checked = sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
        if 14 <= len(digits) <= 19 and checked % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_against_brute_force():
    draw = random.Random(4)
    signs = ["a", "b.c", "@", ".", "1", "25", "255", "0256", "4111 1111 1111 1111", "4111111111111111", "+1 (415) 555-2671", "-", " ", "+", "é😀", "x@y.com", "\n"]
    for _ in range(4000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(12)))
        assert pii.base_spans(text) == _brute(text)


def test_long_texts_are_linear():
    for text in ("a" * 200000, "a@" * 100000, "1" * 200000, "1." * 100000, "+1" * 100000):
        pii.base_spans(text)


def test_rows(table):
    texts = ["mail a.b@c.org now", None, "", "4111 1111 1111 1111", "nothing here", "mail a.b@c.org now"]
    rows = table(DOCS, *((n, t, 1, "k") for n, t in enumerate(texts)), (0, texts[0], 1, "k"))
    got = pii.find_personal_data(rows).orderBy("doc_id").collect()
    assert got[0] == got[1] and got[0]["key"] == "k"
    assert [[(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["added"]] for r in got[1:]] == [
        [("email", 5, 14)], [], [], [("card", 0, 19)], [], [("email", 5, 14)]]
    assert pii.find_personal_data(rows.limit(0)).count() == 0


def _field():
    field = pii.fit([])
    field.weights[0] = [2.0, 0, 0, 0, 0]  # none is likelier a priori
    field.skip[:] = np.where(np.eye(pii.LABELS, dtype=bool), 4.0, -4.0)
    return field


def test_repeats_take_the_label_over_any_distance():
    text = "call +1 (415) 555-2671 " + "word " * 3000 + "or 415-555-2671, or 14155552671 and 20240229"
    graph = pii.graph_of(text, pii.base_spans(text))
    found = [(text[b:e], pii.KINDS[k]) for b, k, e in pii.added_spans(graph, _field(), 0.8)]
    assert ("20240229", "phone") not in found
    assert graph.skip.size


def test_differently_written_repeats_get_the_label():
    far = " word" * 3000 + " "
    phones = ["415-555-2671", "14155552671", "555-2671", "(415) 555 2671", "415 - 555 - 2671", "0415 555 2671", "1.415.555.2671"]
    cards = ["4111  1111  1111  1111", "(4111) 1111-1111 (1111", "4111.1111.1111.1111"]
    others = ["415-555-9999", "20240229", "12 8800 41", "192.168.100.200"]
    text = "call +1 (415) 555-2671, pay 4111 1111 1111 1111;" + "".join(f"{far}see {x}, ok" for x in phones + cards + others)
    taught = pii.fit([pii.graph_of(text, pii.base_spans(text))] * 3)
    for field in (_field(), taught):
        found = [(text[b:e], pii.KINDS[k]) for b, k, e in pii.added_spans(pii.graph_of(text, pii.base_spans(text)), field, 0.8)]
        assert found == [(x, "phone") for x in ("415-555-2671", "14155552671", "555-2671", "415) 555 2671", "415 - 555 - 2671", "0415 555 2671", "1.415.555.2671")] + [
            (x, "card") for x in ("4111  1111  1111  1111", "4111) 1111-1111 (1111", "4111.1111.1111.1111")]


def test_adjacent_values_and_many_repeats():
    text = "+1 (415) 555-2671, 4111 1111 1111 1111, and 415 555 2671 (415) 555-2671 4111  1111  1111  1111 7" + " x 555-2671 y" * 3000
    graph = pii.graph_of(text, pii.base_spans(text))
    assert len(graph.skip) <= len(graph.places)  # linear in occurrences
    found = [(text[b:e], pii.KINDS[k]) for b, k, e in pii.added_spans(graph, _field(), 0.8)]
    assert found[:3] == [("415 555 2671", "phone"), ("415) 555-2671", "phone"), ("4111  1111  1111  1111", "card")]
    assert found[3:] == [("555-2671", "phone")] * 3000


def test_messages_agree_with_enumeration():
    text = "a1@x.org 5551234567 word word 5551234567 a1 5551234567"
    graph, field = pii.graph_of(text, pii.base_spans(text)), _field()
    field.weights[1] = [0, 0.5, -0.3, 0.2, 1.0]
    got = pii.beliefs(graph, field, passes=200)
    n = len(graph.places)
    total = np.zeros((n, pii.LABELS))
    node = graph.features @ field.weights
    for labels in np.ndindex(*([pii.LABELS] * n)):
        if all(k < 0 or k == v for k, v in zip(graph.known, labels, strict=True)):
            score = sum(node[i, v] for i, v in enumerate(labels) if graph.known[i] < 0)
            score += sum(field.chain[labels[a], labels[b]] for a, b in graph.chain) + sum(field.skip[labels[a], labels[b]] for a, b in graph.skip)
            for i, v in enumerate(labels):
                total[i, v] += np.exp(score)
    want = total / total.sum(1, keepdims=True)
    assert (got.argmax(1) == want.argmax(1)).all() and np.abs(got - want).max() < 0.15


def test_held_out_tokens():
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    graphs = [g for g in (pii.graph_of(t, pii.base_spans(t)) for t in texts) if g is not None]
    field = pii.fit(graphs[::2])
    right = [(np.argmax(g.features @ field.weights, 1) == np.maximum(g.known, 0)) for g in graphs[1::2]]
    assert np.concatenate(right).mean() > 0.85
