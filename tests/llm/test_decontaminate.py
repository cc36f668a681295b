from __future__ import annotations

import random

import pytest

from tallyloom.llm import decontaminate
from tallyloom.llm.decontaminate import clean_documents, contamination

DOCS = "doc_id long, text string, items int, text_key string, n_hit int"
ITEMS = "item_id long, text string, window int"


def _brute(docs, items):
    import re
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").encode().lower().decode())
    out = []
    for text in docs:
        words, hit, found = split(text), set(), set()
        for item, body in items:
            own = split(body)
            n = min(13, len(own))
            windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((len(words), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def _found(table, docs, items):
    rows = contamination(table(DOCS, *((n, t, 1, "k", 2) for n, t in enumerate(docs))), table(ITEMS, *((*i, 1) for i in items)))
    return [(r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in rows.orderBy("doc_id").collect()]


@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(table, short):
    draw = random.Random(7)
    word = lambda: f"w{draw.randrange(40)}"
    items = [(n, " ".join(word() for _ in range(draw.randrange(13, 40)))) for n in range(12)]
    items += [(3, items[5][1]), (None, items[6][1] + " end"), (50, None), (51, ""), (52, "...")]
    if short:
        items += [(60, "w1 w2"), (61, "w3"), (62, " ".join(f"w{i}" for i in range(12)))]
    docs = [None, "", "w1", "w1 w2 w3"]
    for n in range(60):
        own = items[draw.randrange(12)][1].split()
        at = draw.randrange(len(own))
        docs.append(", ".join([*(word() for _ in range(draw.randrange(60))), *own[at:at + draw.randrange(20)], *(word() for _ in range(draw.randrange(200)))]))
        docs.append(docs[-1].upper() if n % 3 else items[n % 12][1])
    docs += [" ".join([items[0][1]] * 500), ("w1 " * 30000) + items[1][1]]
    assert _found(table, docs, items) == _brute(docs, items)


def test_empty_tables(table):
    text = " ".join(f"w{i}" for i in range(20))
    assert _found(table, [], [(1, text)]) == []
    assert _found(table, [text], []) == [(20, 0, [], False)]


def test_clean_rows_are_unchanged(table):
    item = " ".join(f"w{i}" for i in range(20))
    docs = table(DOCS, (1, item, 1, "k", 2), (2, "fine", 1, "k", 2), (2, "fine", 1, "k", 2), (None, None, None, None, None),
                 (3, item + " x" * 500, 1, "k", 2))
    left = clean_documents(docs, table(ITEMS, (1, item, 0)))
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "2", "3", "None"]


def test_documents_stay_where_few_texts_are_hit(table, monkeypatch):
    item = " ".join(f"q{n}" for n in range(20))
    docs = table("doc_id long, text string", (1, item), (2, "own words " * 30), (3, f"own {item} end"), (4, None), (1, item))
    items = table("item_id string, text string", ("a", item), ("b", "other words only"))
    kept = decontaminate.clean_documents(docs, items)
    assert "strategy=broadcast" in kept._jdf.queryExecution().analyzed().toString()
    rows = [sorted(map(str, f(docs, items).collect())) for f in (decontaminate.clean_documents, decontaminate.contamination)]
    assert len(rows[0]) == 2
    monkeypatch.setattr(decontaminate, "SENT_TEXTS", -1)
    assert rows == [sorted(map(str, f(docs, items).collect())) for f in (decontaminate.clean_documents, decontaminate.contamination)]
