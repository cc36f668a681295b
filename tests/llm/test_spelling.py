"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from tallyloom.llm import spelling

SCHEMA = "doc_id bigint, text string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:n] + b[n + 1:] == a for n in range(len(b)))


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: sorted((v for v in counts if one_edit(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: near[w][0] if near[w] and counts[near[w][0]] >= 10 * n else None for w, n in counts.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items())


def found(rows, frame):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(frame).collect()), key=lambda r: r[0])


def test_against_all_pairs(spark, table):
    dice = random.Random(5)
    words = ["".join(dice.choice("abcÀé÷z") for _ in range(dice.randint(6, 12))) for _ in range(60)]
    words += [w[:n] + dice.choice(["", "a", "ÿ", "bb"]) + w[n + 1:] for w in words for n in (0, 3, 5)]
    rows = [(n % 40, " ".join(dice.choices(words, k=30)) + "." + dice.choice(words).upper()) for n in range(120)]
    rows += [(None, f"{words[0]} {words[0]}"), (1, None), (2, ""), (3, " ".join([words[1]] * 5000)), (3, " ".join([words[1]] * 5000))]
    result = found(rows, table("doc_id bigint, text string, word string, n int", *[(*r, "x", 1) for r in rows]))
    assert result == expected(rows)
    assert any(r[3] for r in result)


def test_chains_end_at_the_last_form(spark, table):
    # Counts 2, 30 and 400 along one chain of edits; ids are chosen so that no run loses a letter.
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb"]
    rows = []
    for word, times in zip(chain, (2, 30, 400), strict=True):
        ids = [n for n in range(2000) if zlib.crc32(f"{n}:{word}".encode()) % 31][:times]
        rows += [(n, word) for n in ids]
    assert found(rows, table(SCHEMA, *rows)) == expected(rows)
    assert {r[0]: r[5] for r in expected(rows)} == dict.fromkeys(chain, chain[2])


def test_no_words(spark, table):
    assert found([], table(SCHEMA)) == []
    assert found([], table(SCHEMA, (1, "short words only"), (2, None))) == []
