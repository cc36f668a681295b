from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import mixing

DOCS = "doc_id long, text string, source string, size int, taken string"


def _targets(sizes):
    """By handing the excess on until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, dict(weight)
    while free:
        level = (total - sum(out.values())) / sum(free.values())
        full = [s for s in free if free[s] * level > 2 * sizes[s]]
        if not full:
            return out | {s: free[s] * level for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            del free[s]
    return out


def _docs(table):
    rows = []
    for n in range(600):
        source = [None, "a", "b", "é", "B", "zz", ""][n % 7] if n % 3 else "hot"
        rows.append((n % 590, " ".join(f"w{n}_{i}" for i in range(n % 90)), source, 1, "x"))
    return table(DOCS, *rows, (None, None, "a", 1, "x"), (1, " ", "nothing", 1, "x"), (2, None, "nothing", 1, "x"), (7, "w " * 30000, "b", 1, "x"))


def test_targets_and_limits(table):
    docs = _docs(table)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    want = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in docs.collect())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == want
    sizes, taken = Counter(), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(_targets(sizes)[r["source"]])
    for source, target in _targets(sizes).items():
        assert abs(taken[source] - target) <= 3 * mixing.BLOCK_WORDS
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_pieces_are_what_the_counts_say(table):
    docs = _docs(table).filter("doc_id < 100 or doc_id is null")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    pieces = mixing.mixed_pieces(docs).collect()
    words = Counter()
    for r in pieces:
        words[r["doc_id"]] += len(r["piece"].split())
    assert words == +taken
    slots = {(r["source_no"], r["slot"]): r["shard"] for r in pieces}
    assert min(slots.values()) >= 0


def test_no_documents_and_no_words(table):
    assert mixing.mix(table(DOCS)).count() == 0
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(table(DOCS, (1, None, None, 0, ""), (1, "", "a", 0, ""))).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    placed = mixing.permuted(np.arange(n), n, -5)
    assert sorted(placed.tolist()) == list(range(n))
    assert n < 64 or (placed != mixing.permuted(np.arange(n), n, -4)).any()
