from __future__ import annotations

import random

import numpy as np
import pytest

from tallyloom.llm import ngram_join as join

DOCS = "doc_id long, text string, hi string, label int"


def _brute(texts, length, percent):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + length]) for i in range(max(1, len(words) - length + 1))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def _edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def _found(table, texts, **options):
    rows = table(DOCS, *((n, t, "x", 1) for n, t in enumerate(texts)))
    return [(r["n_shingles"], r["component_id"]) for r in join.near_duplicates(rows, **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize(("length", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(table, length, percent):
    draw = random.Random(length)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for size in (1, 2, 3, 4, 5, 6, 9, 14, 30, 80, 200, 700):
        base = [f"w{draw.randrange(10**6)}" for _ in range(size)]
        texts += [_edited(draw, base, n) for n in (0, 0, 1, 1, 2, 3, 5, 8)]
        texts.append(" ".join(base).upper().replace(" ", "\n"))
        texts += [" ".join([*base, *passage]), " ".join([*passage, *base[:size * 9 // 10]])]
    texts += [None, "", " \t", "A", "a", "b a", *(f"{' '.join(passage)} tail{i} of{i} own{i}" for i in range(20))]
    assert _found(table, texts, length=length, percent=percent) == _brute(texts, length, percent)


def test_chain_and_long_texts(table):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[n:n + 40]) for n in range(12)]
    long = " ".join(f"x{i % 30011}" for i in range(60000))
    texts = [*chain, long, long + " more words at the end", "z " * 50000, "z z z z z"]
    assert _found(table, texts, length=4, percent=85) == _brute(texts, 4, 85)


def test_signatures_meet_whenever_sets_are_alike():
    draw = np.random.default_rng(3)
    bands = join.Bands(85)
    for _ in range(300):
        size = int(draw.integers(1, 400))
        base = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
        drop = int(draw.integers(0, max(1, size // 12) + 1))
        other = np.unique(np.concatenate([base[drop:], draw.integers(0, 2**63, int(draw.integers(0, max(1, size // 12) + 1))).astype(np.uint64)]))
        shared = np.intersect1d(base, other).size
        if not other.size or 100 * shared < 85 * (base.size + other.size - shared):
            continue
        common = np.sort(join._classes(base[::2]))
        made = []
        for items in (base, other):
            made.append({int(s) for g, d in join._groups(bands, items.size) for s in join.signatures(items, g, d, common)})
        assert made[0] & made[1]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, join.BLOCK_BYTES])
def test_word_hashes_in_blocks(block):
    draw = random.Random(block)
    blanks = [b" ", b"\t", b"\n\r", b"\x0b\x0c ", b" " * 9]
    for _ in range(60):
        words = [bytes(draw.choice(b"ab\x00\xc3\xff\x1f\x85") for _ in range(draw.choice((1, 1, 2, 3, 20, 70)))) for _ in range(draw.randrange(40))]
        data = b"".join(w + draw.choice(blanks) for w in words) + draw.choice((b"", b"end"))
        data = draw.choice((b"", b" ")) + data
        split = data.split()
        found = join.word_hashes(data, block).tolist()
        assert len(found) == len(split)
        assert found == [join.word_hashes(w).tolist()[0] for w in split]
        assert len(set(found)) == len(set(split))


def test_texts_joined_by_shuffle_when_keys_are_many(table, monkeypatch):
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(40)]
    texts = [_edited(draw, base, n % 3) for n in range(20)] + [None, "", "own words alone"]
    rows = table(DOCS, *((n // 2 * 2, t, "x", 1) for n, t in enumerate([t for t in texts for _ in range(2)])))
    few = [_found(table, texts), sorted(map(str, join.one_of_each(rows).collect()))]
    monkeypatch.setattr(join, "SENT_KEYS", 0)
    monkeypatch.setattr(join, "SENT_ROWS", -1)
    assert few == [_found(table, texts), sorted(map(str, join.one_of_each(rows).collect()))]
    brute = _brute(texts, join.SHINGLE_WORDS, join.PERCENT)
    assert few[0] == brute
    kept = {find for size, find in brute if size}
    assert len(few[1]) == len(kept) + 4


def test_few_winners_are_sent_to_the_documents(table):
    rows = table(DOCS, *((n, "one two three four five six seven" + " x" * (n // 9), "x", 1) for n in range(12)), (3, "one two three four five six seven", "x", 1))
    left = join.one_of_each(rows)
    plan = left._jdf.queryExecution().analyzed().toString()
    assert plan.count("ResolvedHint (strategy=broadcast)") == 5  # keys of touched rows: 3, winners: 2
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 9]


def test_nulls_ties_and_empty_table(table):
    text = "one two three four five six seven"
    rows = table(DOCS, (5, text, None, 1), (5, text, None, 1), (None, text, "a", None), (3, text + " eight", "b", 2), (None, None, None, None), (9, "", "c", 3))
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in join.near_duplicates(rows, length=4, percent=80).collect())))
    assert got == sorted(map(str, [(5, 3), (5, 3), (None, 3), (3, 3), (None, None), (9, 9)]))
    left = join.one_of_each(rows, length=4, percent=80)
    assert left.columns == rows.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "9", "None"]
    twice = rows.filter("doc_id = 5")
    assert [tuple(r) for r in join.one_of_each(twice).collect()] == [(5, text, None, 1)]
    assert join.near_duplicates(rows.limit(0)).count() == 0 and join.one_of_each(rows.limit(0)).count() == 0


def test_large_group_of_near_copies(table):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [_edited(draw, base, draw.randrange(4)) for _ in range(400)]
    assert _found(table, texts, length=4, percent=85) == _brute(texts, 4, 85)


def test_signatures_of_one_leader_are_compared_once(table):
    node = lambda n: (n, -n)
    near = [(sig, 1, node(n), node(n % 5)) for sig in range(40) for n in range(10) if (sig + n) % 4]
    loose = [(100 + n // 2, 2, node(n), node(n)) for n in range(60)]
    # A signature of the same number as a leader is a group of its own.
    loose += [(1, 3, node(n), node(n)) for n in (1, 70)] + [(sig, 3, node(sig), node(sig)) for sig in range(200, 230)]
    rows = table("sig long, a_hi long, node struct<hi long, lo long>, label struct<hi long, lo long>", *near, *loose)
    groups = {}
    for r in join._groups_of_leaders(rows, 3).collect():
        groups.setdefault((r["key"], r["merged"]), []).append(tuple(r["node"]))
    assert sorted(groups[1, True]) == [node(n) for n in range(10)]
    pairs = [(a, b) for g in groups.values() for a in g for b in g if a < b]
    own = {}
    for sig, leader, n, _ in [*near, *loose]:
        own.setdefault((sig, leader), []).append(n)
    assert {(a, b) for g in own.values() for a in g for b in g if a < b} <= set(pairs)
    assert len(pairs) == 45 + 30 + 1
    assert max(len(g) for key, g in groups.items() if not key[1]) == 2
