"""Substring dedup and its suffix arrays against brute force."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import substring_dedup, suffixes

SCHEMA = "doc_id bigint, text string"


def expected(rows, length=substring_dedup.LENGTH):
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(d[n:n + length] for _, d in data for n in range(len(d) - length + 1))
    out = []
    for doc_id, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for n in range(len(d) - length + 1):
            if seen[d[n:n + length]] > 1:
                gone[n:n + length] = True
        spans = int(np.sum(gone[:-1] & ~np.append(False, gone[:-2])))
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((doc_id, len(d), len(d) - len(kept), spans, kept))
    return sorted(out, key=str)


def some_texts():
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abcdeé") for _ in range(dice.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long_text = prose(150), prose(1500)
    rows = [(n, f"{prose(dice.randint(0, 60))} {passage} {prose(dice.randint(0, 60))}") for n in range(30)]
    rows += [(100 + n, long_text[:n * 37] + "Z" + long_text[n * 37:]) for n in range(8)]
    rows += [(200, prose(400)), (200, prose(400)), (201, None), (202, ""), (203, "x" * 3000), (204, "ab" * 260), (205, passage[:399]), (205, passage[:400])]
    rows += [(300, long_text), (301, long_text), (301, long_text), (None, passage), (302, "\0" * 450), (303, "x" * 399)]
    return rows


@pytest.mark.parametrize(("shard_bytes", "block_starts"), [(4 << 20, 1 << 20), (4000, 1 << 20), (4 << 20, 500)])
def test_against_brute_force(spark, table, monkeypatch, shard_bytes, block_starts):
    """With small shards every common hash is split; with small blocks long texts are hashed in parts."""
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard_bytes)
    rows = some_texts()
    keyed = table(SCHEMA, *rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", substring_dedup.text_key())
    if block_starts < 1000:
        data = [(text or "").encode() for _, text in rows]
        whole = [list(zip(*map(list, part))) for d in data for part in substring_dedup.fragments(d)]
        monkeypatch.setattr(substring_dedup, "BLOCK_STARTS", block_starts)
        parts = [list(zip(*map(list, part))) for d in data for part in substring_dedup.fragments(d)]
        assert sum(p[2] for f in whole for p in f) == sum(p[2] for f in parts for p in f) == sum(max(0, len(d) - 399) for d in data)
    assert keyed.count() == len(rows)
    frame = table("doc_id bigint, text string, key string, spans int", *[(*r, "k", 1) for r in rows])
    found = sorted((tuple(r) for r in substring_dedup.deduplicated(frame).collect()), key=lambda r: str((r[0], *r[1:4], bytes(r[4]))))
    assert [(*r[:4], bytes(r[4])) for r in found] == expected(rows)


def test_no_rows(spark, table):
    assert substring_dedup.deduplicated(table(SCHEMA)).collect() == []
    (row,) = substring_dedup.deduplicated(table(SCHEMA, (1, None))).collect()
    assert tuple(row)[:4] == (1, 0, 0, 0)


def test_suffix_arrays():
    dice = random.Random(1)
    for size in (0, 1, 5, 40, 200):
        texts = [bytes(dice.choice(b"ab\0") for _ in range(dice.randint(0, size))) for _ in range(5)]
        texts += [texts[0], b"ab" * size]
        symbols, starts, left = suffixes.joined(texts)
        order, inverse = suffixes.suffix_array(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda n: tuple(symbols[n:]))
        assert (inverse[order] == np.arange(len(order))).all()
        for length in (1, 4, 9):
            again = suffixes.repeated_starts(symbols, left, length)
            seen = Counter(t[n:n + length] for t in texts for n in range(len(t) - length + 1))
            for text, start in zip(texts, starts, strict=True):
                wanted = [seen[text[n:n + length]] > 1 for n in range(len(text) - length + 1)]
                assert again[start:start + len(wanted)].tolist() == wanted


def a_shard(size, hashes):
    """About ``size`` bytes of classes that share passages of 450 bytes with others of their hash."""
    dice = np.random.default_rng(5)
    some = lambda n: dice.integers(97, 107, n, np.uint8).tobytes()
    rows = []
    for gram in range(hashes):
        passage = some(450)
        for n in range(size // hashes // 600):
            before = some(int(dice.integers(0, 150)))
            text = before + (passage if n % 3 else some(450)) + some(150 - len(before))
            rows.append({"gram": gram, "class": gram * 1_000_000 + n, "members": 1 + (n % 7 == 5), "bytes": text})
    return pa.Table.from_pylist(rows)


def test_shard_in_several_arrays(monkeypatch):
    shard = a_shard(30_000, 10)
    rows = lambda found: sorted(found.to_pylist(), key=lambda r: r["class"])
    whole = rows(substring_dedup._repeated_in_shard(shard))
    monkeypatch.setattr(substring_dedup, "ARRAY_BYTES", 4000)
    assert len(list(substring_dedup._arrays(shard.to_pylist()))) == 10
    assert rows(substring_dedup._repeated_in_shard(shard)) == whole
    texts = {r["class"]: r for r in shard.to_pylist()}
    assert [r["class"] for r in whole] == [c for c, r in texts.items() if r["members"] == 1 and c % 1_000_000 % 3]
    for r in whole:
        own = texts[r["class"]]
        others = [o["bytes"] for c, o in texts.items() if o["gram"] == own["gram"] and c != r["class"]]
        covered = {n + k for n in range(len(own["bytes"]) - 399) if any(own["bytes"][n:n + 400] in o for o in others) for k in range(400)}
        assert {k for m in r["marked"] for k in range(m["first"], m["until"])} == covered


@pytest.mark.parametrize(("hashes", "most"), [(500, 40), (1, 80)])
def test_memory_of_a_shard(hashes, most):
    """Bytes of memory per byte of a shard of 3 MB: of many hashes, and of a single one that stays whole."""
    shard = a_shard(3 << 20, hashes)
    tracemalloc.start()
    try:
        substring_dedup._repeated_in_shard(shard)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak / (3 << 20) < most
