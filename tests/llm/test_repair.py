"""Conversation repair against a search that starts from the last row, on random and odd conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def spoilt(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        case = zlib.crc32(name.encode()) % 20
        if case:
            text = "" if case == 1 else text.translate({ord(c): None for c in ".!?"}) if case == 2 else text
            out += [(conv_id, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def least_edits(rows):
    """(cost, audit, lines) by recursion over what is left; rows are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(n, state, inserts):
        options = []
        if n == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[n]
            cost, audit, lines = best(n + 1, state, 0)
            options.append((4 + cost, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                names = [(role, "K", 0)] + [(name, "R", 3) for name in ("user", "assistant")]
                for name, letter, price in names:
                    if (state, name[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        cost, audit, lines = best(n + 1, name[:1], 0)
                        options.append((price + extra + cost, letter + audit, (f"{name}:{text}", *lines)))
        if inserts < 3:
            name = "assistant" if state == "u" else "user"
            cost, audit, lines = best(n, name[0], inserts + 1)
            options.append((3 + cost, "I" + audit, (f"{name}:", *lines)))
        return min(options, default=(10 ** 9, "", ()))

    return best(0, "", 0)


def expected(rows):
    found = []
    for conv_id in {r[0] for r in rows}:
        own = sorted((r for r in spoilt(rows) if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = least_edits(tuple((r[2], r[3], f) for r, f in zip(own, faults, strict=True)))
        found.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                      hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=str)


def some_rows(conversations, most_rows, seed):
    dice = random.Random(seed)
    texts = ["Yes.", "no", "Well?  ", "", " \t", "a b!", None, "é.", "x" * 50]
    return [(conv_id, dice.choice([None, *range(turn, turn + 3)]), dice.choice(["user", "user", "assistant", "assistant", "system", "", "tool", None]),
             dice.choice(texts)) for conv_id in conversations for turn in range(dice.randint(1, most_rows))]


@pytest.mark.parametrize(("bits", "seed"), [(12, 1), (2, 2)])
def test_random_conversations(spark, table, monkeypatch, bits, seed):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = some_rows([*range(60), None], 9, seed)
    turns = table(SCHEMA, *rows).withColumn("at", F.lit("extra")).withColumn("fault", F.lit(1))
    found = repair.repair_conversations(repair.damage(turns), turns).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows)


def test_a_long_conversation_is_many_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    rows = [(7, n, ("user", "assistant")[n % 3 == 1], f"text {n}.") for n in range(300)]
    turns = table(SCHEMA, *rows)
    assert [tuple(r) for r in repair.repair_conversations(repair.damage(turns), turns).collect()] == expected(rows)


def test_dropped_rows_and_empty_tables(spark, table):
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    turns = table(SCHEMA, (gone, 0, "user", "Hi."))
    (row,) = repair.repair_conversations(repair.damage(turns), turns).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(repair.damage(table(SCHEMA)), table(SCHEMA)).collect() == []


def test_rules_are_shared_and_have_the_matrix_of_their_letters(spark, table):
    sequences = table("sequence string", *[("dgdg" * n + "a",) for n in range(1, 30)])
    packed, rules = repair.re_pair(sequences)
    assert rules and max(len(r.packed) for r in packed.collect()) < 60
    matrices = repair.rule_matrices(rules)

    def letters(symbol):
        pair = dict(rules).get(symbol)
        return letters(pair[0]) + letters(pair[1]) if pair else symbol

    for symbol, _ in rules:
        plain = repair._sequence_matrix(letters(symbol), matrices)
        whole = {cell: (cost, repair._text(rope)) for cell, (cost, rope) in matrices[symbol].items()}
        assert whole == {cell: (cost, repair._text(rope)) for cell, (cost, rope) in plain.items()}
