from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tallyloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, pieces int"


def _back(rows):
    out = chat.format_conversations(rows)
    text = chat.formatted_text(F.col("pieces"))
    got = out.select("conv_id", text.alias("formatted"), chat.parse(text).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss"), "n_escaped")
    return {r["conv_id"]: r for r in got.collect()}


def test_round_trip_of_hostile_texts(table):
    draw = random.Random(5)
    signs = ["<s>", "</s>", "[INST] ", " [/INST]", "<<SYS>> ", "[ROLE] ", "[/ROLE] ", "\\", "<", "[", "a", " ", "\n", "é😀", "<\\/s>", "[\\\\INST]", "$1"]
    text = lambda: "".join(draw.choice(signs) for _ in range(draw.randrange(9)))
    roles = ["user", "assistant", "system", None, "tool", "[/ROLE] ", "</s>", "user\\"]
    rows = [(c, t, draw.choice(roles), text(), 0) for c in range(60) for t in range(draw.randrange(1, 6))]
    back = _back(table(TURNS, *rows))
    for conv, found in back.items():
        own = [(r or "", x) for c, _, r, x, _ in rows if c == conv]
        assert [tuple(t) for t in found["turns"]] == own
        assert found["loss"] == "".join(x for r, x in own if r == "assistant")


def test_odd_rows(table):
    back = _back(table(TURNS, (1, 2, "assistant", None, 0), (1, 1, "user", "", 0), (None, 1, "user", "x", 0), (3, None, "assistant", "b", 0),
                       (3, 0, "assistant", "a", 0), (3, 0, "assistant", "a", 0), (4, 0, "assistant", "</s>" * 50000, 0)))
    assert [tuple(t) for t in back[1]["turns"]] == [("user", ""), ("assistant", "")]
    assert back[None]["loss"] == "" and back[3]["loss"] == "baa"
    assert back[4]["loss"] == "</s>" * 50000 and back[4]["n_escaped"] == 1 and back[1]["n_escaped"] == 0
    assert _back(table(TURNS)) == {}


def test_query_counts_the_planted_conversation(spark):
    from tallyloom.llm.queries import QUERIES

    row = QUERIES["op7_chat_format"](spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(said))
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
