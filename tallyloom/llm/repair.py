"""Conversation structure repair: the cheapest edits that make every conversation alternate user and assistant.

A conversation's rows become one letter each, for role and fault, in order. The letters stand for 4 x 4 matrices over
(cost, audit): how to come from each state of the pattern ``(s?(ua)+)?`` to each other one across that row, with the least cost and of
those the least audit. Matrices are multiplied by min-plus; audits of equal states and cost never are prefixes of each other,
so the least audit of a whole is made of least audits of its parts, and rows can be bracketed in any way.

Sequences repeat much more than conversations do. They are compressed with Re-Pair: the commonest adjacent pairs of all distinct
sequences become rules, round by round, and every rule gets one matrix, computed bottom-up from its two parts with the
audit kept as a rope. All conversations share the rules and the solution of their sequence.

A conversation may hold most rows. Rows are sorted over all tasks by range, cut into blocks of at most 4,096 rows, and every
block is one sequence; only its matrix goes to the step that chains the blocks of a conversation. The digest of a repaired
conversation is one SHA-256 over all its rows, so a task reads these in order as a stream and keeps none.

NULL roles, texts, ids and turns count as one space where they are text; a NULL turn sorts first; rows of one turn are in the order of
role and text; equal rows are duplicates of each other; no rows give no conversations; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.storage import stored
from tallyloom.llm.words import BLANK_WORD

BLOCK_BITS = 12
ROUNDS, RULES_PER_ROUND, LEAST_USES = 6, 32, 4
#: Letters a to l: role class times three plus how the row may be treated.
ROLE_CLASSES = "sua"
FREE, DELETED, TRUNCATED = 0, 1, 2
FIRST_RULE = 0x100

# Costs of the edits.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3

# States: nothing yet, after a system row, after a user row, after an assistant row. Inserts that lead from one to another.
_INSERTS = {0: {0: 0, 2: 1, 3: 2}, 1: {1: 0, 2: 1, 3: 2}, 2: {2: 0, 3: 1}, 3: {3: 0, 2: 1}}
_CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}
_AFTER_TURN = {0: 2, 1: 2, 2: 3, 3: 2}


def _text(rope) -> str:
    """A rope (a string, or two ropes) as one string."""
    parts, open_ropes = [], [rope]
    while open_ropes:
        top = open_ropes.pop()
        if isinstance(top, str):
            parts.append(top)
        else:
            open_ropes += (top[1], top[0])
    return "".join(parts)


def _better(new: tuple, old: tuple | None) -> bool:
    if old is None or new[0] != old[0]:
        return old is None or new[0] < old[0]
    return _text(new[1]) < _text(old[1])


def _put(matrix: dict, cell, entry: tuple) -> None:
    if _better(entry, matrix.get(cell)):
        matrix[cell] = entry


def row_matrix(letter: str) -> dict:
    """(state, state) -> (cost, audit) of one row, with inserts before it."""
    role, kind = divmod(ord(letter) - ord("a"), 3)
    keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get((ROLE_CLASSES + " ")[role], {})
    extra = UNFINISHED if kind == TRUNCATED else 0
    matrix: dict = {}
    for start, reached in _INSERTS.items():
        for state, inserts in reached.items():
            before, paid = "I" * inserts, INSERT * inserts
            _put(matrix, (start, state), (paid + DELETE, before + "D"))
            if kind != DELETED:
                _put(matrix, (start, _AFTER_TURN[state]), (paid + REROLE + extra, before + "R"))
                if state in keeps:
                    _put(matrix, (start, keeps[state]), (paid + extra, before + "K"))
    return matrix


def multiplied(left: dict, right: dict) -> dict:
    """Min-plus product; audits are joined as ropes."""
    product: dict = {}
    for (start, middle), (cost, audit) in left.items():
        for (state, end), (more, rest) in right.items():
            if state == middle:
                _put(product, (start, end), (cost + more, (audit, rest)))
    return product


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, dict]:
    """Matrices of all letters and, bottom-up, of all rules (symbol, pair)."""
    matrices = {chr(ord("a") + n): row_matrix(chr(ord("a") + n)) for n in range(12)}
    for symbol, pair in rules:
        matrices[symbol] = multiplied(matrices[pair[0]], matrices[pair[1]])
    return matrices


def _sequence_matrix(sequence: str, matrices: dict[str, dict]) -> dict:
    """Product of all symbols, neighbours first."""
    level = [matrices[symbol] for symbol in sequence]
    while len(level) > 1:
        level = [multiplied(*level[n:n + 2]) if n + 1 < len(level) else level[n] for n in range(0, len(level), 2)]
    return level[0]


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows spoilt by a hash of id and turn; see the contract of the query."""
    space, turn = F.lit(" "), F.col("turn").cast("string")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(turn, space))
    case = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    spoilt = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.select("conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"), spoilt.alias("text"), case.alias("case"))
    copies = F.when(F.col("case") == 0, 0).when(F.col("case") == 3, 2).otherwise(1)
    repeated = F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")
    return rows.select("conv_id", "turn", "role", "text", repeated).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows, stored, with ``at``: rising in the order of conversation, turn (NULL first), role and text."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows in order with their fault, if any, and their letter."""
    key = F.sha2("text", 256).alias("text_key")
    first = turns.select("conv_id", "role", key, "at").groupBy("conv_id", "role", "text_key").agg(F.min("at").alias("at"))
    marked = turns.join(first.select("at", F.lit(True).alias("first")), "at", "left")
    blank = ~F.rlike("text", F.lit(BLANK_WORD))
    ended = F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    fault = F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(~ended, "truncated")
    initial = F.substring("role", 1, 1)
    role_class = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), DELETED).when(F.col("fault") == "truncated", TRUNCATED).otherwise(FREE)
    return (marked.withColumn("fault", fault)
            .select("conv_id", "turn", "role", "at", "fault", F.char(role_class * 3 + kind + ord("a")).alias("letter")))


def blocks_of(faulted: DataFrame) -> DataFrame:
    """Blocks of at most 4,096 rows of a conversation as strings of letters."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda r: r["letter"]), "")
    return (faulted.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block"))
            .agg(F.min("at").alias("first_at"), letters.alias("sequence")))


def _chosen(pairs: list) -> list[str]:
    """The commonest pairs of which no two can overlap in a sequence; (pair, uses) come commonest first."""
    chosen: list[str] = []
    for pair, _ in pairs:
        if all(pair[0] != other[1] and pair[1] != other[0] for other in chosen):
            chosen.append(pair)
    return chosen


def re_pair(sequences: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``sequence`` with its ``packed`` form, and the rules, which are at most ``ROUNDS`` x ``RULES_PER_ROUND``.

    The counts of pairs cover all sequences; what is brought to the driver is the head of the ranking.
    """
    packed, rules = sequences.withColumn("packed", F.col("sequence")), []
    for _ in range(ROUNDS):
        places = F.sequence(F.lit(1), F.length("packed") - 1)
        pairs = F.transform(F.when(F.length("packed") > 1, places), lambda at: F.substring("packed", at, F.lit(2)))
        ranked = (packed.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("uses"))
                  .filter(F.col("uses") >= LEAST_USES).orderBy(F.desc("uses"), "pair").limit(RULES_PER_ROUND).collect())
        if not ranked:
            break
        text = F.col("packed")
        for pair in _chosen([(r["pair"], r["uses"]) for r in ranked]):
            rules.append((chr(FIRST_RULE + len(rules)), pair))
            text = F.replace(text, F.lit(pair), F.lit(rules[-1][0]))
        packed = stored(packed.select("sequence", text.alias("packed")), "packed")
    return packed, rules


def solve(packed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``sequence`` with its matrix as a list of (start, end, cost, audit)."""

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = rule_matrices(rules)
        cells = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            found = [[{"start": s, "end": e, "cost": cost, "audit": _text(rope)}
                      for (s, e), (cost, rope) in _sequence_matrix(text, matrices).items()] for text in batch["packed"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["sequence"], pa.array(found, cells)], names=["sequence", "cells"])

    return packed.mapInArrow(solved, "sequence string, cells array<struct<start int, end int, cost bigint, audit string>>")


def _chained(blocks: list[dict]) -> tuple[int, list[str]]:
    """Least cost and the audit of each block, over the blocks of a conversation in order."""
    best = {0: (0, "", None)}
    for block in blocks:
        reached: dict = {}
        for cell in block["cells"]:
            if cell["start"] in best:
                cost, audit, chain = best[cell["start"]]
                _put(reached, cell["end"], (cost + cell["cost"], (audit, cell["audit"]), (chain, cell["audit"])))
        best = reached
    final: dict = {}
    for state, (cost, audit, chain) in best.items():
        end = "I" * _CLOSING[state]
        _put(final, 0, (cost + INSERT * len(end), (audit, end), (chain, end)))
    cost, _, (chain, end) = final[0]
    audits = []
    while chain is not None:
        chain, piece = chain
        audits.append(piece)
    audits.reverse()
    audits[-1] += end
    return cost, audits


def _illegal(letters: str) -> int:
    """Adjacent rows whose roles do not follow each other."""
    roles = "".join((ROLE_CLASSES + " ")[(ord(c) - ord("a")) // 3] for c in letters)
    return sum(roles[n:n + 2] not in ("su", "ua", "au") for n in range(len(roles) - 1))


def chain_blocks(blocks: DataFrame) -> DataFrame:
    """One row per conversation: cost, number of illegal neighbours, and its blocks with their audits."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    gathered = (blocks.groupBy(F.struct("conv_id").alias("key"))
                .agg(F.array_sort(F.collect_list(F.struct("first_at", "sequence", "cells"))).alias("blocks"))
                .select("key.conv_id", "blocks"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits = pa.list_(pa.struct([("first_at", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            costs, illegal, out = [], [], []
            for parts in batch["blocks"].to_pylist():
                cost, pieces = _chained(parts)
                costs.append(cost)
                ends = sum(_illegal(a["sequence"][-1] + b["sequence"][0]) for a, b in zip(parts, parts[1:], strict=False))
                illegal.append(ends + sum(_illegal(p["sequence"]) for p in parts))
                out.append([{"first_at": p["first_at"], "audit": piece} for p, piece in zip(parts, pieces, strict=True)])
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(out, audits)],
                                             names=["conv_id", "cost", "illegal", "audits"])

    return gathered.mapInArrow(chained, f"conv_id {kind}, cost bigint, illegal bigint, audits array<struct<first_at bigint, audit string>>")


def row_edits(chained: DataFrame) -> DataFrame:
    """``at`` of every row with its edit: its inserts before it, its own letter and, on the last row, inserts after it."""
    per_block = chained.select(F.inline("audits"))
    edits = F.regexp_extract_all("audit", F.lit(r"I*[KRD](?:I+\z)?"), F.lit(0))
    return per_block.select("first_at", F.posexplode(edits).alias("n", "edit")).select((F.col("first_at") + F.col("n")).alias("at"), "edit")


def _lines(rows: Iterator[tuple]) -> Iterator[str]:
    """Repaired lines of one conversation from (role, text, edit)."""
    last = ""
    for role, text, edit in rows:
        for letter in edit:
            if letter == "D":
                continue
            wanted = "assistant" if last == "u" else "user"
            name = role if letter == "K" else wanted
            last = name[:1]
            yield f"{name}:{'' if letter == 'I' else text}"


def repaired_lines(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (conv_id, at, role, text, edit) in which a conversation is whole and in order."""
    return turns.join(edits, "at").repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "role", "text", "edit")


def repaired_digests(ordered: DataFrame) -> DataFrame:
    """SHA-256 of every repaired conversation, its lines joined by newlines, read as a stream."""
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def rows():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield from zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text", "edit")), strict=True)

        ids, digests = [], []
        for conv_id, own in groupby(rows(), key=lambda r: r[0]):
            digest, between = hashlib.sha256(), b""
            for line in _lines(r[1:] for r in own):
                digest.update(between + line.encode())
                between = b"\n"
            ids.append(conv_id)
            digests.append(digest.hexdigest())
            if len(ids) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(digests)], names=["conv_id", "repaired_sha256"])
                ids, digests = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(digests)], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(digested, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation in ``originals``; ``rows`` are conv_id, turn, role, text."""
    turns = in_order(rows)
    faulted = stored(with_faults(turns), "faulted")
    blocks = stored(blocks_of(faulted), "blocks")
    packed, rules = re_pair(stored(blocks.select("sequence").distinct(), "sequences"))
    chained = stored(chain_blocks(blocks.join(solve(packed, rules), "sequence")), "chained")
    digests = repaired_digests(repaired_lines(turns, row_edits(chained)))

    turn_count = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint")
    counted = faulted.groupBy("conv_id").agg(
        turn_count.alias("gaps"), *[F.count_if(F.col("fault") == fault).alias(fault) for fault in ("blank", "duplicate", "truncated")])
    audit = F.array_join(F.transform("audits", lambda a: a["audit"]), "")
    results = [counted, chained.select("conv_id", "illegal", "cost", audit.alias("audit")), digests]
    out = originals.select("conv_id").distinct()
    for part in results:
        named = part.withColumnRenamed("conv_id", "part_id")
        out = out.join(named, out["conv_id"].eqNullSafe(named["part_id"]), "left").drop("part_id")
    zero, empty = F.lit(0).cast("bigint"), hashlib.sha256(b"").hexdigest()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(n, zero).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))

