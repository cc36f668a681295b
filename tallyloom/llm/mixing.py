"""Mixing sources to target weights: blocks of words, drawn by permuted index until every source has its share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.storage import stored
from tallyloom.llm.words import BLANK_WORD, blank_words, text_key, whole

# Weights of the sources by code point, repeating, and the shared part of all words.
WEIGHTS = (5.0, 2.0, 1.0)
SHARED = 1.5
MOST_TIMES = 2
#: Words of a block, and slots of an output shard on average.
BLOCK_WORDS = 32
SHARD_SLOTS = 8192
#: Parts that a source's documents are numbered in, and slots that one row of the draw makes.
PARTS = 4096
CHUNK_SLOTS = 4096
SEED = 20240229


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, shared: float = SHARED,
                   most: float = MOST_TIMES) -> DataFrame:
    """Rows (source, source_no, source_size, target) for (source, source_size).

    Sources share ``shared`` of all words by weight; no target is above ``most`` times its source. A source is at
    its limit when all weights can rise to the level where it gets there without using up the words; the
    others share the rest. Only the table of sources, one row each, is ordered as a whole.
    """
    if not 0 <= shared <= most:
        raise ValueError("the shared part cannot exceed what the limits leave")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights))
    rows = sizes.withColumn("source_no", rank).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    rows = rows.withColumn("level", F.col("limit") / F.col("weight"))
    upto = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"below": F.sum("limit").over(upto), "weights_upto": F.sum("weight").over(upto),
                             "weights": F.sum("weight").over(over), "words": shared * F.sum("source_size").over(over)})
    full = F.col("below") + F.col("level") * (F.col("weights") - F.col("weights_upto")) <= F.col("words")
    rows = rows.withColumn("full", full)
    rest = F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(over), F.lit(0.0))
    open_weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(over)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * rest / open_weights))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def packed(documents: DataFrame, doc_id: str, text: str, source: str, spread: int = PARTS) -> DataFrame:
    """Rows (doc_id, source, size, at): every document's place in its source's run of words.

    Documents are numbered in parts, by a hash of id and text; a part starts where the parts before it
    end. No task orders more than a part of a source.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_key(F.col(text)).alias("text_key"),
                            F.regexp_count(whole(F.col(text)), F.lit(BLANK_WORD)).cast("long").alias("size"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(SEED), "doc_id", "text_key"))
    rows = rows.withColumn("part", F.pmod("order", F.lit(spread)).cast("int"))
    own = Window.partitionBy("source", "part").orderBy("order", "doc_id", "text_key")
    rows = rows.withColumn("before", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = parts.withColumn("start", F.sum("part_size").over(upto) - F.col("part_size"))
    joined = rows.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.part") == F.col("s.part")))
    return joined.select("doc_id", "r.source", "text_key", "size", (F.col("start") + F.col("before")).alias("at"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of the indices in a keyed pseudorandom permutation of ``range(n)``: a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence(key & (2**64 - 1)).generate_state(6, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    outside = np.flatnonzero(out >= n)
    while outside.size:
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def _draw(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks:
        for row in frame.itertuples(index=False):
            slots = np.arange(row.first, row.last, dtype=np.int64)
            blocks = np.empty_like(slots)
            for epoch in range(row.first // row.n_blocks, (row.last - 1) // row.n_blocks + 1):
                inside = slots // row.n_blocks == epoch
                blocks[inside] = permuted(slots[inside] % row.n_blocks, row.n_blocks, row.key + epoch)
            shards = permuted_hash(slots, row.key) % np.uint64(row.shards)
            yield pd.DataFrame({"source_no": np.int32(row.source_no), "slot": slots, "block": blocks, "shard": shards.astype(np.int64)})


def permuted_hash(values: np.ndarray, key: int) -> np.ndarray:
    mixed = (values.astype(np.uint64) + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def drawn_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Rows (source_no, slot, block, shard): the mix as slots, each with a block of its source and an output shard.

    A source has as many slots as its target is blocks. Each slot falls into a shard by hash, so the counts of the
    sources in a shard are a multinomial draw whose totals are the targets. Slot ``j`` takes block ``j`` of a
    permutation; when all blocks are used a further permutation begins.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    slots = F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long")
    rows = (sources.filter("source_size > 0").withColumn("n_blocks", blocks.cast("long")).withColumn("slots", slots)
            .withColumn("key", F.xxhash64(F.lit(seed), "source")).filter("slots > 0"))
    total = F.sum("slots").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("shards", F.ceil(total / SHARD_SLOTS).cast("long"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK_SLOTS).cast("long")))
    chunks = rows.select("source_no", "n_blocks", "key", "shards", "slots", first.alias("first"))
    chunks = chunks.withColumn("last", F.least(F.col("first") + CHUNK_SLOTS, F.col("slots"))).drop("slots")
    return chunks.repartition("source_no", "first").mapInPandas(_draw, "source_no int, slot long, block long, shard long")


def _overlaps(places: DataFrame, block_words: int) -> DataFrame:
    """Rows (source_no, at, block, words): how much of each block is of the document at ``at``."""
    end = F.col("at") + F.col("size")
    met = places.filter("size > 0").select("source_no", "at", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("at") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    inside = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("at", F.col("block") * block_words)
    return met.select("source_no", "at", "block", inside.alias("words"))


def _placed(documents: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(packed(documents, doc_id, text, source), "packed")
    sources = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    places = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    return places.select("doc_id", "r.source", "text_key", "size", "at", "source_no", "source_size", "target"), sources


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, taken), ``taken`` counting repeats.

    The documents of a source are packed into one run of words and cut into blocks; slots name blocks by index, and
    the words a document has in the named blocks are what the mix takes of it. A block is named twice at most.
    A source's taken words differ from its target by rounding to blocks. All randomness is a hash of the
    seed, so reruns agree.

    NULL and empty texts have size 0 and nothing is taken; a source without words has target 0; the NULL source is
    a source and comes last; repeated rows are packed one after the other, and a NULL id is an id. No documents
    give no rows. Only the named columns are read.
    """
    places, sources = _placed(documents, doc_id, text, source)
    times = drawn_slots(sources, block_words, seed).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # Spark takes the slots for as few as the sources they are drawn from, and would broadcast them.
    taken = (_overlaps(places, block_words).join(times.hint("merge"), ["source_no", "block"])
             .groupBy("source_no", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    keyed = places.withColumn("key_at", F.when(F.col("size") > 0, F.col("at")))
    t = taken.select(F.col("source_no").alias("t_no"), F.col("at").alias("t_at"), "taken")
    joined = keyed.join(t.hint("merge"), (F.col("source_no") == F.col("t_no")) & (F.col("key_at") == F.col("t_at")), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                 block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows (shard, source_no, slot, at, doc_id, piece), a block's words document by document.

    A shard is read in the order (source_no, slot, at).
    """
    places, sources = _placed(documents, doc_id, text, source)
    body = documents.select(text_key(F.col(text)).alias("text_key"), whole(F.col(text)).alias("body"))
    body = body.groupBy("text_key").agg(F.any_value("body").alias("body"))
    met = places.join(body, "text_key").withColumn("words", blank_words(F.col("body")))
    end = F.col("at") + F.col("size")
    blocks = F.sequence(F.floor(F.col("at") / block_words), F.floor((end - 1) / block_words))
    cut = met.filter("size > 0").select("source_no", "at", "doc_id", "words", end.alias("end"), F.explode(blocks).alias("block"))
    start = F.greatest("at", F.col("block") * block_words)
    count = F.least("end", (F.col("block") + 1) * block_words) - start
    pieces = cut.select("source_no", "block", "at", "doc_id",
                        F.array_join(F.slice("words", (start - F.col("at") + 1).cast("int"), count.cast("int")), " ").alias("piece"))
    return drawn_slots(sources, block_words, seed).hint("merge").join(pieces, ["source_no", "block"]).select(
        "shard", "source_no", "slot", "at", "doc_id", "piece")

