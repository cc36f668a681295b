"""Exact substring dedup: every byte that a string of 400 bytes covers which also starts anywhere else is removed.

Suffix arrays of shards decide. So that shards need neither all text nor all pairs, text is dealt to them by content:

1. Every window of 400 bytes belongs to the smallest hash of its grams of 32 bytes. Equal windows have equal smallest hashes, so
   consecutive windows with one hash make a fragment, and only fragments with a repeated hash can hold repeats.
2. Fragments that are equal byte by byte (hash and digest) are one class. All windows of a class with several members repeat.
3. The text of one member of each class goes to the shard of its hash. The hashes of a shard are joined to suffix arrays
   (``suffixes``), each hash whole, and a window repeats if its suffix shares 400 bytes with a neighbour.
4. A hash with more text than a shard holds is split over several by class. Their sorted window keys (128 bits) are cut into
   key ranges and merged by binary search, so no task sees a whole hot hash.

Windows found are joined back to all members and merged to spans per text. Equal texts share one key and so one result; a text
of 400 bytes or more with a copy goes wholly. NULL is an empty text; texts under 400 bytes stay; long texts are hashed
in overlapping blocks; rows with one id are judged on their own; no rows give no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import suffixes
from tallyloom.llm.storage import stored
from tallyloom.llm.words import whole

LENGTH = 400
GRAM = 32
WINDOWS_PER_GRAM = LENGTH - GRAM + 1
#: Window starts that are hashed at once, and bytes of text in a shard.
BLOCK_STARTS = 1 << 20
SHARD_BYTES = 4 << 20
#: Bytes of text in one suffix array, beyond which only a single hash goes; an array takes up to 60 bytes of memory for each.
ARRAY_BYTES = 1 << 20
#: Key ranges per part of a split hash, so that the keys of one range are fewer than those of a part.
RANGES_PER_PART = 4
#: Rows whose texts a task holds as Python objects at once.
ROWS_AT_ONCE = 1000
#: Texts a task remembers so as not to hash copies again; forgetting some costs time only.
REMEMBERED_TEXTS = 200_000

_MASK = (1 << 64) - 1
_MARKED = "array<struct<first: int, until: int>>"


def _gram_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all grams of a size that is a power of two, by joining halves."""
    factor = 0x9E3779B97F4A7C15 + 2 * seed
    hashes = data.astype(np.uint64) + np.uint64(1 + seed)
    step = 1
    while step < size:
        hashes = hashes[:-step] * np.uint64(factor) + hashes[step:]
        hashes ^= hashes >> np.uint64(29)
        factor = (factor * 0xBF58476D1CE4E5B9 | 1) & _MASK
        step *= 2
    return hashes


def _window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from running minima of aligned blocks."""
    padded = np.append(hashes, np.full(-len(hashes) % width, _MASK, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(hashes) - width + 1
    return np.minimum(back[:count], ahead[width - 1:width - 1 + count])


def _repeats_inside(hashes: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """Whether the hash occurs at several places of these grams."""
    marks = np.zeros(1 << 16, bool)
    marks[(smallest & np.uint64(0xFFFF)).astype(np.int64)] = True
    places = np.sort(hashes[marks[(hashes & np.uint64(0xFFFF)).astype(np.int64)]])
    return np.searchsorted(places, smallest, "right") - np.searchsorted(places, smallest, "left") > 1


def fragments(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of the text: smallest hash, first window, number of windows and whether the hash repeats inside."""
    data = np.frombuffer(text, np.uint8)
    for offset in range(0, len(data) - LENGTH + 1, BLOCK_STARTS):
        hashes = _gram_hashes(data[offset:offset + BLOCK_STARTS + LENGTH - 1], GRAM)
        minima = _window_minima(hashes, WINDOWS_PER_GRAM)
        first = np.flatnonzero(np.append(True, minima[1:] != minima[:-1]))
        smallest = minima[first]
        yield smallest.view(np.int64), first + offset, np.diff(first, append=len(minima)), _repeats_inside(hashes, smallest)


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def text_key() -> Column:
    return F.substring(F.unhex(F.sha2(whole(F.col("text")), 256)), 1, 16)


def find_fragments(texts: DataFrame) -> DataFrame:
    """Fragments (gram, class, key, first, size, again) of all texts (key, text) of 400 bytes or more."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _few_rows(batches):
            columns, keys = [[], [], [], [], []], []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED_TEXTS:
                    seen.clear()
                seen.add(key)
                data = text.encode()
                for smallest, first, windows, again in fragments(data):
                    sizes = windows + LENGTH - 1
                    classes = [int.from_bytes(hashlib.blake2b(data[a:a + n], digest_size=8).digest(), "little", signed=True)
                               for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
                    for column, part in zip(columns, (smallest, np.array(classes, np.int64), first, sizes, again), strict=True):
                        column.append(part)
                    keys += [key] * len(classes)
            if keys:
                gram, digest, first, size, again = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(digest), pa.array(keys, pa.binary()), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(again)], names=["gram", "class", "key", "first", "size", "again"])

    return texts.mapInArrow(found, "gram bigint, class bigint, key binary, first int, size int, again boolean")


def _classes(repeated: DataFrame) -> DataFrame:
    """One row per class with its number of members and one of them."""
    members = repeated.groupBy("gram", "class").agg(
        F.count("*").alias("members"), F.min(F.struct("key", "first")).alias("one"), F.max("size").alias("size"), F.max("again").alias("again"))
    return members.select("gram", "class", "members", "one.key", "one.first", "size", "again")


def _dealt(classes: DataFrame) -> DataFrame:
    """Classes whose text has to be looked at, with their shard; ``part`` counts the shards of a split hash."""
    grams = classes.groupBy("gram").agg(F.count("*").alias("n"), F.min("members").alias("least"), F.max("again").alias("repeats"),
                                        F.sum("size").alias("bytes"))
    wanted = grams.filter((F.col("least") == 1) & ((F.col("n") > 1) | F.col("repeats")))
    parts = F.ceil(F.col("bytes") / SHARD_BYTES).cast("int")
    return (classes.drop("again").join(wanted.select("gram", parts.alias("parts")), "gram")
            .withColumn("part", F.when(F.col("parts") > 1, F.pmod("class", F.col("parts"))).otherwise(-1).cast("int")))


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _ranges(marked: np.ndarray) -> list[dict]:
    """Bytes that the marked windows cover, as ranges in the fragment."""
    first, until = _runs(marked)
    return [{"first": int(a), "until": int(b) + LENGTH - 1} for a, b in zip(first, until, strict=True)]


def _window_keys(data: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of the 400 bytes (256 + 128 + 16) from each start."""
    count = len(data) - LENGTH + 1
    keys = _gram_hashes(data, 256, seed)[:count] * np.uint64(0xFF51AFD7ED558CCD)
    keys = (keys ^ (keys >> np.uint64(33))) + _gram_hashes(data, 128, seed)[256:256 + count]
    keys = keys * np.uint64(0xC4CEB9FE1A85EC53)
    keys = (keys ^ (keys >> np.uint64(29))) + _gram_hashes(data, 16, seed)[384:384 + count]
    keys = keys * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(32))


_MARKED_ROWS = f"gram bigint, class bigint, marked {_MARKED}"
_MARKED_ARROW = pa.schema([("gram", pa.int64()), ("class", pa.int64()),
                           ("marked", pa.list_(pa.struct([("first", pa.int32()), ("until", pa.int32())])))])


def _arrays(classes: list[dict]) -> Iterator[list[dict]]:
    """The classes of each suffix array of a shard. Equal windows have one hash, so those of a hash stay together."""
    held, size = [], 0
    for _, same in groupby(sorted(classes, key=itemgetter("gram")), key=itemgetter("gram")):
        of_hash = list(same)
        own = sum(len(r["bytes"]) for r in of_hash)
        if held and size + own > ARRAY_BYTES:
            yield held
            held, size = [], 0
        held, size = held + of_hash, size + own
    if held:
        yield held


def _repeated_in_shard(shard: pa.Table) -> pa.Table:
    """Classes of a shard with the ranges of their windows that start elsewhere in it too."""
    # Rows repeated with their id bring a class several times.
    classes = {(r["gram"], r["class"]): r for r in shard.to_pylist()}
    rows = []
    for held in _arrays(list(classes.values())):
        symbols, starts, left = suffixes.joined([r["bytes"] for r in held])
        again = suffixes.repeated_starts(symbols, left, LENGTH)
        for r, start in zip(held, starts.tolist(), strict=True):
            marked = again[start:start + len(r["bytes"]) - LENGTH + 1]
            if r["members"] == 1 and marked.any():
                rows.append({"gram": r["gram"], "class": r["class"], "marked": _ranges(marked)})
    return pa.Table.from_pylist(rows, _MARKED_ARROW)


_KEY_ROWS = "gram bigint, range int, part int, high array<bigint>, low array<bigint>, class array<bigint>, start array<int>"
_KEY_ARROW = pa.schema([("gram", pa.int64()), ("range", pa.int32()), ("part", pa.int32()), ("high", pa.list_(pa.int64())),
                        ("low", pa.list_(pa.int64())), ("class", pa.list_(pa.int64())), ("start", pa.list_(pa.int32()))])


def _sorted_keys(shard: pa.Table) -> pa.Table:
    """Distinct window keys of one part of a split hash, sorted, in a few key ranges for each part the hash has."""
    texts = [np.frombuffer(text, np.uint8) for text in shard["bytes"].to_pylist()]
    windows = [len(data) - LENGTH + 1 for data in texts]
    keys, one = np.unique(np.concatenate([_window_keys(data, 0) for data in texts]), return_index=True)
    low = np.concatenate([_window_keys(data, 1) for data in texts])[one]
    classes = np.repeat(np.array(shard["class"].to_pylist(), np.int64), windows)[one]
    places = np.concatenate([np.arange(n, dtype=np.int32) for n in windows])[one]
    del one
    ranges = RANGES_PER_PART * shard["parts"][0].as_py()
    cuts = np.searchsorted(keys, np.array([((1 << 64) * n) // ranges for n in range(1, ranges)], np.uint64))
    rows = []
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
        rows.append({"gram": shard["gram"][0].as_py(), "range": n, "part": shard["part"][0].as_py(), "high": keys[a:b].view(np.int64),
                     "low": low[a:b].view(np.int64), "class": classes[a:b], "start": places[a:b]})
    return pa.Table.from_pylist(rows, _KEY_ARROW)


def _merged(ranges: pa.Table) -> pa.Table:
    """Windows whose key stands in several parts, by binary search in the merged keys of one range."""
    high = [x.values.to_numpy().view(np.uint64) for x in ranges["high"]]
    merged = np.sort(np.concatenate(high))
    shared = [np.searchsorted(merged, h, "right") - np.searchsorted(merged, h, "left") > 1 for h in high]
    del merged
    keys = np.concatenate([h[s] for h, s in zip(high, shared, strict=True)])
    low, classes, places = (np.concatenate([x.values.to_numpy()[s] for x, s in zip(ranges[name], shared, strict=True)])
                            for name in ("low", "class", "start"))
    # A part has a key once, so equal neighbours are of several parts.
    order = np.lexsort((low, keys))
    keys, low = keys[order], low[order]
    same = (keys[1:] == keys[:-1]) & (low[1:] == low[:-1])
    found = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    found = found[np.lexsort((places[found], classes[found]))]
    classes, places = classes[found], places[found]
    gram = ranges["gram"][0].as_py()
    rows: list[dict] = []
    for own in np.split(np.arange(len(found)), np.flatnonzero(classes[1:] != classes[:-1]) + 1) if len(found) else ():
        marked = np.zeros(int(places[own[-1]]) + 1, bool)
        marked[places[own]] = True
        rows.append({"gram": gram, "class": int(classes[own[0]]), "marked": _ranges(marked)})
    return pa.Table.from_pylist(rows, _MARKED_ARROW)


def _marked(dealt: DataFrame) -> DataFrame:
    """Ranges of repeated windows of single classes, from the text of all classes of their shards."""
    total = dealt.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    shard = F.when(F.col("part") < 0, F.pmod(F.xxhash64("gram"), F.lit(shards))).otherwise(F.col("gram")).alias("shard")
    in_shards = dealt.withColumn("shard", shard)
    own = in_shards.repartition(shards, "shard", "part").groupBy("shard", "part").applyInArrow(_repeated_in_shard, _MARKED_ROWS)
    split = in_shards.filter("part >= 0").groupBy("gram", "part").applyInArrow(_sorted_keys, _KEY_ROWS)
    return own.unionByName(split.groupBy("gram", "range").applyInArrow(_merged, _MARKED_ROWS))


def _cut(documents: DataFrame, classes: DataFrame, copied: DataFrame) -> DataFrame:
    """Classes with the bytes of their fragment, cut out of the text of their member; of its copies that with the smallest id."""
    places = (classes.groupBy("key").agg(F.collect_list(F.struct("gram", "class", "members", "part", "parts", "first", "size")).alias("places"))
              .join(copied.select("key", F.col("doc_id").alias("one_id")), "key"))
    chosen = documents.join(places, (documents["key"] == places["key"]) & documents["doc_id"].eqNullSafe(places["one_id"]))
    cut = chosen.select(F.explode("places").alias("p"), F.encode("text", "UTF-8").alias("data"))
    return cut.select("p.*", F.substring("data", F.col("p.first") + 1, F.col("p.size")).alias("bytes")).drop("first")


def removed_spans(documents: DataFrame) -> DataFrame:
    """``key`` of every text that loses bytes, with the sorted, possibly overlapping ``spans`` to remove."""
    texts = documents.select("key", "doc_id", "text").filter(F.octet_length("text") >= LENGTH)
    copied = stored(texts.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("until"), F.min("doc_id").alias("doc_id")),
                    "copied")
    # Tasks may have copies of a text, so members are counted by key.
    found = stored(find_fragments(texts.select("key", "text")), "fragments")
    counted = found.groupBy("gram").agg(F.count("*").alias("n"), F.max("again").alias("repeats"))
    grams = stored(counted.filter((F.col("n") > 1) | F.col("repeats")).select("gram"), "grams")
    repeated = stored(found.join(grams, "gram", "left_semi").distinct(), "repeated")
    classes = stored(_classes(repeated), "classes")
    one_each = _dealt(classes)
    cut = stored(_cut(texts, one_each, copied), "cut")
    marked = stored(_marked(cut).unionByName(classes.filter("members > 1").select(
        "gram", "class", F.array(F.struct(F.lit(0).alias("first"), F.col("size").alias("until"))).alias("marked"))), "marked")

    spans = repeated.join(marked, ["gram", "class"]).select("key", F.inline("marked").alias("a", "b"), F.col("first").alias("at")).select(
        "key", (F.col("at") + F.col("a")).alias("first"), (F.col("at") + F.col("b")).alias("until"))
    whole_texts = copied.filter("n > 1").select("key", F.lit(0).alias("first"), "until")
    return spans.unionByName(whole_texts).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "until"))).alias("spans"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row of (doc_id, text)."""
    keyed = documents.select("doc_id", whole(F.col("text")).alias("text")).withColumn("key", text_key())
    spans = stored(removed_spans(keyed), "spans")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            sizes, removed, counts, texts = [], [], [], []
            for text, own in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data = text.encode()
                pieces, until, runs = [], 0, 0
                for span in own or ():
                    if span["first"] > until or not runs:
                        pieces.append(data[until:span["first"]])
                        runs += 1
                    until = max(until, span["until"])
                pieces.append(data[until:])
                texts.append(b"".join(pieces))
                sizes.append(len(data))
                removed.append(len(data) - len(texts[-1]))
                counts.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(texts, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return keyed.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        kept, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
